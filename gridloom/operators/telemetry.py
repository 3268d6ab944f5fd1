"""Counters of a run and modelled sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Bytes of the size model.
BYTES = {"chars": 2, "slots": 8, "entries": 32, "ranges": 96, "cached_rows": 160}


def estimated_bytes(**amounts: Column | int) -> Column:
    """Modelled bytes of so many chars, slots, entries, ranges and cached_rows."""
    if unknown := set(amounts) - set(BYTES):
        raise ValueError(f"unknown amounts {sorted(unknown)}")
    total = F.lit(0).cast("long")
    for name, amount in amounts.items():
        total = total + (amount if isinstance(amount, Column) else F.lit(amount)).cast("long") * BYTES[name]
    return total


def combined(estimates: DataFrame, column: str = "bytes") -> DataFrame:
    return estimates.agg(F.sum(column).alias(column))


def rows_estimate(rows: DataFrame) -> DataFrame:
    """Modelled bytes of each document's rows."""
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", estimated_bytes(cached_rows=F.col("n")).alias("bytes"))


def counted(frame: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """The frame with counters that an action on it fills in (off unless asked for)."""
    seen = Observation(name)
    return frame.observe(seen, *[c.alias(n) for n, c in counters.items()]), seen


class Counters:
    """Named counters of the driver; off until they are enabled."""

    def __init__(self):
        self.on, self.values = False, {}

    def enable(self) -> None:
        self.on = True

    def disable(self) -> None:
        self.on = False

    def record(self, name: str, amount: int = 1) -> None:
        if self.on:
            self.values[name] = self.values.get(name, 0) + amount

    def snapshot(self) -> dict[str, int]:
        return dict(sorted(self.values.items()))

    def reset(self) -> None:
        self.values = {}
