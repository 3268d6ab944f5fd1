"""Quality rules as a short-circuit cascade.

Each rule rejects a text by a few of its metrics.  On a small sample of the whole table the cost of each rule's
metrics and the share of rows that it rejects are measured; rules then run in the order of rejection
per cost, each on what the rules before it have kept.  The order decides time only: a text is kept
if no rule rejects it.

Metrics are exact and over whole texts: a null or empty text has none of anything, and the base rule
``few_words`` rejects it.  Repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkit as tk

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True
WINDOW = 5


class Measures:
    """Metrics of a slice of rows, computed when first asked for."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.offsets, self.data = offsets, data
        self._known: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    def only(self, rows: np.ndarray) -> Measures:
        """The measures of some rows, with what is known of them."""
        lengths = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        chosen = np.zeros(len(self.offsets) - 1, dtype=bool)
        chosen[rows] = True
        out = Measures(offsets, self.data[np.repeat(chosen, np.diff(self.offsets))])
        out._known = {k: v[rows] for k, v in self._known.items() if not k.startswith("words")}
        return out

    def _words(self) -> tk.Words:
        return tk.Words(self.offsets, self.data)

    def _n_words(self) -> np.ndarray:
        return self["words"].counts().astype(np.int64)

    def _word_chars(self) -> np.ndarray:
        heads = ((self.data & 0xC0) != 0x80) & ~tk.IS_SPACE[self.data]
        return tk.sums(heads, self.offsets)

    def _n_symbols(self) -> np.ndarray:
        return tk.sums(_IS_SYMBOL[self.data], self.offsets)

    def _n_dup_lines(self) -> np.ndarray:
        out = np.zeros(len(self.offsets) - 1, dtype=np.int64)
        body = self.data.tobytes()
        for row, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)):
            if body.find(b"\n", a, b) >= 0:
                lines = [line for line in body[a:b].split(b"\n") if line.strip()]
                out[row] = len(lines) - len(set(lines))
        return out

    def _n_repeat_words(self) -> np.ndarray:
        words = self["words"]
        rows = np.repeat(np.arange(len(self.offsets) - 1), words.counts())
        covered = np.zeros(len(rows) + 1, dtype=np.int64)
        found = tk.windows(words.hashes(), WINDOW)
        if len(found):
            whole = np.flatnonzero(rows[: len(found)] == rows[WINDOW - 1 :])
            keyed = tk.mix(found[whole] ^ (rows[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            order = np.argsort(keyed, kind="stable")
            ranked = keyed[order]
            equal = np.zeros(len(ranked) + 1, dtype=bool)
            equal[1:-1] = ranked[1:] == ranked[:-1]
            first = whole[order[equal[1:] | equal[:-1]]]
            np.add.at(covered, first, 1)
            np.add.at(covered, np.minimum(first + WINDOW, len(rows)), -1)
        return tk.sums(np.cumsum(covered[:-1]) > 0, words.rows)


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Measures], np.ndarray]


def _mean_word(m: Measures) -> np.ndarray:
    n, chars = m["n_words"], m["word_chars"]
    return (chars < 2 * n) | (chars > 15 * n)


#: The production rules.  The first two are the base rules.
RULES: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), _mean_word),
    Rule("repeated_lines", ("n_words", "n_dup_lines"), lambda m: (10 * m["n_dup_lines"] > m["n_words"])),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: About how many rows the rules are timed on, drawn from the whole table; they steer the order of rules and nothing else.
SAMPLE_ROWS = 400


def _profile(column: pa.Array, rules: Sequence[Rule]) -> list[tuple[str, float, int, int]]:
    out = []
    for rule in rules:
        spent, rejected = 0.0, 0
        for _, _, offsets, data in tk.slices(column):
            began = time.process_time()
            rejected += int(rule.rejects(Measures(offsets, data)).sum())
            spent += time.process_time() - began
        out.append((rule.name, spent, rejected, len(column)))
    return out


def plan_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample of about ``sample_rows`` rows from all over the table
    (ties: as given)."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _profile(tk.text_column(batch), rules)
            yield pa.RecordBatch.from_pylist([dict(zip(("rule", "cost", "rejected", "rows"), r, strict=True)) for r in rows], schema=kind)

    kind = pa.schema([("rule", pa.string()), ("cost", pa.float64()), ("rejected", pa.int64()), ("rows", pa.int64())])
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.select("text").sample(share, seed=6)
    found = sample.mapInArrow(profile, "rule string, cost double, rejected long, rows long")
    stats = {r["rule"]: r for r in found.groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()}
    gain = lambda r: stats[r.name]["rejected"] / max(stats[r.name]["cost"], 1e-9) if r.name in stats else 0.0
    return sorted(rules, key=gain, reverse=True)


def cascade(measures: Measures, rules: Sequence[Rule]) -> np.ndarray:
    """True for rows that no rule rejects; later rules see only rows that earlier ones have kept."""
    n = len(measures.offsets) - 1
    kept = np.ones(n, dtype=bool)
    rows, left = np.arange(n), measures
    for rule in rules:
        bad = rule.rejects(left)
        kept[rows[bad]] = False
        if bad.all():
            break
        rows = rows[~bad]
        # Copying the bytes that are left pays only when a good part is gone.
        if 4 * bad.sum() > len(bad):
            left = left.only(np.flatnonzero(~bad))
        elif bad.any():
            left = _Masked(left, np.flatnonzero(~bad))
    return kept


class _Masked:
    """Rows of other measures, without copying their bytes."""

    def __init__(self, inner, rows: np.ndarray):
        self.inner, self.rows = inner, rows

    def __getitem__(self, name: str) -> np.ndarray:
        return self.inner[name][self.rows]

    def only(self, rows: np.ndarray):
        return self.inner.only(self.rows[rows])


def judge(
    docs: DataFrame, rules: Sequence[Rule] | None = None, metrics: Sequence[str] = (), keep: Sequence[str] = ("doc_id",), verdict_name: str = "kept"
) -> DataFrame:
    """``keep`` columns, the asked metrics and the verdict; one row per input row."""
    ordered = list(rules) if rules is not None else plan_cascade(docs)
    wanted = list(metrics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tk.text_column(batch)
            passed = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            for first, end, offsets, data in tk.slices(column):
                measures = Measures(offsets, data)
                verdict = cascade(measures, ordered)
                arrays = [c.slice(first, end - first) for c in passed]
                arrays += [pa.array(measures[m].astype(np.int64)) for m in wanted] + [pa.array(verdict)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *wanted, verdict_name])

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep]
    return source.mapInArrow(run, ", ".join([*kinds, *(f"{m} long" for m in wanted), f"`{verdict_name}` boolean"]))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    return judge(docs, keep=docs.columns, verdict_name="_no_rule_rejects").filter("_no_rule_rejects").drop("_no_rule_rejects")
