"""URL filters: host and path rules, and an exact host list as a cascade of Bloom filters.

Level 0 of the cascade holds the listed keys that occur, level 1 the other keys of the universe that
level 0 takes for listed, level 2 the listed ones that level 1 takes for those, and so on until no
key is mistaken.  A key of the universe is listed if the first level that does not know it has an odd
number (counted from 0).  The universe is every distinct key of the corpus, so the answer is exact
for each of its rows without a join.

Keys are dealt by hash to shards of about ``SHARD_KEYS`` keys, as many as the universe needs, and each
shard has a cascade of its own, built by one task from its sorted keys.  Level 0 is sized for a false
positive rate of about listed / universe and later levels for one half, so all levels together take a
few bytes for each listed key, and their size does not follow the corpus.  Levels are files in the
shared folder that workers map into memory; neither the driver nor a broadcast holds any of them, and
no size of list or universe is refused.

Null urls, and urls without ``://``, have an empty host and path; an empty host is never listed.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import arrays, storage

SHARD_KEYS = 1 << 20
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null without one.  A rule fits its host and all
    hosts below it, where the path starts with the rule's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


@dataclass(frozen=True)
class Level:
    words: np.ndarray  # bits in 64-bit words
    hashes: int
    seed: int

    @staticmethod
    def of(a: np.ndarray, b: np.ndarray, rate: float, seed: int) -> Level:
        """A filter of keys with about this rate of false positives."""
        count = max(len(a), 1)
        words = max(1, math.ceil(-count * math.log(rate) / math.log(2) ** 2 / 64))
        hashes = max(1, round(words * 64 / count * math.log(2)))
        bits = np.zeros(words * 64, dtype=bool)
        for i in range(hashes):
            bits[(_position(a, b, seed, i) % np.uint64(words * 64)).astype(np.int64)] = True
        return Level(np.packbits(bits, bitorder="little").view(np.uint64), hashes, seed)

    def knows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        bits = np.uint64(len(self.words) * 64)
        for i in range(self.hashes):
            at = _position(a, b, self.seed, i) % bits
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def _position(a: np.ndarray, b: np.ndarray, seed: int, i: int) -> np.ndarray:
    x = (a + np.uint64(i) * (b | np.uint64(1))) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def levels_of(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[Level]:
    """The levels of a cascade over a universe of keys, of which some are listed."""
    levels: list[Level] = []
    sides = {True: (a[listed], b[listed]), False: (a[~listed], b[~listed])}
    side = True  # listed keys go into even levels
    while len(sides[side][0]):
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two keys share all their hashes")
        here, there = len(sides[side][0]), len(sides[not side][0])
        rate = 0.5 if levels else min(0.5, max(1e-9, here / max(1, there) / math.sqrt(2)))
        level = Level.of(*sides[side], rate, len(levels) + 1)
        levels.append(level)
        # Only keys of the other side that the level mistakes go on; its own all stay.
        mistaken = level.knows(*sides[not side])
        sides[not side] = tuple(x[mistaken] for x in sides[not side])
        side = not side
    return levels


def ask(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that does not know it tells."""
    out = np.zeros(len(a), dtype=bool)
    alive = np.ones(len(a), dtype=bool)
    for k, level in enumerate(levels):
        known = level.knows(a, b)
        out[alive & ~known] = k % 2 == 1
        alive &= known
    out[alive] = len(levels) % 2 == 1
    return out


@dataclass(frozen=True)
class Cascade:
    """Where the levels of each shard are, with their numbers of hashes."""

    folder: str
    hashes: tuple[tuple[int, ...], ...]  # of each shard's levels

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shards = len(self.hashes)
        shard = a % np.uint64(shards)
        out = np.zeros(len(a), dtype=bool)
        for s in np.unique(shard).tolist() if shards > 1 else [0]:
            rows = np.flatnonzero(shard == s)
            out[rows] = ask(_mapped(self, s), a[rows], b[rows])
        return out


@functools.lru_cache(maxsize=1024)
def _mapped(cascade: Cascade, shard: int) -> list[Level]:
    """A shard's levels, mapped once in each worker process."""
    return [Level(arrays.load(cascade.folder, f"level-{shard}-{k}", np.uint64), h, k + 1) for k, h in enumerate(cascade.hashes[shard])]


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


def build_cascade(universe: DataFrame, listed: DataFrame, key: str = "key", shard_keys: int = SHARD_KEYS) -> Cascade:
    """``universe``: all keys of the corpus; ``listed``: the listed keys (they may or may not occur)."""
    spark = universe.sparkSession
    a, b = _hashes(F.col("key"))
    mark = listed.select(F.col(key).alias("key")).filter("key is not null").distinct().withColumn("listed", F.lit(True))
    keys = universe.select(F.col(key).alias("key")).filter("key is not null").distinct()
    keys = keys.join(mark, "key", "left").select(a.alias("a"), b.alias("b"), F.coalesce("listed", F.lit(False)).alias("listed"))
    held = storage.Scratch(spark)
    keys = held.table(keys, "keys")
    shards = max(1, -(-keys.count() // shard_keys))
    folder = storage.fresh(spark, "cascade")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if batch.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        a, b = (table[c].to_numpy().view(np.uint64) for c in ("a", "b"))
        marked = table["listed"].to_numpy()
        order = np.lexsort((b, a))
        a, b, marked = a[order], b[order], marked[order]
        shard = a % np.uint64(shards)
        for s in np.unique(shard).tolist():
            rows = shard == s
            found = levels_of(a[rows], b[rows], marked[rows])
            for k, level in enumerate(found):
                arrays.save(folder, f"level-{s}-{k}", level.words)
            yield pa.RecordBatch.from_pylist([{"shard": s, "hashes": [x.hashes for x in found]}], schema=pa.schema([("shard", pa.int64()), ("hashes", pa.list_(pa.int64()))]))

    # A partition holds whole shards, and as many partitions as shards keep a task at about one.
    number = F.expr(f"cast(pmod(pmod(a, {shards}) + case when a < 0 then {2**64 % shards} else 0 end, {shards}) as long)")
    dealt = keys.withColumn("shard", number).repartition(shards, "shard").drop("shard")
    rows = {r["shard"]: tuple(r["hashes"]) for r in dealt.mapInArrow(build, "shard long, hashes array<long>").collect()}
    held.clear()
    return Cascade(folder, tuple(rows.get(s, ()) for s in range(shards)))


def is_listed(cascade: Cascade, key: Column) -> Column:
    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(cascade.listed(a.to_numpy().view(np.uint64), b.to_numpy().view(np.uint64)))

    return test(*_hashes(key))


def site_of(host: Column) -> Column:
    """The key of the host list: the host's last three labels (all, if there are fewer)."""
    return F.substring_index(host, ".", -3)


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict; without a fitting rule a listed site is blocked."""
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    sites = hosts.select(F.when(F.col("host") != "", site_of(F.col("host"))).alias("key"))
    cascade = build_cascade(sites, listed)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    blocked = (F.col("host") != "") & is_listed(cascade, site_of(F.col("host")))
    return hosts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("by_rule"), blocked.alias("listed")).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")
    )
