"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from mapped arrays.

Tokens are the words of a lower-cased text (A-Z only) and one end per text; each text starts in a
begin context.  Counting takes two passes:

1. words: each task sorts the 64-bit hashes of its words and sends (hash, count) runs to shards of
   the hash range.  A shard merges its runs; one task streams the shards' arrays into one file each of
   hashes, counts and running counts.  A word's id is its rank plus one; id 0 is the begin context.
2. pairs: tasks map the words, turn texts into ids and send sorted (previous, word) runs with counts
   to shards that hold equal shares of the tokens, about ``SHARD_TOKENS`` each; a frequent word is
   spread over as many shards as it fills.  A shard writes its sorted pairs and counts, and the number
   of pairs seen once, twice and more for each previous word; it passes on how many different words
   precede each word, which a third, small exchange sums by word.

What travels are runs as binary values, so an exchange has a few rows for each task.  The driver sees
a few numbers for each shard.  Workers map all arrays, once in each process, and hold none of them;
probabilities are worked out from the mapped counts when scoring::

    P(w | v) = max(c(v w) - D(c), 0) / c(v) + g(v) * Q(w)
    Q(w)     = max(k(w) - D'(k), 0) / K + g' / (V + 1)

with k(w) the number of different words before w, K their sum, and discounts for counts of one, two
and more estimated from the counts of counts.  A word that was not seen has k = 0, an unseen previous
word has no pairs and leaves Q.  All training texts are counted in full, in 64 bits; nothing is pruned.

Null and empty texts are one end token.  Repeated rows count repeatedly.  Without any training text
every token has probability one.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import arrays, storage
from gridloom.llm import textkit as tk

#: The hash of the end token; words hash to other values but for a chance of 2**-64 each.
END = np.uint64(0x5EED0E4D5EED0E4D)
#: Tokens that a counting task holds before it sends them on.
HELD = 4_000_000
#: Tokens of a shard of pairs, so of its distinct pairs at most; a task merges one shard.
SHARD_TOKENS = 4_000_000
#: The largest count of one entry of a run; larger counts take several.
MOST = 2**32 - 1


def token_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with an end after each row, and the row offsets among them."""
    words = tk.Words(offsets, tk.LOWER[data])
    hashes = words.hashes()
    rows = len(offsets) - 1
    at = words.rows + np.arange(rows + 1)
    out = np.full(len(hashes) + rows, END)
    out[np.arange(len(hashes)) + np.repeat(np.arange(rows), words.counts())] = hashes
    return out, at


def previous(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[at[:-1]] = 0
    return out


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and how often each occurs."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    return keys[edge[:-1]], np.diff(edge)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with the counts of equal ones summed."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return (keys[start], np.add.reduceat(counts, start)) if len(start) < len(keys) else (keys, counts)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs with counts as one; runs are merged in pairs of like size to keep copies few."""
    while len(runs) > 1:
        runs.sort(key=lambda r: len(r[0]))
        (ka, ca), (kb, cb) = runs[0], runs[1]
        keys = np.concatenate([ka, kb])
        order = np.argsort(keys, kind="stable")
        runs[:2] = [_added(keys[order], np.concatenate([ca, cb])[order])]
    return _added(*runs[0]) if runs else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences of the sorted keys' high halves, low halves and counts, each apart (they compress well)."""
    if len(counts) and counts.max() > MOST:
        times = -(-counts // MOST)
        last = counts - (times - 1) * MOST
        keys, ends = np.repeat(keys, times), np.cumsum(times) - 1
        counts = np.full(len(keys), MOST)
        counts[ends] = last
    high = (keys >> np.uint64(32)).astype(np.uint32)
    step = np.diff(high, prepend=np.uint32(0)).astype(np.uint32)
    return step.tobytes() + (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + counts.astype(np.uint32).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, low, counts = np.frombuffer(blob, dtype=np.uint32).reshape(3, -1)
    return (np.cumsum(step, dtype=np.uint64) << np.uint64(32)) | low, counts.astype(np.int64)


def _sent(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The runs of each shard; within a shard the keys keep their order."""
    order = np.argsort(shards, kind="stable") if len(shards) and (shards[1:] < shards[:-1]).any() else slice(None)
    shards, keys, counts = shards[order], keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]])) if len(shards) else np.zeros(1, dtype=np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(shards[a])], type=pa.int32()), pa.array([_pack(keys[a:b], counts[a:b])], type=pa.binary())], names=["shard", "run"]
        )


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Shards of a task with their runs merged; rows are sorted by shard."""
    at, runs, waiting = None, [], 0
    for batch in batches:
        for shard, run in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if shard != at and runs:
                yield at, merged(runs)
                runs, waiting = [], 0
            at = shard
            runs.append(_unpack(run.as_buffer().to_pybytes()))
            waiting += len(runs[-1][0])
            if len(runs) > 64:
                runs = [merged(runs)]
    if runs:
        yield at, merged(runs)


def _spread(frame: DataFrame, shards: int) -> DataFrame:
    return frame.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")


def _hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that belong to all of them."""

    folder: str
    words: int
    tokens: int
    texts: int
    shards: int = 1  # of pairs
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low_total: int = 0
    low_left: float = 1.0


class Vocabulary:
    """Ids and counts of words from the mapped arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.hashes = arrays.SortedHashes(arrays.load(model.folder, "words", np.uint64), arrays.load(model.folder, "table", np.int64))
        self.counts = arrays.load(model.folder, "counts", np.int64)  # of the begin context first
        self.before = arrays.load(model.folder, "before", np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids from 1; -1 for a word that was not counted."""
        found = self.hashes.find(hashes)
        return np.where(found >= 0, found + 1, -1)

    def pair_shard(self, prev: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard of a pair: pairs are laid out by the mass of tokens before them, and a previous
        word's own pairs by a hash of the word, so that no shard has more than its share."""
        share = (tk.mix(word.astype(np.uint64)) >> np.uint64(40)).astype(np.float64) / 2.0**24
        mass = self.before[prev] + share * self.counts[prev]
        total = self.model.tokens + self.model.texts
        return np.minimum(mass * (self.model.shards / max(total, 1)), self.model.shards - 1).astype(np.int32)


@functools.lru_cache(maxsize=1)
def _vocabulary(model: Model) -> Vocabulary:
    """One for each worker process, whatever the number of its tasks."""
    return Vocabulary(model)


def _alone(spark: SparkSession, work: Callable[[], None]) -> None:
    """Runs ``work`` in one task; it streams, so its memory does not follow what it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if any(batch.num_rows for batch in batches):
            work()
            yield pa.RecordBatch.from_pydict({"done": [1]})

    spark.range(0, 1, 1, 1).mapInArrow(run, "done long").collect()


def _count_words(docs: DataFrame, shards: int, folder: str) -> Model:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, offsets, data in tk.slices(tk.text_column(batch)):
                held.append(counted(token_hashes(offsets, data)[0]))
                size += len(held[-1][0])
                if size > HELD:
                    keys, counts = merged(held)
                    yield from _sent(_hash_shard(keys, shards), keys, counts)
                    held, size = [], 0
        if held:
            keys, counts = merged(held)
            yield from _sent(_hash_shard(keys, shards), keys, counts)

    parts = f"{folder}-parts"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (keys, counts) in _by_shard(batches):
            arrays.save(parts, f"words-{shard}", keys)
            arrays.save(parts, f"counts-{shard}", counts)
            ends = int(counts[keys == END].sum())
            yield pa.RecordBatch.from_pylist([{"shard": shard, "words": len(keys), "tokens": int(counts.sum()), "texts": ends}])

    runs = docs.select("text").mapInArrow(send, "shard int, run binary")
    rows = _spread(runs, shards).mapInArrow(gather, "shard long, words long, tokens long, texts long").collect()
    found, texts = sorted(r["shard"] for r in rows), sum(r["texts"] for r in rows)

    def join() -> None:
        """Shards are ranges of hashes, so their arrays in a row are sorted."""
        words, counts, before = (arrays.Writer(folder, n, k) for n, k in (("words", np.uint64), ("counts", np.int64), ("before", np.int64)))
        counts.add(np.array([texts]))
        before.add(np.array([0, texts]))
        mass = texts
        for s in found:
            words.add(arrays.load(parts, f"words-{s}", np.uint64))
            own = arrays.load(parts, f"counts-{s}", np.int64)
            counts.add(own)
            before.add(mass + np.cumsum(own))
            mass += int(own.sum())
        for out in (words, counts, before):
            out.close()
        arrays.SortedHashes.save_table(folder, "table", arrays.load(folder, "words", np.uint64))

    _alone(docs.sparkSession, join)
    storage.drop(docs.sparkSession, parts)
    model = Model(folder, sum(r["words"] for r in rows), sum(r["tokens"] for r in rows), texts)
    if model.words >= 2**32 - 1:
        raise ValueError("ids of words have 32 bits")
    return model


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == r).sum()) for r in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of one, two and more from the counts of counts; halves of the counts where
    the estimate is not possible."""
    out = []
    share = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for r in (1, 2, 3):
        value = r - (r + 1) * share * n[r] / n[r - 1] if n[r - 1] and n[r] else r / 2
        out.append(value if 0 < value <= r else r / 2)
    return tuple(out)


def _count_pairs(docs: DataFrame, model: Model) -> Model:
    shards, folder, parts = model.shards, model.folder, f"{model.folder}-parts"
    span = max(1, -(-(model.words + 1) // shards))  # ids of a shard of the lower order

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _vocabulary(model), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = counted(np.concatenate(held))
            prev, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            yield from _sent(known.pair_shard(prev, word), keys, counts)

        for batch in batches:
            for _, _, offsets, data in tk.slices(tk.text_column(batch)):
                hashes, at = token_hashes(offsets, data)
                ids = known.ids(hashes)
                held.append((previous(ids, at).astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
                size += len(ids)
                if size > HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (keys, counts) in _by_shard(batches):
            prev = (keys >> np.uint64(32)).astype(np.uint32)
            arrays.save(folder, f"pairs-{shard}", keys)
            arrays.Counts.save(folder, f"seen-{shard}", counts)
            start = np.flatnonzero(np.concatenate([[True], prev[1:] != prev[:-1]]))
            kinds = np.stack([np.add.reduceat((counts == 1).astype(np.int64), start), np.add.reduceat((counts == 2).astype(np.int64), start), np.add.reduceat((counts > 2).astype(np.int64), start)], axis=1)
            arrays.save(parts, f"prev-{shard}", prev[start])
            arrays.save(parts, f"kinds-{shard}", kinds)
            words, preceded = counted(keys & np.uint64(0xFFFFFFFF))
            part = (words.astype(np.int64) // span).astype(np.int32)
            for b in _sent(part, words, preceded):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(1, pa.string())], names=["shard", "run", "told"])

            told = json.dumps({"shard": shard, "of": _of_counts(counts)})
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.array([told])], names=["shard", "run", "told"])

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (words, counts) in _by_shard(batches):
            dense = np.zeros(span, dtype=np.uint32)
            dense[words.astype(np.int64) - shard * span] = counts
            arrays.save(parts, f"low-{shard}", dense)
            n = _of_counts(counts)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "total": int(counts.sum()), "n1": n[0], "n2": n[1], "n3": n[2], "n4": n[3], "many": int((counts > 2).sum())}])


    runs = docs.select("text").mapInArrow(send, "shard int, run binary")
    passed = storage.table(_spread(runs, shards).mapInArrow(gather, "shard int, run binary, told string"), "pairs")
    told = [json.loads(r["told"]) for r in passed.filter("told is not null").select("told").collect()]
    rows = _spread(passed.filter("told is null").select("shard", "run"), shards).mapInArrow(
        low, "shard long, total long, n1 long, n2 long, n3 long, n4 long, many long"
    ).collect()
    d = discounts([sum(t["of"][i] for t in told) for i in range(4)])
    n = [sum(r[f"n{i}"] for r in rows) for i in (1, 2, 3, 4)]
    ld, total = discounts(n), sum(r["total"] for r in rows)
    left = (ld[0] * n[0] + ld[1] * n[1] + ld[2] * sum(r["many"] for r in rows)) / total if total else 1.0
    have, low_have = sorted(t["shard"] for t in told), {r["shard"] for r in rows}

    def join() -> None:
        """The lower order by id, and what each previous word leaves to it."""
        low = arrays.Writer(folder, "low", np.uint32)
        for s in range(shards):
            low.add(arrays.load(parts, f"low-{s}", np.uint32) if s in low_have else np.zeros(span, dtype=np.uint32))
        low.close()
        counts = arrays.load(folder, "counts", np.int64)
        out, done = arrays.Writer(folder, "left", np.float64), 0
        held = np.zeros((0, 4), dtype=np.int64)  # the last previous word: its pairs may go on in the next shard
        for s in [*have, None]:
            rows = held
            if s is not None:
                new = np.column_stack([arrays.load(parts, f"prev-{s}", np.uint32).astype(np.int64), arrays.load(parts, f"kinds-{s}", np.int64).reshape(-1, 3)])
                if len(held) and new[0, 0] == held[0, 0]:
                    new[0, 1:] += held[0, 1:]
                    rows = new
                else:
                    rows = np.concatenate([held, new])
                held, rows = rows[-1:], rows[:-1]
            stop = len(counts) if s is None else int(held[0, 0])
            share = np.ones(stop - done)
            share[rows[:, 0] - done] = (rows[:, 1:] @ np.array(d)) / counts[rows[:, 0]]
            out.add(share)
            done = stop
        out.close()

    _alone(docs.sparkSession, join)
    storage.drop(docs.sparkSession, parts)
    return replace(model, discounts=d, low_discounts=ld, low_total=total, low_left=left)


def fit(docs: DataFrame) -> Model:
    """Counts all rows of ``docs``."""
    spark = docs.sparkSession
    folder = storage.fresh(spark, "ngram")
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    model = _count_words(docs, least, folder)
    return _count_pairs(docs, replace(model, shards=max(least, -(-model.tokens // SHARD_TOKENS))))


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3)]


class Scorer:
    """Scores slices from the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model, self.known = model, _vocabulary(model)
        self.low = arrays.load(model.folder, "low", np.uint32)
        #: What a previous word leaves to the lower order, by id; an end is never followed.
        self.left = arrays.load(model.folder, "left", np.float64)
        self.shard = functools.cache(lambda s: (arrays.load(model.folder, f"pairs-{s}", np.uint64), arrays.Counts(model.folder, f"seen-{s}")))

    def _pair_counts(self, prev: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=np.int64)
        rows = np.flatnonzero((prev >= 0) & (ids > 0))
        shard = self.known.pair_shard(prev[rows], ids[rows])
        keys = (prev[rows].astype(np.uint64) << np.uint64(32)) | ids[rows].astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        order = order[np.argsort(shard[order], kind="stable")]
        edge = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1)).tolist()
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            part = order[a:b]
            pairs, seen = self.shard(int(shard[part[0]]))
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, keys[part]), len(pairs) - 1)
                hit = pairs[at] == keys[part]
                out[rows[part[hit]]] = seen[at[hit]]
        return out

    def score(self, offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
        m = self.model
        hashes, at = token_hashes(offsets, data)
        ids = self.known.ids(hashes)
        prev = previous(ids, at)
        pairs = self._pair_counts(prev, ids)
        counts = lambda which, i, none: np.where(i >= 0, which[np.maximum(i, 0)], none)
        seen, low = (counts(x, ids, 0) for x in (self.known.counts, self.low))
        q = _discounted(low.astype(np.int64), m.low_discounts) / max(m.low_total, 1) + m.low_left / (m.words + 1)
        p = _discounted(pairs, m.discounts) / np.maximum(counts(self.known.counts, prev, 1), 1) + counts(self.left, prev, 1.0) * q
        base = np.log10((seen + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
        add = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)
        return {"n_tokens": np.diff(at), "n_known": add((seen > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(p))}


@functools.lru_cache(maxsize=1)
def _scorer(model: Model) -> Scorer:
    """One for each worker process, whatever the number of its tasks."""
    return Scorer(model)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, base_score, score and perplexity for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            passed = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            for first, end, offsets, data in tk.slices(tk.text_column(batch)):
                got = scorer.score(offsets, data)
                out = [pa.array(got[k].astype(np.int64)) for k in ("n_tokens", "n_known")] + [pa.array(got[k].astype(float)) for k in ("base_score", "score")]
                out.append(pa.array(10.0 ** np.minimum(-got["score"] / got["n_tokens"], 300.0)))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in passed), *out], names=[*keep, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep]
    return source.mapInArrow(run, ", ".join([*kinds, "n_tokens long, n_known long, base_score double, score double, perplexity double"]))
