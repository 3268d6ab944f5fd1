"""Best-fit packing of texts into bins under conflicts.

A text has a size in words.  A bin holds at most ``CAPACITY`` words and never two texts of the same
source nor two of the same duplicate cluster, which is a component of near-duplicate texts (five-word
shingles, similarity of 0.8 or more).  A longer text is cut into pieces of a bin's capacity,
each a bin of its own, and a last piece that is packed like any other.  Nothing is dropped.

Texts are dealt by a hash of their id to shards of about ``SHARD_TEXTS`` texts, as many as the input
needs, so a hot source or a big cluster spreads over all shards.  Each shard is packed alone in the
order of falling size and id: bins are ordered by what is left in them and carry bitmaps of sources
and clusters; the search starts at the least residual that is large enough and goes on to the next
bin until one has no conflict, which is then the tightest that is compatible.  A new bin is opened
if there is none.  Only a shard's last bins are less full than they would be in one large packing.

Null and empty texts take no room and get no bin (null columns).  A null source or cluster conflicts
with nothing.  Rows that repeat an id are texts of their own, ordered by size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import dedup, storage
from gridloom.llm import textkit as tk

CAPACITY = 1024
SHARD_TEXTS = 4096


def pack(items: Iterable[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each (size, source, cluster) in the given order; source and cluster count from 0, -1
    for none.  Best fit among compatible bins; of equal ones the oldest."""
    order: list[tuple[int, int]] = []  # (residual, bin), sorted
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        s, c = 1 << source if source >= 0 else 0, 1 << cluster if cluster >= 0 else 0
        at = bisect.bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            left, chosen = order.pop(at)
        else:
            left, chosen = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[chosen] |= s
        clusters[chosen] |= c
        if left > size:
            bisect.insort(order, (left - size, chosen))
        out.append(chosen)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key (a hash of the text), n_words and cluster (null for texts without words).

    Texts, not ids, are compared, so rows without id and rows that repeat one have clusters too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [batch.column(i) for i in range(3)]
            for first, end, offsets, data in tk.slices(tk.text_column(batch)):
                words = tk.Words(offsets, tk.LOWER[data])
                arrays = [c.slice(first, end - first) for c in passed] + [pa.array(words.counts().astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "source", "text_key", "n_words"])

    key = F.xxhash64("text").alias("text_key")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key, "text")
    sized = source.mapInArrow(run, "doc_id long, source string, text_key long, n_words long")
    near = dedup.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    # A text that is like no other is a cluster of its own, named by its key.
    clusters = near.filter("doc_id <> component_id").select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("cluster")).distinct()
    told = sized.join(clusters, "text_key", "left").withColumn("cluster", F.when(F.col("n_words") > 0, F.coalesce("cluster", "text_key")))
    return storage.table(told.select("doc_id", "source", "text_key", "n_words", "cluster"), "measured")


def best_fit(measured: DataFrame, capacity: int = CAPACITY, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """doc_id, n_words, piece, start, end (words of the text), bin_id, bin_offset of every piece."""
    shards = max(1, -(-measured.count() // shard_texts))
    placed = (
        measured.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards)).cast("int"))
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", "doc_id", "n_words", "cluster", "source")
        .select("doc_id", "source", "n_words", "cluster", "shard", "text_key")
    )

    def shard_rows(shard: int, cols: list[list]) -> pa.RecordBatch:
        ids, source, words, cluster, keys = cols
        numbers = [{k: n for n, k in enumerate(dict.fromkeys(c for c in col if c is not None))} for col in (source, cluster)]
        pieces = []
        for row, n in enumerate(words):
            full, rest = divmod(n, capacity)
            pieces += [(capacity, row, k) for k in range(full)]
            if rest:
                pieces.append((rest, row, full))
        pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
        bins = pack(((size, numbers[0].get(source[row], -1), numbers[1].get(cluster[row], -1)) for size, row, _ in pieces), capacity)
        filled: dict[int, int] = {}
        out = []
        for (size, row, k), b in zip(pieces, bins, strict=True):
            at = filled.get(b, 0)
            filled[b] = at + size
            out.append((ids[row], words[row], k, k * capacity, k * capacity + size, (shard << 32) | b, at, keys[row]))
        out += [(ids[row], 0, 0, 0, 0, None, None, keys[row]) for row, n in enumerate(words) if not n]
        kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("bin_id", pa.int64()), ("bin_offset", pa.int64()), ("text_key", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cols = None, [[] for _ in range(5)]
        for batch in batches:
            shard = batch.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if at is not None and shard[a] != at:
                        yield shard_rows(at, cols)
                        cols = [[] for _ in range(5)]
                    at = int(shard[a])
                    for i, own in enumerate(cols):
                        own += batch.column(i if i < 4 else 5).slice(a, b - a).to_pylist()
        if at is not None:
            yield shard_rows(at, cols)

    return placed.mapInArrow(run, "doc_id long, n_words long, piece long, start long, end long, bin_id long, bin_offset long, text_key long")


def with_texts(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The pieces of ``best_fit`` with their source and their text, from the first of its words to the end of
    the last.  A text meets all its pieces at once, so it moves and is cut once; texts without words have
    no pieces to cut and keep a null text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("source").cast("string").alias("source"), "text")
    names = ["n_words", "piece", "start", "end", "bin_id", "bin_offset"]
    grouped = packed.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(*names)).alias("pieces"))
    sources = keyed.groupBy("doc_id", "text_key").agg(F.min("source").alias("source"), F.any_value("text").alias("text"))
    met = sources.withColumnRenamed("doc_id", "_id").join(grouped.withColumnRenamed("text_key", "_key"), F.expr("_id <=> doc_id and text_key = _key"))
    kinds = ", ".join(f"{n} long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, offsets, data in tk.slices(tk.text_column(batch)):
                words, body = tk.Words(offsets, data), data.tobytes()
                rows = []
                for i, own in enumerate(batch.column(3).slice(first, end - first).to_pylist()):
                    at = int(words.rows[i])
                    for p in sorted(own, key=lambda p: (p["piece"], p["bin_id"] or 0)):
                        cut = body[words.starts[at + p["start"]] : words.ends[at + p["end"] - 1]].decode() if p["end"] > p["start"] else None
                        rows.append((batch.column(0)[first + i].as_py(), batch.column(1)[first + i].as_py(), *(p[n] for n in names), cut))
                types = [pa.int64(), pa.string(), *[pa.int64()] * len(names), pa.string()]
                cols = zip(*rows, strict=True) if rows else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "source", *names, "text"])

    return met.select("doc_id", "source", "text", "pieces").mapInArrow(run, f"doc_id long, source string, {kinds}, text string")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return best_fit(measure(docs), capacity)
