"""Context-triggered piecewise fingerprints and their likeness.

A rolling hash over ``WINDOW`` bytes ends a chunk wherever its value plus one is a multiple of the
block size; each chunk gives one of 64 letters.  The block size starts at the least 3 * 2**k whose
``LETTERS`` blocks cover the text, and is halved, down to ``LEAST_BLOCK``, while it ends fewer than
``LETTERS`` / 2 chunks, as in texts of a repeated word, line or passage.  A text of one repeated byte
or of very few distinct windows may have no boundary at the least block either; it keeps one letter.  A fingerprint is ``block:letters:letters at twice the block``; what lies beyond
``LETTERS`` - 1 chunks is one last chunk, so every byte counts.

Two fingerprints are compared where their block sizes are equal or one is twice the other: one minus
the edit distance over the longer length, and zero if the letters have no run of ``COMMON`` letters
in common.  Equal fingerprints are alike by 1, others of incompatible sizes by 0.

Null texts count as empty; the fingerprint of the empty text is ``3::``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkit as tk

WINDOW = 7
LETTERS = 64
LEAST_BLOCK = 3
COMMON = 4
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_CODE = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint32)


def _rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of the last WINDOW bytes of each byte's row, plus one."""
    code = _CODE[data]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = code.copy()
    for back in range(1, WINDOW):
        turned = (code << np.uint32(4 * back)) | (code >> np.uint32(32 - 4 * back))
        out[back:] ^= np.where(place[back:] >= back, turned[:-back], np.uint32(0))
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x7FEB352D)
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x846CA68B)
    return (out ^ (out >> np.uint32(16))).astype(np.int64) + 1


def _letters(ends: np.ndarray, first: int, stop: int, total: np.ndarray, down: np.ndarray) -> str:
    if len(ends) > LETTERS - 1:
        ends = ends[: LETTERS - 1]
    if not len(ends) or ends[-1] < stop:
        ends = np.append(ends, stop)
    starts = np.concatenate([[first], ends[:-1]])
    hashed = tk.mix((total[ends] - total[starts]) * down[starts])
    return _ALPHABET[(hashed & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprints(texts: list[bytes]) -> list[str]:
    out: list[str] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= tk.SLICE_BYTES):
            size += len(texts[end])
            end += 1
        out += _fingerprints(texts[at:end])
        at = end
    return out


def _fingerprints(texts: list[bytes]) -> list[str]:
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    rolled = _rolling(data, offsets)
    up, down = tk.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(tk._BYTE_CODE[data] * up[: len(data)], out=total[1:])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if a == b:
            out.append(f"{LEAST_BLOCK}::")
            continue
        block = LEAST_BLOCK
        while block * LETTERS < b - a:
            block *= 2
        own = rolled[a:b]
        ends = np.flatnonzero(own % block == 0)
        while block > LEAST_BLOCK and len(ends) < LETTERS // 2:
            block //= 2
            ends = np.flatnonzero(own % block == 0)
        double = ends[own[ends] % (2 * block) == 0]
        out.append(f"{block}:{_letters(ends + (a + 1), a, b, total, down)}:{_letters(double + (a + 1), a, b, total, down)}")
    return out


def _matrix(strings: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    out = np.full((len(strings), LETTERS), pad, dtype=np.int16)
    flat = np.frombuffer("".join(strings).encode(), dtype=np.uint8)
    out[np.arange(LETTERS)[None, :] < sizes[:, None]] = flat
    return out, sizes


def edit_distances(first: list[str], second: list[str]) -> np.ndarray:
    """Edit distances of pairs of strings of at most LETTERS letters, all pairs at a time."""
    a, la = _matrix(first, -1)
    b, lb = _matrix(second, -2)
    ramp = np.arange(LETTERS + 1, dtype=np.int16)
    row = np.broadcast_to(ramp, (len(first), LETTERS + 1)).copy()
    out = row[np.arange(len(first)), lb].astype(np.int64)
    for i in range(int(la.max(initial=0))):
        step = np.empty_like(row)
        step[:, 0] = i + 1
        np.minimum(row[:, 1:] + np.int16(1), row[:, :-1] + (a[:, i : i + 1] != b), out=step[:, 1:])
        row = np.minimum.accumulate(step - ramp, axis=1) + ramp
        done = np.flatnonzero(la == i + 1)
        out[done] = row[done, lb[done]]
    return out


def _share_run(first: list[str], second: list[str]) -> np.ndarray:
    out = np.zeros(len(first), dtype=bool)
    for at in range(0, len(first), 512):
        a, la = _matrix(first[at : at + 512], 0)
        b, lb = _matrix(second[at : at + 512], 0)
        grams = []
        for x, size in ((a, la), (b, lb)):
            n = LETTERS - COMMON + 1
            g = np.zeros((len(x), n), dtype=np.int64)
            for j in range(COMMON):
                g = g * 128 + x[:, j : j + n]
            g[np.arange(n)[None, :] > (size - COMMON)[:, None]] = -1
            grams.append(g)
        grams[1][grams[1] < 0] = -2
        out[at : at + 512] = (grams[0][:, :, None] == grams[1][:, None, :]).any(axis=(1, 2))
    return out


def likeness(first: list[str], second: list[str]) -> np.ndarray:
    """Likeness of pairs of fingerprints, from 0 to 1."""
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(first, second, strict=True)])
    rows, left, right = [], [], []
    for i, (x, y) in enumerate(zip(first, second, strict=True)):
        if x == y:
            continue
        (m, a1, a2), (n, b1, b2) = x.split(":"), y.split(":")
        m, n = int(m), int(n)
        pairs = [(a1, b1), (a2, b2)] if m == n else [(a1, b2)] if m == 2 * n else [(a2, b1)] if n == 2 * m else []
        for a, b in pairs:
            rows.append(i)
            left.append(a)
            right.append(b)
    if rows:
        keep = np.flatnonzero(_share_run(left, right))
        if len(keep):
            left, right = [left[k] for k in keep], [right[k] for k in keep]
            longest = np.array([max(len(a), len(b), 1) for a, b in zip(left, right, strict=True)])
            np.maximum.at(out, np.array(rows)[keep], 1.0 - edit_distances(left, right) / longest)
    return out


def fingerprint_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fingerprint`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            for first, end, offsets, data in tk.slices(tk.text_column(batch)):
                body = data.tobytes()
                prints = _fingerprints([body[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in passed), pa.array(prints, type=pa.string())], names=[*keep, "fingerprint"])

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep]
    return source.mapInArrow(run, ", ".join([*kinds, "fingerprint string"]))


#: Documents of a range.  Ranges grow in number with the input up to what one job can have, and in length
#: beyond; a task streams its range in slices, so its memory does not depend on that.
RANGE_ROWS = 4096
MAX_RANGES = 100_000


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of ascending doc_id, each range followed by a copy of the row after it.

    Columns: part, copy (false for the range's own rows), key, doc_id, text.  Ranges are cut at
    approximate quantiles of the ids, and a range is a partition; the first row of each range also goes,
    as a copy, to the range before it, and the very first row to the last.  Only texts move, once.  A null
    id comes first; rows that repeat an id are ordered by text and stay in one range.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    ids = keyed.select("key")
    spark = docs.sparkSession
    n = ids.count()
    parts = int(min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))))
    # Quantiles are taken as doubles; counted from the least id, large ids keep their differences.
    shares = [i / parts for i in range(1, parts)]
    base = ids.filter(F.col("key") > -(2**63)).agg(F.min("key").alias("key")).first()["key"] if parts > 1 else None
    cuts = []
    if base is not None:
        risen = (F.col("key").cast("decimal(20,0)") - F.lit(base).cast("decimal(20,0)")).cast("double")
        found = ids.filter(F.col("key") > -(2**63)).agg(F.percentile_approx(risen, shares, 10 * parts).alias("cuts")).first()["cuts"]
        cuts = sorted({base + int(c) for c in found})
    cut = np.array(cuts, dtype=np.int64)

    def deal(heads: dict[int, int] | None):
        # Without heads: (part, key) of each row; with them: also copies for the range before.
        first_of = sorted(heads.items()) if heads else []
        before = {p: first_of[i - 1][0] if i else first_of[-1][0] for i, (p, _) in enumerate(first_of)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column(batch.schema.get_field_index("key"))
                part = np.searchsorted(cut, key.to_numpy(), side="right")
                if heads is None:
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), key], names=["part", "key"])
                    continue
                cols = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "doc_id", "text")]
                names = ["part", "copy", "key", "doc_id", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), dtype=bool)), *cols], names=names)
                lead = np.flatnonzero(key.to_numpy() == np.array([heads[p] for p in part.tolist()], dtype=np.int64))
                if len(lead):
                    to = pa.array([before[p] for p in part[lead].tolist()], type=pa.int32())
                    yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(lead), dtype=bool)), *(c.take(pa.array(lead)) for c in cols)], names=names)

        return run

    firsts = ids.mapInArrow(deal(None), "part int, key long").groupBy("part").agg(F.min("key").alias("key")).collect()
    heads = {r["part"]: r["key"] for r in firsts}
    if not heads:
        return spark.createDataFrame([], "part int, copy boolean, key long, doc_id long, text string")
    dealt = keyed.mapInArrow(deal(heads), "part int, copy boolean, key long, doc_id long, text string")
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "copy", "key", "text")


def edit(text: str, after: str) -> str:
    """The text with its last half replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited (its SHA-256), both fingerprints, and their likeness, for every row."""
    kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def results(rows: list[tuple]) -> pa.RecordBatch | None:
        """All rows but the last, each against the one after it."""
        texts = [t for _, _, _, t in rows]
        own = fingerprints([t.encode() for t in texts])
        told = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not told:
            return None
        edited = [edit(texts[i], texts[i + 1]).encode() for i in told]
        prints = fingerprints(edited)
        mine, after = [own[i] for i in told], [own[i + 1] for i in told]
        cols = [
            [rows[i][2] for i in told], [len(texts[i]) for i in told], [hashlib.sha256(e).hexdigest() for e in edited],
            mine, prints, likeness(mine, prints), likeness(mine, after),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            part, copy, ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "copy", "doc_id", "text"))
            for i in range(batch.num_rows):
                held.append((part[i].as_py(), copy[i].as_py(), ids[i].as_py(), texts[i].as_py() or ""))
                size += len(held[-1][3])
                if size > tk.SLICE_BYTES and len(held) > 1:
                    if (out := results(held)) is not None:
                        yield out
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1 and (out := results(held)) is not None:
            yield out

    names = {pa.int64(): "long", pa.string(): "string", pa.float64(): "double"}
    return with_next(docs).mapInArrow(run, ", ".join(f"{n} {names[t]}" for n, t in kinds))
