"""Vectorised text primitives over Arrow string columns.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` and never spans two rows.
Everything below works on slices of whole rows, so memory follows ``SLICE_BYTES`` (or the longest
single text, if that is longer), not the Arrow batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows are grouped until they reach this many bytes; a longer text is processed alone.
SLICE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as strings without nulls (null texts count as empty)."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (len + 1) and the UTF-8 bytes behind them, without copying."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return at, body


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of consecutive groups of whole rows."""
    at, body = raw(column)
    first, n = 0, len(column)
    while first < n:
        end = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, at[first : end + 1] - at[first], body[at[first] : at[end]]
        first = end


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULTIPLIER, _INVERSE):
        table = np.full(size, np.uint64(base))
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n at least; tables are kept up to a bounded size."""
    size = max(1 << 21, 1 << max(0, n - 1).bit_length())
    return _powers(size)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that each output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX[0])


class Words:
    """The words of a slice: byte spans, and for each row the range of its words."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.offsets, self.data = offsets, data
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        np.logical_not(IS_SPACE[data], out=inside[1 : n + 1])
        begins = inside[1:] & ~inside[:-1]
        stops = inside[:-1] & ~inside[1:]
        cut = offsets[1:-1]
        if len(cut) and n:
            cut = cut[(cut > 0) & (cut < n)]
            both = inside[cut] & inside[cut + 1]
            begins[cut[both]] = True
            stops[cut[both]] = True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops)
        self.rows = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words; item i stands for words i .. i+size-1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(size)) * _MIX[1]
    for j in range(size):
        out += hashes[j : j + n] * _MIX[2 + j]
    return mix(out)


def codepoints(data: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte (len + 1)."""
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; empty ranges give 0."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
