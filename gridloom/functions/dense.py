"""Texts of words, ideographs, white space, no-break spaces and invisible breaks, as arrays.

In such a text no rule of the break analysis looks from one run of characters to the next, so its segments
are its runs, and rows of all starts are found at once.  Other texts go through ``segment`` and ``wrap``.
"""

from __future__ import annotations

import functools
import re

import numpy as np

from gridloom.functions.segment import GLUE, HARD_BREAK, KEPT_SPACE, SOFT_HYPHEN, SPACE, TAB, TEXT, ZERO_BREAK, Prepared

# Classes of characters, and the kinds of their runs; a run of no-break spaces alone is glue.
_BLANK, _FEED, _TAB, _SOFT, _ZERO, _WORD, _NO_BREAK, _WIDE = range(1, 9)
_LETTERS = "A-Za-z0-9À-ÖØ-öø-ɏ"
_IDEOGRAPHS = "一-鿿"
_DENSE = re.compile(f"[{_LETTERS}{_IDEOGRAPHS} \n\t\u00A0\u00AD\u200B]*")
_MIXED = re.compile(f"[{_LETTERS}\u00A0][{_IDEOGRAPHS}]|[{_IDEOGRAPHS}][{_LETTERS}\u00A0]")
KINDS = [TEXT, SPACE, KEPT_SPACE, TAB, GLUE, ZERO_BREAK, SOFT_HYPHEN, HARD_BREAK]
_T, _S, _K, _B, _G, _Z, _H, _F = range(8)
#: How a row ends.
ENDS = ["wrap", "hard", "soft-hyphen", "end"]
#: Shorter texts are not worth the arrays.
LEAST = 64


def _table() -> np.ndarray:
    table = np.zeros(0xA000, dtype=np.uint8)
    for low, high in ((0x41, 0x5A), (0x61, 0x7A), (0x30, 0x39), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)):
        table[low : high + 1] = _WORD
    table[0x4E00:0xA000] = _WIDE
    for c, kind in ((" ", _BLANK), ("\n", _FEED), ("\t", _TAB), ("\u00AD", _SOFT), ("\u200B", _ZERO), ("\u00A0", _NO_BREAK)):
        table[ord(c)] = kind
    return table


_CLASS = _table()


class Dense(Prepared):
    """A prepared text whose lists are made of arrays where they are asked for."""

    def __init__(self, source: str, keep_spaces: bool):
        self.source, self.utf16 = source, None
        found = _CLASS[np.frombuffer(source.encode("utf-16-le"), dtype=np.uint16)]
        glue = found == _NO_BREAK
        runs = np.where(glue, np.uint8(_WORD), found)
        edge = np.empty(len(runs), dtype=bool)
        edge[0] = True
        # Runs go on but for feeds, tabs, breaks without width and ideographs, which are a segment each.
        np.not_equal(runs[1:], runs[:-1], out=edge[1:])
        edge |= (runs == _FEED) | (runs == _TAB) | (runs == _ZERO) | (runs == _WIDE)
        self.at = np.flatnonzero(edge)
        of = runs[self.at]
        self.wide = of == _WIDE
        names = np.zeros(9, dtype=np.uint8)
        names[[_BLANK, _FEED, _TAB, _SOFT, _ZERO, _WORD, _WIDE]] = [_K if keep_spaces else _S, _F, _B, _H, _Z, _T, _T]
        self.codes = names[of]
        if glue.any():
            self.codes[np.logical_and.reduceat(glue, self.at)] = _G
        self.sizes = np.diff(self.at, append=len(source))
        self.parts = np.zeros(len(self.at), dtype=bool)
        self.parts[:-1] = self.wide[:-1] & self.wide[1:]

    @functools.cached_property
    def texts(self) -> list[str]:
        at = self.starts
        return [self.source[a:b] for a, b in zip(at, [*at[1:], len(self.source)], strict=True)]

    @functools.cached_property
    def kinds(self) -> list[str]:
        return [KINDS[k] for k in self.codes.tolist()]

    @functools.cached_property
    def starts(self) -> list[int]:
        return self.at.tolist()

    @functools.cached_property
    def breaks(self) -> list[bool]:
        return self.parts.tolist()

    def cells(self) -> np.ndarray:
        """Cells of each segment under a profile of built-in, narrow widths."""
        filling = self.codes <= _K
        filling |= self.codes == _G
        return np.where(filling, self.sizes << self.wide, 0)


def prepare(source: str, keep_spaces: bool) -> Dense | None:
    """The text as arrays, or None if it is none of these."""
    if len(source) < LEAST or not _DENSE.fullmatch(source) or (not keep_spaces and ("\t" in source or "\n" in source)):
        return None
    if not source.isascii() and _MIXED.search(source):
        return None
    return Dense(source, keep_spaces)


class Rows:
    """All rows of a dense text without tabs, from its start on, as arrays.

    For every segment the end of a row that starts there is found at once; from row to row only these ends
    are followed.  A row that has to cut a segment, and those that start within one, come from ``layout``.
    """

    def __init__(self, layout, columns: int):
        p: Dense = layout.prepared
        self.source, self.text_kinds = p.source, p.codes
        n, codes = len(p.codes), p.codes
        before = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(p.cells(), out=before[1:])
        index = np.arange(n)
        upto = lambda chosen: np.maximum.accumulate(np.where(chosen, index, -1))  # noqa: E731  the last chosen one
        since = lambda chosen: np.minimum.accumulate(np.where(chosen, index, n)[::-1])[::-1]  # noqa: E731  the next one
        soft, hard = codes == _H, codes == _F
        unseen = (codes == _S) | (codes == _Z) | soft
        limit = before[:-1] + columns
        stop = since(hard)
        fits = before[stop] <= limit
        i = np.minimum(np.searchsorted(before, limit, side="right") - 1, n - 1)
        # The last place to end before segment i; a soft hyphen needs room for its hyphen.
        stops = upto(p.parts | (codes == _K) | (codes == _S) | (codes == _Z))
        last = np.where(i > 0, stops[i - 1], -1)
        if soft.any():
            room = np.searchsorted(before, limit - layout.hyphen, side="right") - 1
            room = np.minimum(room, i - 1)
            last = np.maximum(last, np.where(room >= 0, upto(soft)[room], -1))
        cut = (p.sizes > 1) & ((codes == _K) | (codes == _S))  # spaces that are cut where the row is full
        ends = np.where(fits, np.minimum(stop + 1, n), np.where((last >= index) & ~cut[i], last + 1, -1))
        following, skipped = ends.tolist(), since(~unseen).tolist()
        starts, stops_at, slow = [], [], {}
        at, within = 0, 0
        while at < n:
            if not within:
                first = skipped[at]
                if first < n and (end := following[first]) > 0:
                    starts.append(first)
                    stops_at.append(end)
                    at = end
                    continue
            row = slow[len(starts)] = layout._next(layout.canonical((at, within)), columns, 0)
            starts.append(row.start[0])
            stops_at.append(row.end[0])
            at, within = row.end
        self.start, self.end = np.array(starts, dtype=np.int64), np.array(stops_at, dtype=np.int64)
        self.slow, self.layout, self.columns = slow, layout, columns
        ends_with = codes[self.end - 1]
        edges = np.append(p.at, len(p.source))
        self.src_start = edges[self.start]
        outside = (ends_with == _S) | (ends_with == _Z) | (ends_with == _F)
        self.src_end = np.maximum(self.src_start, np.where(outside, p.at[self.end - 1], edges[self.end]))
        self.kind = np.where(ends_with == _F, 1, np.where(ends_with == _H, 2, np.where(self.end >= n, 3, 0))).astype(np.int8)
        self.width = before[self.end] - before[self.start] + np.where(self.kind == 2, layout.hyphen, 0)
        seen = upto(~(unseen | hard))[self.end - 1]
        self.width = np.where(self.kind == 0, np.maximum(0, before[seen + 1] - before[self.start]), self.width)
        self.start_g, self.end_g = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        for k, row in slow.items():
            self.start_g[k], self.end_g[k], self.src_start[k], self.src_end[k] = row.start[1], row.end[1], row.src_start, row.src_end
            self.width[k], self.kind[k] = row.width, ENDS.index(row.break_kind)

    def texts(self) -> tuple[list[str], list[str]]:
        """Rendered and source texts of the rows."""
        ends = list(zip(self.src_start.tolist(), self.src_end.tolist(), strict=True))
        sources = [self.source[a:b] for a, b in ends]
        seen = self.source.replace("\u00AD", "").replace("\u200B", "")
        if len(seen) < len(self.source):
            units = np.frombuffer(self.source.encode("utf-16-le"), dtype=np.uint16)
            kept = np.concatenate([[0], np.cumsum((units != 0xAD) & (units != 0x200B))])
            shown = [seen[a:b] for a, b in zip(kept[self.src_start].tolist(), kept[self.src_end].tolist(), strict=True)]
        else:
            shown = list(sources)
        for k in np.flatnonzero(self.kind == 2).tolist():
            shown[k] += "-"
        if (self.text_kinds == _S).any():
            for k in np.flatnonzero(self.kind == 0).tolist():
                shown[k] = shown[k].rstrip(" ")
        for k, row in self.slow.items():
            shown[k] = self.layout.texts(row)[0]
        return shown, sources


def rows(layout, columns: int, start_column: int) -> Rows | None:
    """The rows as arrays where the text and the profile allow it."""
    p = layout.prepared
    if start_column or not isinstance(p, Dense) or not built_in(layout.profile) or (p.codes == _B).any():
        return None
    return Rows(layout, columns)


def built_in(profile) -> bool:
    return profile.measure is None and profile.ambiguous == "narrow"
