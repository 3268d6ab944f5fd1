"""Secret scans: fixed patterns, and strings that look random to two character Markov models.

Patterns (kinds ``assign``, ``access``, ``hex``) find leftmost non-overlapping matches of their kind
and drop those that are too short.  Beyond them every run of at least ``MIN_RUN`` key characters is
scored by a first-order character model of random strings and one of ordinary identifiers; it is a
span of kind ``model`` if its log-likelihood ratio passes ``MIN_RATIO`` in all and ``MIN_PER_CHAR``
per character, and no pattern span overlaps it.

Both models are trained from labelled strings, counted as pairs of neighbouring characters over all
texts in one pass: ordinary ones are the words outside pattern spans, random ones the values that the
patterns find.  Seeded random strings in the usual alphabets join the random ones, with the same
weight whatever the texts hold; words in capitals and in title case, words joined as identifiers are
joined, numbers, dates and rules of one character join the ordinary ones, worked out from their counts.
A table of pairs has a fixed size, so nothing is sampled.  Offsets are code points, ends exclusive;
null and empty texts have no spans, and repeated rows have the same ones.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkit as tk

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Runs of hexadecimal digits are maximal, so asking for their length here drops the same matches.
_HEX = re.compile(rb"[0-9a-f]{24,}")
MIN_RUN = 16
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_WORD = re.compile(rb"[A-Za-z0-9+/_=-]{4,}")

#: Share of words that also count as joined, in capitals and in title case, and of numbers.
COMPOSED, NUMBERS = 0.15, 0.1
MIN_RATIO = 12.0
MIN_PER_CHAR = 0.45
REDACTED = "[SECRET]"


def pattern_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes, in the order of start and kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_UPPER = np.arange(128)
_UPPER[97:123] -= 32
_KEY = np.zeros(256, dtype=bool)
_KEY[list(_LETTERS + _LETTERS.lower() + b"0123456789+/_=-")] = True
WORD = 4


def pair_counts(strings: Iterable[bytes]) -> np.ndarray:
    """How often each character follows each other one; 0 stands before and after every string."""
    body = np.frombuffer(b"\0".join([b"", *strings, b""]), dtype=np.uint8).astype(np.int64) & 127
    return np.bincount(body[:-1] * 128 + body[1:], minlength=128 * 128).reshape(128, 128).astype(float)


def word_counts(data: np.ndarray, hidden: Iterable[tuple[int, int]]) -> np.ndarray:
    """Pairs of the runs of ``WORD`` key characters and more, outside the hidden spans."""
    key = _KEY[data]
    for a, b in hidden:
        key[a:b] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], key, [False]]).astype(np.int8)))
    short = np.flatnonzero(edge[1::2] - edge[::2] < WORD)
    for a, b in zip(edge[::2][short].tolist(), edge[1::2][short].tolist(), strict=True):
        key[a:b] = False
    body = np.concatenate([[0], np.where(key, data, 0), [0]]).astype(np.int64)
    counts = np.bincount(body[:-1] * 128 + body[1:], minlength=128 * 128).reshape(128, 128).astype(float)
    counts[0, 0] = 0.0
    return counts


def seeded_strings(seed: int = 11) -> list[bytes]:
    rng = random.Random(seed)
    hexa, big, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for alphabet, share in ((hexa, 2), (hexa.upper(), 2), (big, 1), (mixed, 4), (mixed + "+/", 2), (mixed + "-_", 1)):
        out += ["".join(rng.choices(alphabet, k=rng.randint(16, 48))).encode() for _ in range(400 * share)]
    return out


def composed(words: np.ndarray) -> np.ndarray:
    """Counts of identifiers, capitals, numbers, dates and rules, for counts of words."""
    n = max(words[0].sum(), 1.0)
    first, last = words[0] / n, words[:, 0] / n
    upper = np.zeros_like(words)
    np.add.at(upper, (_UPPER[:, None], _UPPER[None, :]), words)
    capital = np.bincount(_UPPER, weights=first, minlength=128)
    out = words + COMPOSED * upper
    title = np.zeros_like(words)
    np.add.at(title, (_UPPER[:, None], np.arange(128)[None, :]), np.outer(first, np.ones(128)) * (words / np.maximum(words.sum(axis=1, keepdims=True), 1.0)) * n)
    out += COMPOSED * title
    each = COMPOSED * n
    out[0] += each * capital
    out += each * (np.outer(last, capital) + np.outer(last, first))  # camelCase, and words run together
    for mark in b"_-/":
        out[:, mark] += each * last
        out[mark] += each * first
    digits = np.arange(48, 58)
    share = NUMBERS * n
    out[np.ix_(digits, digits)] += share * 8 / 100  # numbers of some digits, alone, after words and in dates
    out[0, digits] += share / 10
    out[digits, 0] += share / 10
    out[:, digits] += share * np.outer(last, np.ones(10)) / 10
    out[digits, 45] += share / 10
    out[45, digits] += share / 10
    for mark in b"-=_+/":
        out[mark, mark] += share
        out[0, mark] += share / 20
        out[mark, 0] += share / 20
    return out


@dataclass
class Markov:
    """log P(string | random) - log P(string | ordinary) as a table over pairs of neighbouring characters."""

    ratio: np.ndarray

    @staticmethod
    def of_counts(found: np.ndarray, words: np.ndarray) -> Markov:
        def logs(counts: np.ndarray) -> np.ndarray:
            single = counts.sum(axis=0) + 0.5
            # Rare pairs fall back to the single characters.
            smooth = counts + 8.0 * single / single.sum()
            return np.log(smooth / smooth.sum(axis=1, keepdims=True))

        seeded = pair_counts(seeded_strings())
        shown = found * min(1.0, seeded.sum() / max(found.sum(), 1.0))
        if not words.any():
            words = pair_counts([b"value", b"name", b"index", b"count", b"total", b"order"] * 100)
        return Markov(logs(seeded + shown) - logs(composed(words)))

    @staticmethod
    def train(texts: Iterable[bytes]) -> Markov:
        found, words = np.zeros((128, 128)), np.zeros((128, 128))
        for text in texts:
            f, w = text_counts(text)
            found, words = found + f, words + w
        return Markov.of_counts(found, words)

    def score(self, string: bytes) -> float:
        codes = np.frombuffer(b"\0" + string, dtype=np.uint8) & 127
        return float(self.ratio[codes[:-1], codes[1:]].sum())

    def is_secret(self, string: bytes) -> bool:
        value = self.score(string)
        return value >= MIN_RATIO and value >= MIN_PER_CHAR * len(string)


def _value(text: bytes, span: tuple[int, int, int]) -> bytes:
    start, kind, end = span
    return _ASSIGN.match(text, start).group(2) if kind == 0 else text[start:end]


def text_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the values that patterns find in a text, and of its other words."""
    base = pattern_spans(text)
    found = pair_counts(_value(text, s) for s in base) if base else np.zeros((128, 128))
    return found, word_counts(np.frombuffer(text, dtype=np.uint8), [(a, b) for a, _, b in base])


def train(docs: DataFrame) -> Markov:
    """Models of all texts.  Each task gives its own sums of pairs, and the driver gets one table of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 128, 128))
        for batch in batches:
            for _, _, offsets, data in tk.slices(tk.text_column(batch)):
                body = data.tobytes()
                # Texts of a slice are parted by a byte that no pattern takes.
                joined = b"\n".join([body[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                total += text_counts(joined)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total.ravel()[at].astype(np.int64))], names=["at", "n"])

    summed = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    table = np.zeros(2 * 128 * 128)
    for r in summed.collect():  # 32,768 rows at most
        table[r["at"]] = r["n"]
    return Markov.of_counts(*table.reshape(2, 128, 128))


def spans(text: bytes, model: Markov) -> list[tuple[int, int, int]]:
    """All spans in bytes: those of the patterns, and what the model adds between them."""
    base = pattern_spans(text)
    # Of the pattern spans that start before an end, the one that ends last tells whether any overlaps.
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    added = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)
        if not (before and reach[before - 1] > a) and model.is_secret(m.group()):
            added.append((a, 3, b))
    return sorted(base + added) if added else base


def _code_points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not found or text.isascii():
        return found
    at = tk.codepoints(np.frombuffer(text, dtype=np.uint8))
    return [(int(at[a]), kind, int(at[b])) for a, kind, b in found]


def scan(docs: DataFrame, model: Markov, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans`` ARRAY<STRUCT<kind, start, end>> for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # one 128 x 128 table
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tk.text_column(batch)
            passed = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            rows = []
            for text in column.cast(pa.large_binary()):
                body = text.as_py()
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in _code_points(body, spans(body, held.value))])
            yield pa.RecordBatch.from_arrays([*passed, pa.array(rows, type=kind)], names=[*keep, "spans"])

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep]
    return source.mapInArrow(run, ", ".join([*kinds, "spans array<struct<kind string, start long, end long>>"]))


def digest(scanned: DataFrame) -> DataFrame:
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "model"), told), ",")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", told), ",").alias("spans"),
    )


def redact(text: str, found: list[tuple[int, int]], mark: str = REDACTED) -> str:
    """The text with each maximal group of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, b in sorted(found):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, model: Markov) -> DataFrame:
    """All rows and columns, with secrets masked in ``text``; a null text stays null.  ``n_chars``
    follows the text where that has changed."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, offsets, data in tk.slices(tk.text_column(batch)):
                part, body, texts, lengths = batch.slice(first, end - first), data.tobytes(), [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    own = body[a:b]
                    found = spans(own, held.value)
                    texts.append(redact(own.decode(), [(x, y) for x, _, y in _code_points(own, found)]) if found else own.decode())
                    lengths.append(len(texts[-1]) if found else None)
                arrays = list(part.columns)
                at = part.schema.get_field_index("text")
                arrays[at] = pc.if_else(pc.is_null(arrays[at]), arrays[at], pa.array(texts, type=arrays[at].type))
                if (n := part.schema.get_field_index("n_chars")) >= 0:
                    arrays[n] = pc.coalesce(pa.array(lengths, type=arrays[n].type), arrays[n])
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, schema)
