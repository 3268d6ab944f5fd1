"""BPE encoding and decoding by a prefix trie of the distinct words.

For a merge list in which every token has one merge, the encoding of a prefix is settled by its last
token: it is the token at the end of the prefix that can stand after the last token of what is left
when it is taken off.  Two tokens can stand together if no merge over their border would have come
before the merges inside them.  So the distinct words of a slice go into a trie, and a depth-first
walk gives each node its last token once, for all words that share the prefix; a word's ids are read
by stepping back from its end.  The mark of a word's end belongs to the last character's symbol, so
ends are nodes of their own.

Sorted words are the leaves of the trie in depth-first order; the walk keeps the path to the current
leaf and goes back to the common prefix, so no nodes need to be kept.

A worker remembers words in two generations of about ``REMEMBERED``; what neither has met lately is
encoded again, which costs time and changes nothing.  A vocabulary file that cuts texts in another way
is refused when it is loaded; one that lacks a single byte's letter makes a text that needs it an error,
as there is no unknown token.  Texts are processed whole; null and empty texts have no ids.
Repeated rows get the same ids; other columns are carried along as asked.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkit as tk

REMEMBERED = 300_000
#: White space of the vocabulary's patterns (the Unicode property).
_WHITE = "\t-\r \x85\xa0  -     　"
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _WHITE + r"\p{L}\p{N}]+")
_END = "</w>"
_SHORT = (2, 1)


def _byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


_LETTER = _byte_letters()
_ASCII_PRINTABLE = frozenset(chr(c) for c in range(33, 127))


def normalise(text: str) -> str:
    """NFC and lower case by single characters (white space is left to the pieces)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


#: How a vocabulary file of this kind says that it cuts texts; others would need other code.
_CUTS = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def _check_cuts(parts: dict) -> None:
    """An error for a file whose normaliser, pieces or model are not those that this module follows."""
    norms = (parts.get("normalizer") or {}).get("normalizers", [])
    cuts = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = parts["model"]
    told = {"normalizer": [n["type"] for n in norms], "pre_tokenizer": [c["type"] for c in cuts], "pattern": cuts[0].get("pattern", {}).get("Regex") if cuts else None}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if told != _CUTS or model.get("end_of_word_suffix") != _END or not plain:
        raise ValueError(f"a vocabulary that cuts texts in another way: {told}")


@dataclass
class Vocabulary:
    """Ids, merges and special tokens of a word-end BPE."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        _check_cuts(parts)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in parts["model"]["merges"]]
        return Vocabulary(parts["model"]["vocab"], merges, {t["content"]: t["id"] for t in parts["added_tokens"]})


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        ids = self.ids = vocabulary.ids
        self.special = vocabulary.special
        self.strings = {i: s for s, i in ids.items()} | {i: s for s, i in vocabulary.special.items()}
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(vocabulary.merges)}
        self.made = {ids[a + b]: (r, ids[a], ids[b]) for r, (a, b) in enumerate(vocabulary.merges)}
        self.inner = {s: i for s, i in ids.items() if not s.endswith(_END)}
        self.final = {s[: -len(_END)]: i for s, i in ids.items() if s.endswith(_END)}
        self._joins: dict[int, bool] = {}
        self._edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._word_ids: dict[bytes, bytes] = {}
        self._word_text: dict[bytes, bytes] = {}
        self._older: tuple[dict, dict] = ({}, {})
        self._tails = (self._sizes(self.inner), self._sizes(self.final))

    @staticmethod
    def _sizes(tokens: dict[str, int]) -> dict[str, list[int]]:
        """Sizes of tokens, falling, by the last three letters (or all, if there are fewer)."""
        found: dict[str, set[int]] = {}
        for t in tokens:
            found.setdefault(t[-3:], set(_SHORT)).add(len(t))
        return {tail: sorted(sizes, reverse=True) for tail, sizes in found.items()}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token while it is merged, from a single symbol up, each with the
        rank of the merge that ends it."""
        known = self._edges[side]
        if token not in known:
            chain, ends = [], len(self.rank)
            at: int | None = token
            while at is not None:
                chain.append((at, ends))
                made = self.made.get(at)
                ends, at = (made[0], made[1 + side]) if made else (0, None)
            known[token] = chain[::-1]
        return known[token]

    def _join(self, left: int, right: int) -> bool:
        """True if no merge over the border comes before both tokens are whole."""
        key = left << 20 | right
        known = self._joins.get(key)
        if known is None:
            a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
            known = True
            while True:
                (x, x_ends), (y, y_ends) = a[i], b[j]
                over = self.rank.get((x, y))
                # Of equal merges the leftmost comes first.
                if over is not None and over < x_ends and over <= y_ends:
                    known = False
                    break
                if i + 1 == len(a) and j + 1 == len(b):
                    break
                if j + 1 == len(b) or (i + 1 < len(a) and x_ends <= y_ends):
                    i += 1
                else:
                    j += 1
            if len(self._joins) > 4_000_000:
                self._joins.clear()
            self._joins[key] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words (in byte letters, not empty)."""
        out: dict[str, list[int]] = {}
        joins, inner, final = self._joins.get, self.inner.get, self.final.get
        inner_tails, final_tails = self._tails
        path, last, length = "", [-1], [0]  # of each prefix on the path: its last token, and that token's length
        for word in sorted(words):
            n, shared = len(word), 0
            most = min(n - 1, len(path))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], length[shared + 1 :]
            for depth in range(shared + 1, n + 1):
                lookup, tails = (inner, inner_tails) if depth < n else (final, final_tails)
                for size in tails.get(word[max(0, depth - 3) : depth], _SHORT):
                    start = depth - size
                    if start < 0:
                        continue
                    token = lookup(word[start:depth])
                    if token is None:
                        continue
                    if start:
                        fits = joins(last[start] << 20 | token)
                        if not (self._join(last[start], token) if fits is None else fits):
                            continue
                    last.append(token)
                    length.append(size)
                    break
                else:
                    raise ValueError(f"no encoding of {word[:depth]!r}")
            ids, at = [], n
            while at:
                ids.append(last[at])
                at -= length[at]
            ids.reverse()
            out[word] = ids
            path = word[: n - 1]
            last.pop()
            length.pop()
        return out

    @staticmethod
    def pieces(chunk: str) -> list[str]:
        """The words of a chunk, in byte letters."""
        low = normalise(chunk)
        if low.isascii() and low.isalpha():
            return [low]
        return [p if _ASCII_PRINTABLE.issuperset(p) else "".join([_LETTER[b] for b in p.encode()]) for p in _PIECE.findall(low)]

    def _learn(self, chunks: Iterable[bytes]) -> None:
        split = {c: self.pieces(c.decode()) for c in chunks}
        strings, ids_of, text_of = self.strings, self._word_ids, self._word_text
        found = self.encode_words({p for pieces in split.values() for p in pieces})
        told = {p: (array("I", ids).tobytes(), "".join([strings[i] + " " for i in ids]).encode()) for p, ids in found.items()}
        for chunk, pieces in split.items():
            if len(pieces) == 1:
                ids_of[chunk], text_of[chunk] = told[pieces[0]]
            else:
                ids_of[chunk] = b"".join([told[p][0] for p in pieces])
                text_of[chunk] = b"".join([told[p][1] for p in pieces])

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each text its ids (little-endian, 32 bits) and their decoding."""
        if len(self._word_ids) > REMEMBERED:
            self._older = (self._word_ids, self._word_text)
            self._word_ids, self._word_text = {}, {}
        parted = [self._parts(t) for t in texts]
        new = {w for parts in parted for p in parts if isinstance(p, list) for w in p}
        new -= self._word_ids.keys()
        older_ids, older_text = self._older
        if older_ids:
            again = new & older_ids.keys()
            self._word_ids.update((w, older_ids[w]) for w in again)
            self._word_text.update((w, older_text[w]) for w in again)
            new -= again
        self._learn(new)
        out = []
        for parts in parted:
            ids, told = [], []
            for p in parts:
                if isinstance(p, list):
                    ids += map(self._word_ids.__getitem__, p)
                    told += map(self._word_text.__getitem__, p)
                else:
                    ids.append(p.to_bytes(4, "little"))
                    told.append(self.strings[p].encode() + b" ")
            out.append((b"".join(ids), b"".join(told)[:-1]))
        return out

    def _parts(self, text: bytes) -> list:
        """Lists of chunks between special tokens, and the special tokens' ids."""
        if not any(s.encode() in text for s in self.special):
            return [text.split()]
        body, out, at = text.decode(), [], 0
        for m in self._special.finditer(body):
            out += [body[at : m.start()].encode().split(), self.special[m.group()]]
            at = m.end()
        return [*out, body[at:].encode().split()]


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the size of a vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(held.value)
            passed = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            column = tk.text_column(batch)
            for first, end, offsets, data in tk.slices(column):
                body = data.tobytes()
                got = encoder.encode([body[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                out = [pa.array([i for i, _ in got], type=pa.binary()), pa.array([t for _, t in got], type=pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in passed), *out], names=[*keep, "ids", "decoded"])

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep]
    return source.mapInArrow(run, ", ".join([*kinds, "ids binary, decoded string"]))


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded`` from an ``ids`` column; tokens are parted by a space."""
    held = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = None
        for batch in batches:
            strings = strings or {i: s for s, i in (*held.value.ids.items(), *held.value.special.items())}
            passed = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            texts = [" ".join([strings[i] for i in np.frombuffer(b or b"", dtype="<u4").tolist()]) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*passed, pa.array(texts, type=pa.string())], names=[*keep, "decoded"])

    source = encoded.select(*dict.fromkeys([*keep, "ids"]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep]
    return source.mapInArrow(run, ", ".join([*kinds, "decoded string"]))


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
