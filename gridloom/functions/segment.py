"""Break analysis: from a normalised text to segments between which rows may break.

Words come from Unicode word boundaries.  A stream of rules then fuses what must not be parted
(punctuation, quotes, glue, urls, numbers) and splits what may be (hyphenated numbers, CJK).
Offsets are code points.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import regex

from gridloom.functions.width import clusters, is_wide

TEXT, SPACE, KEPT_SPACE, TAB, GLUE, ZERO_BREAK, SOFT_HYPHEN, HARD_BREAK = (
    "text", "space", "preserved-space", "tab", "glue", "zero-width-break", "soft-hyphen", "hard-break",
)

# Character classes of the break rules.
KINSOKU_START = "，．！：；？、。・）〕〉》」』】〗〙〛ー々〻ゝゞヽヾ"
KINSOKU_END = "\"([{“‘«‹（〔〈《「『【〖〘〚"
FORWARD_STICKY = "'’"
LEFT_STICKY = ".,!?:;،؛؟।॥၊။၌၍၏)]}%\"”’»›…"
ARABIC_TRAILING = ":.،؛"
MYANMAR_MEDIAL = "၏"
NUMERIC_JOINERS = ":-/×,.+–—"
KEEP_ALL_GLUE = "\u00A0\u202F\u2060\uFEFF"
KEEP_ALL_DASHES = "-‐–—"
GLUE_CHARS = "\u00A0\u202F\u2060\uFEFF"
_CJK_CLASS = (
    r"　-ヿ㄰-㆏㐀-䶿一-鿿가-힯豈-﫿＀-￯"
    r"\U00020000-\U0002a6df\U0002a700-\U0002ee5d\U0002f800-\U0002fa1f\U00030000-\U00033479"
)

_CJK = regex.compile(f"[{_CJK_CLASS}]")
_ARABIC = regex.compile(r"\p{Script=Arabic}")
_WORDS = regex.compile(r"(?w)\b")
_WORD_LIKE = regex.compile(r"[\p{Alphabetic}\p{N}]|__")
_esc = lambda chars: "".join(map(regex.escape, chars))
_OPENERS = _esc(KINSOKU_END + FORWARD_STICKY)
_QUOTE_CLUSTER = regex.compile(rf"(?=.*[{_OPENERS}{_esc(LEFT_STICKY)}])[\\\p{{M}}{_OPENERS}{_esc(LEFT_STICKY)}]+", regex.DOTALL)
_LEFT_CLUSTER = regex.compile(rf"[{_esc(LEFT_STICKY)}][{_esc(LEFT_STICKY)}\p{{M}}]*")
_FORWARD_CLUSTER = regex.compile(rf"[{_OPENERS}\p{{M}}]+")
_NO_LINE_START = regex.compile(f"[{_esc(KINSOKU_START + LEFT_STICKY)}]+")
_FORWARD_TAIL = regex.compile(rf"[{_OPENERS}\p{{M}}]+$")
_SCHEME = regex.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
_NUMERIC = regex.compile(rf"[\p{{Nd}}{_esc(NUMERIC_JOINERS)}]+")
_DIGIT = regex.compile(r"\p{Nd}")
_CHAIN = regex.compile(r"[A-Za-z0-9_]+[.,:;]*")
_CONTINUATION = regex.compile(r"[\p{M}\uFE00-\uFE0F\u20E3]")
_MARKED_SPACE = regex.compile(r" \p{M}+")
_HAS_BREAK_CHAR = regex.compile(r"[ \t\n\u00A0\u00AD\u200B\u202F\u2060\uFEFF]")


#: Answers about short strings are remembered: texts repeat their words.
_remember = functools.lru_cache(maxsize=1 << 16)


def is_cjk(text: str) -> bool:
    return not text.isascii() and _CJK.search(text) is not None


@_remember
def _traits(part: str) -> tuple[bool, bool]:
    """(looks like a word, has no character that breaks)."""
    return _WORD_LIKE.search(part) is not None, _HAS_BREAK_CHAR.search(part) is None


@_remember
def _left_sticky(text: str) -> bool:
    return _LEFT_CLUSTER.fullmatch(text) is not None or _QUOTE_CLUSTER.fullmatch(text) is not None


@_remember
def _quotes(text: str) -> bool:
    return _QUOTE_CLUSTER.fullmatch(text) is not None


@_remember
def _openers(text: str) -> bool:
    return _FORWARD_CLUSTER.fullmatch(text) is not None or _quotes(text)


@_remember
def _chained(text: str) -> bool:
    return _CHAIN.fullmatch(text) is not None


def _numeric(text: str) -> bool:
    return _NUMERIC.fullmatch(text) is not None and _DIGIT.search(text) is not None


class Segment:
    __slots__ = ("text", "word", "kind", "start", "run")

    def __init__(self, text: str, word: bool, kind: str, start: int):
        self.text, self.word, self.kind, self.start = text, word, kind, start
        self.run = None  # the character, while the segment is a run of one non-word character

    def __repr__(self) -> str:
        return f"<{self.text!r} {self.kind}{' word' if self.word else ''} @{self.start}>"


def kind_of(cluster: str, keep_spaces: bool) -> str:
    if len(cluster) != 1:
        return TEXT
    if cluster == " ":
        return KEPT_SPACE if keep_spaces else SPACE
    if keep_spaces and cluster == "\t":
        return TAB
    if keep_spaces and cluster == "\n":
        return HARD_BREAK
    if cluster in GLUE_CHARS:
        return GLUE
    return ZERO_BREAK if cluster == "\u200B" else SOFT_HYPHEN if cluster == "\u00AD" else TEXT


def words(text: str) -> Iterator[tuple[str, int]]:
    """Word segments: (text, offset)."""
    at = 0
    for line in text.splitlines(keepends=True) if "\r" not in text and text.isascii() else [text]:
        for part in _WORDS.split(line):
            if part:
                yield part, at
                at += len(part)


def pieces(text: str, keep_spaces: bool) -> Iterator[Segment]:
    """Word segments, cut where the kind of break changes."""
    for part, at in words(text):
        if part == " ":
            yield Segment(part, False, KEPT_SPACE if keep_spaces else SPACE, at)
            continue
        word, whole = _traits(part)
        if whole:
            yield Segment(part, word, TEXT, at)
            continue
        held: Segment | None = None
        for cluster in clusters(part):
            kind = kind_of(cluster, keep_spaces)
            if held is not None and held.kind == kind:
                held.text += cluster
            else:
                if held is not None:
                    yield held
                held = Segment(cluster, word and kind == TEXT, kind, at)
            at += len(cluster)
        if held is not None:
            yield held


def _sticks(last: Segment, piece: Segment) -> bool:
    """Whether a text piece belongs to the text segment before it."""
    t, piece_text = last.text, piece.text
    if not t.isascii():
        if _NO_LINE_START.fullmatch(piece_text) and is_cjk(t):
            return True
        if t[-1] in MYANMAR_MEDIAL:
            return True
        if piece.word and t[-1] in ARABIC_TRAILING and _ARABIC.search(piece_text) and _ARABIC.search(t):
            return True
    return False


def _gather(found: Iterable[Segment]) -> list[Segment]:
    out: list[Segment] = []
    for piece in found:
        single = piece.text if piece.kind == TEXT and not piece.word and len(piece.text) == 1 and ord(piece.text) < 0x10000 and piece.text not in "-—" else None
        last = out[-1] if out else None
        if last is not None and piece.kind == TEXT and last.kind == TEXT:
            if _sticks(last, piece):
                joined = True
            elif single is not None and last.run == single:
                last.text += single
                continue
            else:
                joined = not piece.word and not is_cjk(last.text) and (
                    _left_sticky(piece.text) or (piece.text == "-" and last.word)
                )
            if joined:
                last.text += piece.text
                last.word |= piece.word
                last.run = None
                continue
        piece.run = single
        out.append(piece)
    return out


def _glue_quotes(segs: list[Segment]) -> list[Segment]:
    out: list[Segment] = []
    for s in segs:
        if s.kind == TEXT and not s.word and out and out[-1].kind == TEXT and _quotes(s.text) and not is_cjk(out[-1].text):
            out[-1].text += s.text
        else:
            out.append(s)
    return out


def _carry_openers(segs: list[Segment]) -> list[Segment]:
    out: list[Segment] = []
    for s in reversed(segs):
        if s.kind == TEXT and not s.word and out and out[-1].kind == TEXT and _openers(s.text):
            out[-1].text, out[-1].start = s.text + out[-1].text, s.start
        else:
            out.append(s)
    out.reverse()
    return out


def _groups(segs: list[Segment], take: Callable[[list[Segment], int], int], word: Callable[[list[Segment]], bool]) -> list[Segment]:
    """Fuses segs[i : take(segs, i)] into one text segment wherever that is more than i."""
    out, i = [], 0
    while i < len(segs):
        end = take(segs, i)
        if end > i:
            group = segs[i:end]
            out.append(Segment("".join([s.text for s in group]), word(group), TEXT, group[0].start))
            i = end
        else:
            out.append(segs[i])
            i += 1
    return out


def _any_word(group: list[Segment]) -> bool:
    return any(s.word for s in group)


def _fuse_glue(segs: list[Segment]) -> list[Segment]:
    def take(s: list[Segment], i: int) -> int:
        end, texts = i, 0
        while end < len(s) and s[end].kind in (TEXT, GLUE):
            # Two texts belong together only over glue.
            if s[end].kind == TEXT and end > i and s[end - 1].kind == TEXT:
                break
            texts += s[end].kind == TEXT
            end += 1
        return end if texts and end - i > 1 else i

    fused = _groups(segs, take, _any_word)
    out: list[Segment] = []
    for s in fused:
        if s.kind == GLUE and out and out[-1].kind == GLUE:
            out[-1].text += s.text
        else:
            if s.kind == GLUE:
                s.word = False
            out.append(s)
    return out


def _fuse_urls(segs: list[Segment]) -> list[Segment]:
    def take(s: list[Segment], i: int) -> int:
        if s[i].kind != TEXT:
            return i
        scheme = _SCHEME.fullmatch(s[i].text) and i + 1 < len(s) and s[i + 1].kind == TEXT and s[i + 1].text == "//"
        if not scheme and not s[i].text.startswith("www."):
            return i
        end = i + 1
        while end < len(s) and s[end].kind == TEXT:
            end += 1
            if "?" in s[end - 1].text:
                break
        return end if end > i + 1 else i

    return _groups(segs, take, lambda g: True)


def _fuse_queries(segs: list[Segment]) -> list[Segment]:
    def take(s: list[Segment], i: int) -> int:
        before = s[i - 1].text if i else ""
        if "?" not in before or not ("://" in before or before.startswith("www.")):
            return i
        end = i
        while end < len(s) and s[end].kind == TEXT:
            end += 1
        return end

    return _groups(segs, take, lambda g: True)


def _fuse_numbers(segs: list[Segment]) -> list[Segment]:
    def take(s: list[Segment], i: int) -> int:
        if s[i].kind != TEXT or not _numeric(s[i].text):
            return i
        end = i + 1
        while end < len(s) and s[end].kind == TEXT and _NUMERIC.fullmatch(s[end].text):
            end += 1
        return end

    return _groups(segs, take, lambda g: True)


def _split_hyphens(segs: list[Segment]) -> list[Segment]:
    out: list[Segment] = []
    for s in segs:
        parts = s.text.split("-") if s.kind == TEXT and "-" in s.text else []
        if parts and all(p and _numeric(p) for p in parts):
            at = s.start
            for k, p in enumerate(parts):
                p += "-" if k + 1 < len(parts) else ""
                out.append(Segment(p, True, TEXT, at))
                at += len(p)
        else:
            out.append(s)
    return out


def _fuse_chains(segs: list[Segment]) -> list[Segment]:
    def link(s: Segment) -> bool:
        return s.kind == TEXT and s.word and _chained(s.text)

    def take(s: list[Segment], i: int) -> int:
        if not link(s[i]):
            return i
        end = i + 1
        while end < len(s) and s[end - 1].text[-1] in ".,:;" and link(s[end]):
            end += 1
        return end if end > i + 1 else i

    return _groups(segs, take, lambda g: True)


def _carry_cjk_openers(segs: list[Segment]) -> list[Segment]:
    for a, b in zip(segs, segs[1:], strict=False):
        if a.kind == TEXT and b.kind == TEXT and is_cjk(a.text) and is_cjk(b.text):
            tail = _FORWARD_TAIL.search(a.text)
            if tail and tail.start():
                a.text, b.text, b.start = a.text[: tail.start()], tail.group() + b.text, a.start + tail.start()
    return segs


def _arabic_marks(segs: list[Segment]) -> list[Segment]:
    for a, b in zip(segs, segs[1:], strict=False):
        if a.kind in (SPACE, KEPT_SPACE) and b.kind == TEXT and _MARKED_SPACE.fullmatch(a.text) and _ARABIC.search(b.text):
            b.text, b.start, a.text = a.text[1:] + b.text, a.start + 1, " "
    return segs


def keep_all_groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts that keep-all does not part; a run may go on unless the text before ends in glue,
    prohibited punctuation or a dash."""
    start = 0
    for i in range(1, len(texts) + 1):
        if i == len(texts) or texts[i - 1][-1] in KEEP_ALL_GLUE + KINSOKU_START + LEFT_STICKY + KEEP_ALL_DASHES:
            if is_cjk("".join(texts[start:i])):
                yield start, i
            else:
                yield from ((k, k + 1) for k in range(start, i))
            start = i


def _keep_all(segs: list[Segment]) -> list[Segment]:
    out: list[Segment] = []
    i = 0
    while i < len(segs):
        end = i
        while end < len(segs) and segs[end].kind == TEXT:
            end += 1
        for a, b in keep_all_groups([s.text for s in segs[i:end]]) if end > i else ():
            group = segs[i + a : i + b]
            out.append(group[0] if len(group) == 1 else Segment("".join([s.text for s in group]), _any_word(group), TEXT, group[0].start))
        if end < len(segs):
            out.append(segs[end])
        i = end + 1
    return out


def _join_continuations(segs: list[Segment]) -> list[Segment]:
    out: list[Segment] = []
    for s in segs:
        if s.kind == TEXT and out and out[-1].kind == TEXT and _CONTINUATION.match(s.text):
            out[-1].text += s.text
            out[-1].word |= s.word
        else:
            out.append(s)
    return out


def analyse(text: str, keep_spaces: bool = False, keep_all: bool = False) -> list[Segment]:
    """Segments of a normalised text."""
    segs = _carry_openers(_glue_quotes(_gather(pieces(text, keep_spaces))))
    ascii_text = text.isascii()
    if not ascii_text:
        segs = _fuse_glue(segs)
    if "www." in text or "//" in text:
        segs = _fuse_queries(_fuse_urls(segs))
    if _DIGIT.search(text):
        segs = _split_hyphens(_fuse_numbers(segs))
    segs = _fuse_chains(segs)
    if not ascii_text:
        segs = _arabic_marks(_carry_cjk_openers(segs))
        if keep_all:
            segs = _keep_all(segs)
        segs = _join_continuations(segs)
    return segs


#: Units over the classes of clusters: openers p, characters that start no row s, others l; those with CJK are
#: P, S and K.  An opener takes the next cluster, s always stays, and only text without CJK runs on.
_UNIT = re.compile("P(?:.[Ss]*)?|p(?:[KPS][Ss]*|[lps]+(?:S[Ss]*)?)?|[KS][Ss]*|[ls][lps]*(?:S[Ss]*)?")


@_remember
def _unit_class(cluster: str) -> str:
    kind = "s" if cluster in KINSOKU_START + LEFT_STICKY else "p" if cluster in KINSOKU_END else "l"
    return {"s": "S", "p": "P", "l": "K"}[kind] if is_cjk(cluster) else kind


def _cjk_units(text: str) -> list[tuple[int, str]]:
    """(offset, text) of the units of a text with wide characters."""
    parts = clusters(text)
    ends = [0, *accumulate(map(len, parts))]
    found = (m.span() for m in _UNIT.finditer("".join(map(_unit_class, parts))))
    return [(ends[a], text[ends[a] : ends[b]]) for a, b in found]


class Prepared:
    """Segments ready for layout: parallel lists of texts, kinds, starts and breaks after."""

    __slots__ = ("source", "texts", "kinds", "starts", "breaks", "utf16")

    def __init__(self, source: str, texts: list[str], kinds: list[str], starts: list[int], breaks: list[bool]):
        self.source, self.texts, self.kinds, self.starts, self.breaks = source, texts, kinds, starts, breaks
        self.utf16 = None
        if not source.isascii() and max(source, default="") > "\uFFFF":
            at = self.utf16 = [0]
            for c in source:
                at.append(at[-1] + (2 if c > "\uFFFF" else 1))

    def offset(self, code_point: int) -> int:
        """The UTF-16 offset that stands for a code point offset."""
        return code_point if self.utf16 is None else self.utf16[min(code_point, len(self.utf16) - 1)]


Units = tuple[list[str], list[str], list[int], list[bool]]  # texts, kinds, starts, breaks after

_CHUNKS = regex.compile(r"[^ \t\n]+| +|\t|\n")
#: Characters that cling to white space before or after them, so that a text cannot be cut there.
_CLINGING = regex.compile(r"\r|[ \t\n][\p{M}\p{WB=Extend}\p{WB=Format}\p{WB=ZWJ}]| [\u1680\u2000-\u200A\u205F\u3000]|[\u1680\u2000-\u200A\u205F\u3000] ")
#: Chunks of one word, perhaps with punctuation that sticks to it: a segment each, whatever stands around them.
_ONE_WORD = re.compile("[A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+[.,!?;:]*")
#: Longer chunks are not remembered.
REMEMBERED = 48


def _units(source: str, keep_spaces: bool, keep_all: bool) -> Units:
    texts, kinds, starts, speaks = [], [], [], []
    for s in analyse(source, keep_spaces, keep_all):
        if s.kind == TEXT and not s.text.isascii() and any(is_wide(ord(c)) for c in s.text):
            units = _cjk_units(s.text)
            if keep_all:
                groups = list(keep_all_groups([u for _, u in units]))
                units = [(units[a][0], "".join([u for _, u in units[a:b]])) for a, b in groups]
            for at, unit in units:
                texts.append(unit)
                kinds.append(TEXT)
                starts.append(s.start + at)
                speaks.append(s.word or is_cjk(unit))
        else:
            texts.append(s.text)
            kinds.append(s.kind)
            starts.append(s.start)
            speaks.append(s.kind == TEXT and (s.word or is_cjk(s.text)))
    breaks = [a and b for a, b in zip(speaks, speaks[1:], strict=False)] + [False] * bool(speaks)
    return texts, kinds, starts, breaks


_remembered_units = functools.lru_cache(maxsize=1 << 16)(_units)


def prepare(source: str, keep_spaces: bool = False, keep_all: bool = False) -> Prepared:
    """Analyses a normalised source.

    No rule looks across white space, so a text is analysed chunk by chunk between it, and what is known
    about a chunk serves wherever it occurs again.  Texts whose white space carries marks, and tabs or line
    feeds that are not kept apart, are analysed as a whole.
    """
    if (not source.isascii() or "\r" in source) and _CLINGING.search(source) or (not keep_spaces and ("\t" in source or "\n" in source)):
        return Prepared(source, *_units(source, keep_spaces, keep_all))
    texts, kinds, starts, breaks = [], [], [], []
    white = {" ": KEPT_SPACE if keep_spaces else SPACE, "\t": TAB, "\n": HARD_BREAK}
    one_word, at = _ONE_WORD.fullmatch, 0
    for chunk in _CHUNKS.findall(source):
        if (kind := white.get(chunk[0])) is not None:
            texts.append(chunk)
            kinds.append(kind)
            starts.append(at)
            breaks.append(False)
        elif one_word(chunk):
            texts.append(chunk)
            kinds.append(TEXT)
            starts.append(at)
            breaks.append(False)
        else:
            own = (_remembered_units if len(chunk) <= REMEMBERED else _units)(chunk, keep_spaces, keep_all)
            texts += own[0]
            kinds += own[1]
            starts += [at + x for x in own[2]] if len(own[2]) > 1 else (at,)
            breaks += own[3]
        at += len(chunk)
    return Prepared(source, texts, kinds, starts, breaks)
