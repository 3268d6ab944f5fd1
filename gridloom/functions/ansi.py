"""Inline ANSI: visible text, style and link spans, and redacted diagnostics of everything else.

One pattern cuts a text into visible runs and control sequences.  Only SGR and OSC 8 have an effect;
other controls leave a diagnostic, or are an error under a rejecting policy.  Offsets are code points
here and become UTF-16 where rows are made.
"""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import regex

from gridloom.functions.width import text_width

BIDI = "\u061C\u200E\u200F\u202A-\u202E\u2066-\u2069"
_END = r"(?P<{0}>\x07|\x9C|\x1B\\)"
_TOKEN = regex.compile(
    rf"(?P<text>[^\x00-\x08\x0B\x0E-\x1F\x7F-\x9F{BIDI}]+)"
    r"|\x1B\[(?P<csi>[^\x40-\x7E]*)(?P<csi_end>[\x40-\x7E])?"
    r"|\x9B[^\x40-\x7E]*(?P<c1csi_end>[\x40-\x7E])?"
    r"|\x1B\](?P<osc>(?:(?!\x07|\x9C|\x1B\\).)*)" + _END.format("osc_end") + "?"
    r"|\x9D(?:(?!\x07|\x9C|\x1B\\).)*" + _END.format("c1osc_end") + "?"
    r"|(?P<str>\x1B[PX^_]|[\x90\x98\x9E\x9F])(?:(?!\x9C|\x1B\\).)*(?P<str_end>\x9C|\x1B\\)?"
    r"|\x1B[\x20-\x2F][^\x30-\x7E]*(?P<esc_end>[\x30-\x7E])?"
    r"|(?P<esc>\x1B.?)"
    rf"|(?P<bidi>[{BIDI}])"
    r"|(?P<control>[\x00-\x1F\x7F-\x9F])",
    regex.DOTALL,
)
_STRING_FAMILY = {"\x1bP": "dcs", "\x90": "dcs", "\x1bX": "sos", "\x98": "sos", "\x1b^": "pm", "\x9e": "pm", "\x1b_": "apc", "\x9f": "apc"}
_SCHEME = regex.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")


# The choices and limits of a policy, and the codes of diagnostics wherever this module tells one.
@dataclass(frozen=True)
class Policy:
    profile: str = "default"
    unsupported: str = "sanitize"  # or reject
    bidi: str = "sanitize"  # or reject
    raw_retention: str = "none"  # or fingerprint, capped-sample
    reemit: str = "sgr-osc8"  # or none, sgr
    schemes: tuple[str, ...] = ("https", "http", "mailto")
    credentials: bool = False
    max_uri: int = 2048
    max_diagnostics: int = 256
    sample: int = 0
    max_input: int = 2_000_000
    max_sequence: int = 8_192
    max_spans: int = 20_000
    max_raw_map: int = 200_000
    max_ansi_output: int = 1_000_000

    @staticmethod
    def of(profile: str = "default", **changes) -> Policy:
        """The policy of a profile, with changes."""
        profiles = {
            "default": Policy(),
            "transcript": Policy(profile="transcript", raw_retention="fingerprint", max_uri=4096, max_input=8_000_000, max_sequence=16_384),
            "audit-strict": Policy(profile="audit-strict", unsupported="reject", bidi="reject", reemit="none", schemes=("https",), max_uri=1024),
        }
        if profile not in profiles:
            raise ValueError(f"profile must be one of {sorted(profiles)}")
        return replace(profiles[profile], **changes)


def fingerprint(text: str) -> str:
    """32-bit FNV-1a over UTF-16 code units, eight hexadecimal digits."""
    value = 0x811C9DC5
    raw = text.encode("utf-16-le", "surrogatepass")
    for k in range(0, len(raw), 2):
        value = ((value ^ (raw[k] | raw[k + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return f"{value:08x}"


def escape_sample(text: str, limit: int) -> str:
    def shown(c: str) -> str:
        code = ord(c)
        if code <= 0x1F or 0x7F <= code <= 0x9F:
            return f"\\x{code:02X}"
        return f"\\u{code:04X}" if regex.match(f"[{BIDI}]", c) else c

    return "".join(map(shown, text[:limit]))


def uri_problem(uri: str, policy: Policy) -> str | None:
    """Why a link target is refused, or None."""
    if not uri:
        return None
    if len(uri) > policy.max_uri:
        return "osc8-uri-too-long"
    if regex.search(r"[\x00-\x1F\x7F-\x9F]", uri):
        return "osc8-uri-control"
    if regex.search(f"[{BIDI}]", uri):
        return "osc8-uri-bidi-format-control"
    scheme = _SCHEME.match(uri)
    if scheme is None:
        return "osc8-uri-not-absolute"
    if scheme.group(1).lower() not in policy.schemes:
        return "osc8-uri-scheme-denied"
    rest = uri[scheme.end() :]
    if not policy.credentials and rest.startswith("//") and "@" in regex.split("[/?#]", rest[2:], maxsplit=1)[0]:
        return "osc8-uri-credentials-denied"
    return None


_FLAGS = {1: "bold", 2: "dim", 3: "italic", 4: "underline", 7: "inverse", 9: "strikethrough"}
_CLEARS = {22: ("bold", "dim"), 23: ("italic",), 24: ("underline",), 27: ("inverse",), 29: ("strikethrough",), 39: ("fg",), 49: ("bg",)}


def sgr_params(payload: str) -> list[int] | None:
    out: list[int] = []
    for token in payload.split(";"):
        parts = token.split(":")
        if parts[0] in ("38", "48") and len(parts) > 1:
            if parts[1] in ("2", "5") and len(parts) > 2 and parts[2] == "":
                del parts[2]
        elif len(parts) > 1:
            parts = parts[:1]
        elif token == "":
            parts = ["0"]
        if not all(p.isdigit() for p in parts):
            return None
        out += map(int, parts)
    return out


def apply_sgr(style: dict, params: list[int]) -> dict | None:
    """The style after the codes, or None if a colour is malformed."""
    out = dict(style)
    codes = iter(params)
    for code in codes:
        if code == 0:
            out.clear()
        elif code in _FLAGS:
            out[_FLAGS[code]] = True
        elif code in _CLEARS:
            for name in _CLEARS[code]:
                out.pop(name, None)
        elif 30 <= code <= 37 or 90 <= code <= 97:
            out["fg"] = f"ansi:{code}"
        elif 40 <= code <= 47 or 100 <= code <= 107:
            out["bg"] = f"ansi:{code}"
        elif code in (38, 48):
            kind = next(codes, None)
            count = {5: 1, 2: 3}.get(kind, 0)
            values = [v for _, v in zip(range(count), codes, strict=False)]
            if not count or len(values) < count:
                return None
            out["fg" if code == 38 else "bg"] = f"ansi256:{values[0]}" if kind == 5 else "rgb:" + ",".join(map(str, values))
    return out


def style_codes(style: dict) -> str:
    """The SGR sequence that sets a style."""
    codes = [str(code) for code, name in _FLAGS.items() if style.get(name)]
    fg, bg = style.get("fg") or "", style.get("bg") or ""
    for prefix, lead in (("ansi256:", "5"), ("rgb:", "2")):
        for value, target in ((fg, "38"), (bg, "48")):
            if value.startswith(prefix):
                codes += [target, lead, *value[len(prefix) :].split(",")]
    codes += [v[5:] for v in (fg, bg) if v.startswith("ansi:")]
    return f"\x1b[{';'.join(codes)}m" if codes else ""


@dataclass
class Rich:
    """A tokenized text.  Spans are (kind, raw start, raw end, start, end, style or uri)."""

    visible: str = ""
    spans: list[tuple] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)
    raw_map: list[tuple[int, int, int, int]] = field(default_factory=list)
    diagnostics_truncated: bool = False
    spans_truncated: bool = False
    raw_map_truncated: bool = False


class _Reader:
    def __init__(self, raw: str, policy: Policy):
        self.raw, self.policy, self.out = raw, policy, Rich()
        self.parts: list[str] = []
        self.size = 0
        self.style: dict = {}
        self.link: str | None = None

    def tell(self, kind: str, code: str, family: str, start: int, end: int, reject: bool | None = None) -> None:
        p, sequence = self.policy, self.raw[start:end]
        if len(self.out.diagnostics) >= p.max_diagnostics:
            self.out.diagnostics_truncated = True
        else:
            sample = escape_sample(sequence, p.sample) if p.sample else None
            self.out.diagnostics.append(
                {"kind": kind, "code": code, "family": family, "raw_start": start, "raw_end": end, "raw_length": max(0, end - start),
                 "sample": sample, "sample_truncated": len(sequence) > p.sample, "fingerprint": fingerprint(sequence), "redacted": True, "profile": p.profile}
            )
        if p.unsupported == "reject" if reject is None else reject:
            raise ValueError(f"{code} at {start} is not allowed")

    def show(self, start: int, end: int) -> None:
        at, self.size = self.size, self.size + end - start
        self.parts.append(self.raw[start:end])
        if len(self.out.raw_map) < self.policy.max_raw_map:
            self.out.raw_map.append((start, end, at, self.size))
        elif not self.out.raw_map_truncated:
            self.out.raw_map_truncated = True
            self.tell("limit-exceeded", "raw-visible-map-limit", "raw-map", start, end)
        for kind, value in (("style", dict(self.style) or None), ("link", self.link)):
            if value is None:
                continue
            if len(self.out.spans) < self.policy.max_spans:
                self.out.spans.append((kind, start, end, at, self.size, value))
            elif not self.out.spans_truncated:
                self.out.spans_truncated = True
                self.tell("limit-exceeded", "span-limit", "span", start, end)

    def read(self) -> Rich:
        limit = self.policy.max_sequence
        for m in _TOKEN.finditer(self.raw):
            start, end = m.span()
            if m.group("text") is not None:
                self.show(start, end)
                continue
            g = m.groupdict()
            stop = next((m.start(k) for k in ("csi_end", "c1csi_end", "osc_end", "c1osc_end", "str_end", "esc_end") if g[k] is not None), end)
            if end - start > limit:
                family = self._family(g, m.group())
                if stop - start > limit:
                    # The terminator is out of reach: the rest of the input is discarded.
                    self.tell("limit-exceeded", "control-sequence-too-long", "csi" if family == "sgr" else family, start, min(len(self.raw), start + limit + 1))
                    break
                self.tell("limit-exceeded", "control-sequence-too-long", family, start, end)
                continue
            self._control(m, g, start, end)
        self.out.visible = "".join(self.parts)
        return self.out

    @staticmethod
    def _family(g: dict, sequence: str) -> str:
        if g["csi"] is not None:
            return "sgr" if g["csi_end"] == "m" else "csi"
        if g["str"] is not None:
            return _STRING_FAMILY[g["str"]]
        return "csi" if sequence[0] == "\x9b" else "osc" if g["osc"] is not None or sequence[0] == "\x9d" else "esc"

    def _control(self, m, g: dict, start: int, end: int) -> None:
        sequence = m.group()
        if g["csi"] is not None:
            if g["csi_end"] is None:
                self.tell("malformed-sequence", "csi-malformed", "csi", start, end)
            elif g["csi_end"] != "m":
                self.tell("unsupported-control", "csi-unsupported", "csi", start, end)
            elif not regex.fullmatch("[0-9;:]*", g["csi"]):
                self.tell("malformed-sequence", "sgr-malformed-payload", "sgr", start, end)
            elif (params := sgr_params(g["csi"])) is None:
                self.tell("malformed-sequence", "sgr-malformed-params", "sgr", start, end)
            elif (style := apply_sgr(self.style, params)) is None:
                self.tell("malformed-sequence", "sgr-unsupported-color", "sgr", start, end)
            else:
                self.style = style
        elif g["osc"] is not None:
            self._osc(g, start, end)
        elif g["str"] is not None:
            family = _STRING_FAMILY[g["str"]]
            ended = g["str_end"] is not None
            self.tell("unsupported-control" if ended else "malformed-sequence", f"{family}-{'unsupported' if ended else 'malformed'}", family, start, end)
        elif g["bidi"] is not None:
            self.tell("policy-violation", "bidi-format-control", "bidi-format", start, end, reject=self.policy.bidi == "reject")
        elif g["control"] is not None:
            low = sequence <= "\x1f"
            self.tell("unsupported-control", "c0-control" if low else "c1-control", "c0" if low else "c1", start, end)
        elif sequence[0] == "\x9b":
            self.tell("unsupported-control", "c1-csi-unsupported", "csi", start, end)
        elif sequence[0] == "\x9d":
            ended = g["c1osc_end"] is not None
            self.tell("unsupported-control" if ended else "malformed-sequence", "c1-osc-unsupported" if ended else "c1-osc-malformed", "osc", start, end)
        else:
            open_end = g["esc"] is None and g["esc_end"] is None
            self.tell("malformed-sequence" if open_end else "unsupported-control", "escape-malformed" if open_end else "escape-unsupported", "esc", start, end)

    def _osc(self, g: dict, start: int, end: int) -> None:
        parts = g["osc"].split(";", 2)
        if g["osc_end"] is None:
            self.tell("malformed-sequence", "osc-malformed", "osc", start, end)
        elif parts[0] != "8":
            self.tell("unsupported-control", "osc-unsupported", "osc", start, end)
        elif len(parts) < 3:
            self.link = None
            self.tell("malformed-sequence", "osc8-malformed", "osc8", start, end)
        else:
            problem = uri_problem(parts[2], self.policy)
            self.link = None if problem else parts[2] or None
            if problem:
                self.tell("policy-violation", problem, "osc8", start, end)


_BLANK = regex.compile("[ \t\n\r\f]+")


def normalise_with_map(text: str, white_space: str) -> tuple[str, list[int]]:
    """The normalised text and where each offset of the text (its end included) comes to lie."""
    out, at, where = [], 0, []
    if white_space == "pre-wrap":
        for m in regex.finditer(r"\r\n|[\r\f]|[^\r\f]+", text):
            piece = m.group()
            if piece[0] in "\r\f":
                where += [at] * len(piece)
                out.append("\n")
                at += 1
            else:
                where += range(at, at + len(piece))
                out.append(piece)
                at += len(piece)
        return "".join(out), [*where, at]
    for m in regex.finditer("[ \t\n\r\f]+|[^ \t\n\r\f]+", text):
        piece = m.group()
        if _BLANK.match(piece):
            where += [at] * len(piece)
            if at and m.end() < len(text):
                out.append(" ")
                at += 1
        else:
            where += range(at, at + len(piece))
            out.append(piece)
            at += len(piece)
    return "".join(out), [*where, at]


def tokenize(raw: str, white_space: str = "normal", policy: Policy = Policy()) -> Rich:
    """Spans and the raw map of the result lie on the normalised visible text."""
    if len(raw) > policy.max_input:
        raise ValueError("the input is longer than the policy allows")
    found = _Reader(raw, policy).read()
    found.visible, where = normalise_with_map(found.visible, white_space)
    found.spans = [(k, a, b, where[s], where[e], v) for k, a, b, s, e, v in found.spans if where[e] > where[s]]
    found.raw_map = [(a, b, where[s], where[e]) for a, b, s, e in found.raw_map]
    return found


class SpanIndex:
    """Spans of each kind by their start; those of one kind never overlap, so their ends are sorted too."""

    def __init__(self, spans: list[tuple]):
        self.of = {}
        for kind in ("style", "link"):
            own = sorted((s for s in spans if s[0] == kind), key=lambda s: s[3])
            self.of[kind] = own, [s[3] for s in own], [s[4] for s in own]

    def over(self, kind: str, lo: int, hi: int) -> list[tuple]:
        """Spans that share something with a source range."""
        own, starts, ends = self.of[kind]
        return own[bisect_right(ends, lo) : bisect_left(starts, hi)]


def fragments(layout, row, spans: SpanIndex | list[tuple], reemit: str = "none", limit: int = 1_000_000) -> tuple[list[tuple], str | None]:
    """Pieces of a row between span edges: (text, source text, start, end, first column, end column, style,
    link), and the row's text with sequences if ``reemit`` asks for them."""
    index = spans if isinstance(spans, SpanIndex) else SpanIndex(spans)
    text, source = layout.texts(row)
    cells = layout.row_cells(row)
    a, b, marks = cells.first, cells.last, cells.marks()
    met = {kind: index.over(kind, a, b) for kind in ("style", "link")}
    edges = sorted({a, b, *(max(a, s[3]) for own in met.values() for s in own), *(min(b, s[4]) for own in met.values() for s in own)})
    snapped = [marks[min(bisect_left(marks, e), len(marks) - 1)] for e in edges]
    out, told, column, shown, size = [], [], row.start_column, 0, 0
    at = dict.fromkeys(met, 0)
    for lo, hi in zip(snapped, snapped[1:], strict=False):
        if hi <= lo:
            continue
        piece, width = cells.clip(lo, hi)
        if not text.startswith(piece, shown):  # spaces that a wrapped row leaves out
            piece = os.path.commonprefix([piece, text[shown : shown + len(piece)]])
            width = text_width(piece, layout.profile)
        if not piece and not width:
            continue
        value = {}
        for kind, own in met.items():
            while at[kind] < len(own) and own[at[kind]][4] <= lo:
                at[kind] += 1
            value[kind] = own[at[kind]][5] if at[kind] < len(own) and own[at[kind]][3] < hi else None
        style, link = value["style"], value["link"]
        out.append((piece, source[lo - a : hi - a], lo, hi, column, column + width, style, link))
        column += width
        shown += len(piece)
        if reemit != "none":
            linked = link is not None and reemit == "sgr-osc8"
            new = [f"\x1b]8;;{link}\x1b\\" if linked else "", style_codes(style) if style else "", piece, "\x1b[0m" if style else "", "\x1b]8;;\x1b\\" if linked else ""]
            told += new
            size += sum(map(len, new))
            if size > limit:
                raise ValueError("text with sequences is longer than the policy allows")
    return out, "".join(told) if reemit != "none" else None


def spans_for_raw(rich: Rich, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Entries of the raw map that a raw range meets."""
    return (m for m in rich.raw_map if m[0] < end and m[1] > start)
