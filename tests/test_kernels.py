"""Golden cases, invariants and seeded fuzz of the layout kernels."""

import random
import time

import pytest

from gridloom.functions import ansi, bidi, segment, width, wrap
from gridloom.operators.projection import Projector
from gridloom.sources import text as source
from gridloom.streaming import flow


def layout(text, white_space="normal", keep_all=False, tab=None, **profile):
    return wrap.Layout(segment.prepare(source.normalise(text, white_space), white_space == "pre-wrap", keep_all), width.WidthProfile(**profile), tab)


@pytest.mark.parametrize(
    ("text", "profile", "cells"),
    [
        ("AB", {}, 2), ("你好", {}, 4), ("§±", {}, 2), ("§±", {"ambiguous": "wide"}, 4), ("😀", {}, 2), ("😀", {"emoji": "narrow"}, 1),
        ("\U0001f1e6", {}, 2), ("\U0001f1e6", {"regional": "flag-pair-wide-single-narrow"}, 1), ("1️⃣", {}, 2), ("é", {}, 1),
        ("​", {}, 0), ("👩‍💻", {}, 2), ("", {}, 0), ("©", {}, 2), ("©︎", {}, 1), ("\t", {"controls": "replacement"}, 1),
    ],
)
def test_widths(text, profile, cells):
    assert width.text_width(text, width.WidthProfile(**profile)) == cells


@pytest.mark.parametrize("text", ["a\tb", "\x1b", "a‮b"])
def test_controls_are_rejected(text):
    with pytest.raises(ValueError):
        width.text_width(text)


def test_injected_widths():
    profile = width.injected_profile("double", lambda c: 2)
    assert width.text_width("abc", profile) == 6
    with pytest.raises(ValueError):
        width.text_width("abc", width.injected_profile("bad", lambda c: -1))
    assert [r.width for r in wrap.Layout(segment.prepare("abcd"), profile).rows(4)] == [4, 4]


# Texts, options and the rows that must come of them.
CASES = [
    ("one two three four five six", {}, (9, 0), ["one two", "three", "four", "five six"]),
    ("abc def ghi", {}, (8, 5), ["abc", "def ghi"]),
    ("abc\td", {"white_space": "pre-wrap", "tab": 4}, (6, 1), ["abc", "    d"]),
    ("trans­atlantic", {}, (6, 0), ["trans-", "atlant", "ic"]),
    ("你", {}, (1, 0), ["你"]),
    ("가나다 라마바", {"keep_all": True}, (5, 0), ["가나", "다", "라마", "바"]),
    ("a\n\nb", {"white_space": "pre-wrap"}, (9, 0), ["a", "", "b"]),
    ("abc\n", {"white_space": "pre-wrap"}, (9, 0), ["abc"]),
    ("", {}, (9, 0), []),
    ("​​", {}, (9, 0), [""]),
]


@pytest.mark.parametrize(("text", "prepare", "at", "rows"), CASES)
def test_rows(text, prepare, at, rows):
    lay = layout(text, **prepare)
    assert [lay.texts(r)[0] for r in lay.rows(*at)] == rows


def plain_end(lay, start, columns, column):
    """The end of a row by trying every cluster boundary: all that fits, else the last place to break, else a cut."""
    p = lay.prepared
    spots = [(i, g) for i in range(len(p.texts)) for g in range(lay.count(i))] + [(len(p.texts), 0)]
    spots = spots[spots.index(start) :]
    cells, content, room, full, breaks = [column], [False], columns - column, None, []
    for n, (i, g) in enumerate(spots[:-1]):
        kind = p.kinds[i]
        if kind == "hard-break":
            full = full or ("hard", n)
            break
        bare = kind in ("zero-width-break", "soft-hyphen")
        step = 0 if bare else width.tab_advance(cells[-1], lay.tab) if kind == "tab" else lay.widths(i)[g]
        cells.append(cells[-1] + step)
        content.append(content[-1] or not bare)
        if not bare and cells[-1] - column > room:
            full = ("cut", n)
            break
        last = spots[n + 1][1] == 0
        if bare and content[n] and (kind != "soft-hyphen" or cells[n] - column + lay.hyphen <= room):
            breaks.append(n + 1)
        if kind in ("space", "preserved-space", "tab") or (kind == "text" and last and p.breaks[i]):
            breaks.append(n + 1)
    if full is None:
        return spots[-1]
    kind, n = full
    if kind == "hard":
        return spots[n][0] + 1, 0
    return spots[max(breaks) if breaks else n if content[n] else n + 1]


def test_rows_end_where_a_plain_search_ends_them():
    r = random.Random(77)
    buckets = BUCKETS + [["­­", "​​", "\t\t", "   ", "a", "bc"]]
    for _ in range(500):
        text = "".join(r.choice(r.choice(buckets)) for _ in range(r.randint(1, 25)))
        mode, columns, first = r.choice(["normal", "pre-wrap"]), r.choice([1, 2, 3, 4, 7, 12, 30]), r.choice([0, 0, 2, 9])
        lay = layout(text, mode, r.random() < 0.3, r.choice([1, 2, 4, 8]))
        for row in lay.rows(columns, first):
            if lay.prepared.kinds[row.start[0]] not in ("space", "zero-width-break", "soft-hyphen") or row.start[1]:
                assert row.end == plain_end(lay, row.start, columns, row.start_column), (text, mode, columns, row)


def test_chunks_are_analysed_as_in_the_whole_text():
    r = random.Random(8)
    buckets = BUCKETS + [["\"a", "(b)", "x.", "don't", "3.14", "12:30", "e-mail", "—", "?"], ["　", "́", "‍", " "]]
    for _ in range(600):
        text = "".join(r.choice(r.choice(buckets)) for _ in range(r.randint(0, 40)))
        keep, keep_all = r.random() < 0.5, r.random() < 0.3
        p = segment.prepare(text, keep, keep_all)
        assert (p.texts, p.kinds, p.starts, p.breaks) == segment._units(text, keep, keep_all), text


def test_long_rows_take_time_in_proportion():
    def seconds(n):
        text = "".join(f"\x1b[3{k % 8}mab cd\x1b[0m ef" for k in range(n))
        rich = ansi.tokenize(text, "pre-wrap", ansi.Policy(max_input=10**7, max_spans=10**6, max_diagnostics=10**6))
        began = time.process_time()
        lay = wrap.Layout(segment.prepare(rich.visible, True))
        (row,) = lay.rows(10**7)
        assert len(ansi.fragments(lay, row, rich.spans)[0]) == 2 * n
        p = Projector(lay, 10**7, 0)
        assert p.cell(0, len(rich.visible) // 2)[3] == len(rich.visible) // 2 and p.offset(9 * n // 2)[1] == 9 * n // 2
        return time.process_time() - began

    seconds(200)
    assert seconds(12_000) < 40 * seconds(1200) + 0.5  # 10 times the length; a square would be 100 times the time


def test_overflow_and_breaks():
    (row,) = layout("你").rows(1)
    assert (row.width, row.overflow, row.break_kind) == (2, 2, "end")
    assert [r.break_kind for r in layout("a\n\nb", "pre-wrap").rows(5)] == ["hard", "hard", "end"]
    assert [r.break_kind for r in layout("trans­atlantic").rows(6)] == ["soft-hyphen", "wrap", "end"]


def texts(text, **kind):
    return [(s.text, s.kind) for s in segment.analyse(text, **kind)]


@pytest.mark.parametrize(
    ("text", "segments"),
    [
        ("see https://a.b/c?x=1&y z", ["see", " ", "https://a.b/c?", "x=1&y", " ", "z"]),
        ("www.x.org/a-b c", ["www.x.org/a-b", " ", "c"]),
        ("at 8:30-4:30.", ["at", " ", "8:30-", "4:30."]),
        ("(hello) \"you\"", ["(hello)", " ", '"you"']),
        ("well-known -x", ["well-", "known", " ", "-", "x"]),
        ("foo;bar:baz", ["foo;", "bar:baz"]),
        ("a b c", ["a b", " ", "c"]),
        ("wait...what ...", ["wait...what", " ", "..."]),
        ("don't stop", ["don't", " ", "stop"]),
        ("x----y", ["x----", "y"]),
    ],
)
def test_break_rules(text, segments):
    assert [t for t, _ in texts(text)] == segments


def test_kinds_of_breaks():
    assert texts("a  b\tc\nd", keep_spaces=True) == [("a", "text"), ("  ", "preserved-space"), ("b", "text"), ("\t", "tab"), ("c", "text"), ("\n", "hard-break"), ("d", "text")]
    assert [k for _, k in texts("a​b­c")] == ["text", "zero-width-break", "text", "soft-hyphen", "text"]


BUCKETS = [["hello", "wrap", "a", "supercalifragilistic"], [" ", "  ", "\n", "\t", "\r\n", "\f"], ["你好", "（世界）", "カタカナー。", "한국어"], ["مرحبا،", "שלום", "नमस्ते", "आप"],
           ["😀", "👩‍💻", "🇺🇸", "1️⃣", "é"], ["​", "­", " ", "⁠", " "], ["https://e.test/a?b=c", "/usr/lib/x.py", "8:30-4:30", "(x)", "\"q\"", "--"]]


def test_invariants_of_random_texts():
    r = random.Random(20)
    for _ in range(400):
        text = "".join(r.choice(r.choice(BUCKETS)) for _ in range(r.randint(1, 36)))
        mode, keep_all, tab = r.choice(["normal", "pre-wrap"]), r.random() < 0.3, r.choice([1, 2, 4, 8])
        lay = layout(text, mode, keep_all, tab, ambiguous=r.choice(["narrow", "wide"]))
        p = lay.prepared
        assert "".join(p.texts) == p.source and p.starts == [sum(map(len, p.texts[:i])) for i in range(len(p.texts))]
        columns, first = r.choice([1, 2, 3, 5, 12, 40, 80]), r.choice([0, 0, 0, 3])
        rows = list(lay.rows(columns, first))
        fresh = layout(text, mode, keep_all, tab, ambiguous=lay.profile.ambiguous)
        assert rows == list(fresh.rows(columns, first))
        at = 0
        for n, row in enumerate(rows):
            assert lay.next_row(row.start, columns, row.start_column) == row
            a, b = lay.row_source(row)
            shown, told = lay.texts(row)
            assert told == p.source[a:b] and at <= a <= b
            at = b
            assert row.end > row.start and (row.overflow is None or row.start_column + row.width == row.overflow)
            if row.overflow is not None and row.break_kind != "soft-hyphen":
                assert row.start_column or len(lay.marks(row)) <= 3
            if "\t" not in told and mode == "normal":
                assert width.text_width(shown.replace("­", ""), lay.profile) == row.width or " " in told or " " in told or not shown
            assert [x for x, _ in lay.boundaries(row)] == sorted({x for x, _ in lay.boundaries(row)}) and n < 10_000
        if rows:
            assert rows[-1].end[0] >= len(p.texts)


def test_offsets_are_utf16():
    lay = layout("👩‍💻a b")
    (row,) = lay.rows(20)
    assert (row.src_start, row.src_end) == (0, 8)
    assert [x for x, _ in lay.boundaries(row)] == [0, 5, 6, 7, 8]


@pytest.mark.parametrize(
    ("text", "mode", "columns", "offset", "bias", "want"),
    [
        ("hello world", "normal", 16, 6, "closest", (0, 6, 6, True, False)),
        ("éf", "normal", 8, 1, "before", (0, 0, 0, False, False)),
        ("éf", "normal", 8, 1, "after", (0, 1, 2, False, False)),
        ("abc\n", "pre-wrap", 8, 4, "closest", (1, 0, 4, True, True)),
        ("hi", "normal", 8, 99, "closest", (0, 2, 2, False, True)),
        ("", "normal", 8, 0, "closest", (0, 0, 0, True, True)),
    ],
)
def test_offset_projection(text, mode, columns, offset, bias, want):
    row, column, _, at, exact, end, _ = Projector(layout(text, mode), columns, 0).offset(offset, bias)
    assert (row, column, at, exact, end) == want


def test_cells_and_offsets_round_trip():
    r = random.Random(3)
    for _ in range(60):
        text = " ".join(r.choice(["alpha", "beta", "你好", "z"]) for _ in range(r.randint(1, 15)))
        p = Projector(layout(text), 9, 0)
        for n, row in enumerate(p.rows):
            for x, c in p.layout.boundaries(row)[:-1]:
                assert p.cell(n, c)[3] == x and p.offset(x)[:2] == (n, c)
        assert "".join(p.extract(0, len(text))[0]) == text


def test_ansi_goldens_and_security():
    esc = "\x1b"
    assert ansi.tokenize(f"{esc}[31mab{esc}[0mc").spans == [("style", 5, 7, 0, 2, {"fg": "ansi:31"})]
    linked = ansi.tokenize(f"go {esc}]8;;https://e.test{esc}\\there{esc}]8;;\x07 x")
    assert linked.visible == "go there x" and [s[0] for s in linked.spans] == ["link"]
    for raw, code in [
        ("a\x1b[2Kb", "csi-unsupported"), ("\x1b[31", "csi-malformed"), ("\x1b[38;7mx", "sgr-unsupported-color"), ("\x1b[?1mx", "sgr-malformed-payload"),
        ("\x1b]0;t\x07", "osc-unsupported"), ("\x1b]0;t", "osc-malformed"), ("\x1b]8;x\x07", "osc8-malformed"), ("\x1bPq\x1b\\", "dcs-unsupported"), ("\x9fx", "apc-malformed"),
        ("\x9b2K", "c1-csi-unsupported"), ("\x9dx\x9c", "c1-osc-unsupported"), ("\x07", "c0-control"), ("\x85", "c1-control"), ("‮", "bidi-format-control"),
        ("\x1b(B", "escape-unsupported"), ("\x1bc", "escape-unsupported"), ("\x1b(", "escape-malformed"), ("\x1b]8;;javascript:x\x07", "osc8-uri-scheme-denied"),
        ("\x1b]8;;https://u@h\x07", "osc8-uri-credentials-denied"), ("\x1b]8;;nope\x07", "osc8-uri-not-absolute"),
    ]:
        assert [d["code"] for d in ansi.tokenize(raw).diagnostics] == [code], raw
        with pytest.raises(ValueError):
            ansi.tokenize(raw, policy=ansi.Policy.of("audit-strict"))
    long = ansi.tokenize("a\x1b[" + "1;" * 9000 + "mb")
    assert long.visible == "a" and [d["code"] for d in long.diagnostics] == ["control-sequence-too-long"]
    assert ansi.sgr_params("38:2::1:2:3;4:3;;1") == [38, 2, 1, 2, 3, 4, 0, 1]
    assert ansi.fingerprint("") == "811c9dc5"


def test_fragments_and_reemission():
    rich = ansi.tokenize("\x1b[1;31mred\x1b[0m and \x1b]8;;https://e.test\x07link\x1b]8;;\x07 end")
    lay = wrap.Layout(segment.prepare(rich.visible))
    (row,) = lay.rows(40)
    parts, told = ansi.fragments(lay, row, rich.spans, "sgr-osc8")
    assert [(p[0], p[4], p[5]) for p in parts] == [("red", 0, 3), (" and ", 3, 8), ("link", 8, 12), (" end", 12, 16)]
    assert told == "\x1b[1;31mred\x1b[0m and \x1b]8;;https://e.test\x1b\\link\x1b]8;;\x1b\\ end"


@pytest.mark.parametrize("mode", ["normal", "pre-wrap"])
def test_appends_equal_one_text(mode):
    r = random.Random(4)
    for _ in range(40):
        parts = ["".join(r.choices(["word ", "x", "\r", "\n", "\r\n", " ", "\t", "é", "👩‍💻", "longerword"], k=r.randint(0, 60))) for _ in range(12)]
        state, got, before = flow.FlowState(), "", 0
        for n, part in enumerate(parts):
            generation, previous, appended, stable, invalid, invalidated, _, strategy, added = flow.append(state, part, mode)
            assert (generation, previous, stable) == (n, n - 1 if n else None, before)
            got += added
            before = flow.units(got)
            assert 0 <= invalid <= stable and invalidated == before - invalid and appended == flow.units(part) and strategy
            assert state.length == before and got.endswith(state.open_source)
        whole = source.normalise("".join(parts), mode)
        assert got == whole


@pytest.mark.parametrize(
    ("text", "levels"),
    [("abc", None), ("אב", [1, 1]), ("a אב", [0, 0, 1, 1]), ("א a", [1, 1, 2]), ("א 12", [1, 1, 2, 2]), ("a אב 1", [0, 0, 1, 1, 1, 2]), ("عر 1,2", [1, 1, 1, 2, 2, 2])],
)
def test_levels(text, levels):
    assert bidi.levels(text) == levels


def test_batches_follow_the_texts_and_not_their_number(spark):
    import pyarrow as pa

    from gridloom.operators import kernel

    class Frame:
        mapInArrow = staticmethod(lambda run, kind: run)

    def rows_of(lay, row):
        yield row["doc_id"], list(lay.prepared.texts)

    run = kernel.run_kernel(Frame(), "doc_id long, texts array<string>", rows_of, kernel.Options())
    texts = ["a b " * 500 + str(k) for k in range(900)]
    found = list(run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(900)), "text": texts})])))
    assert max(len(b.column(1).flatten()) for b in found) <= kernel.OUT_CHARS + 2001
    assert [i for b in found for i in b.column(0).to_pylist()] == list(range(900))


@pytest.mark.parametrize("letters", ["ab|c|Éa|12| | |\n", "a|b|­|​| |xyz", "世|界|\n| ", "世|­|​| |\n", "ab| |​|­­|\t|  |\n|3"])
def test_dense_texts_are_laid_out_as_others(letters, monkeypatch):
    from gridloom.functions import dense

    monkeypatch.setattr(dense, "LEAST", 1)
    r, names = random.Random(3), ("start", "start_g", "end", "end_g", "src_start", "src_end", "width", "kind")
    for _ in range(150):
        text, keep = "".join(r.choice(letters.split("|")) for _ in range(r.randint(1, 50))), r.random() < 0.5
        text = text if keep else " ".join(text.replace("\t", " ").replace("\n", " ").split(" ")).strip(" ")
        if not text:
            continue
        found, units = dense.prepare(text, keep), segment._units(text, keep, False)
        assert (found.texts, found.kinds, found.starts, found.breaks) == units, text
        plain, lay = wrap.Layout(segment.Prepared(text, *units)), wrap.Layout(found)
        assert plain.before == lay.before
        for c in (1, 2, 3, 5, 8, 12):
            if (told := dense.rows(lay, c, 0)) is None:
                assert "\t" in text
                continue
            rows = list(plain.rows(c, 0))
            flat = [(*x.start, *x.end, x.src_start, x.src_end, x.width, dense.ENDS.index(x.break_kind)) for x in rows]
            assert list(zip(*(getattr(told, n).tolist() for n in names), strict=True)) == flat, (text, c)
            assert list(zip(*told.texts(), strict=True)) == [plain.texts(x) for x in rows], (text, c)
