"""The further queries over small tables, against plain Python where their SQL is worth a second look."""

import hashlib

import pytest

from gridloom.plans import more, registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("more")
    texts = {1: "the cat and the dog\nsat on it", 2: "", 3: "Éa\nb\n", 4: "word " * 60 + "end"}
    rows = [(i, t, "en") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{top}/documents.parquet")
    turns = [(7, 0, "user", "one the "), (7, 1, "assistant", " two of three"), (8, 0, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return str(top), texts


def test_queries_and_oracles_have_the_same_names():
    assert set(more.QUERIES) == set(more.ORACLES) and set(registry.QUERIES) == set(registry.ORACLES)
    assert not set(more.QUERIES) & set(registry.QUERIES)


def test_widths_and_rows_of_injected_characters(spark, tables):
    top, texts = tables
    letters = {i: "".join(c if c in "abcdefghijklmnopqrstuvwxyz \n" else "x" for c in t) for i, t in texts.items()}
    found = {r.doc_id: (r.width, r.narrow) for r in more.text_width_wide(spark, top).collect()}
    assert found == {i: (sum({"a": 2, "i": 2, "o": 0}.get(c, 1) for c in t), sum({"a": 2, "o": 0}.get(c, 1) for c in t)) for i, t in letters.items()}
    rows = [r for r in more.walk_cjk(spark, top).collect() if r.doc_id == 4]
    assert sum(r.width for r in rows) == 2 * len(texts[4]) and max(r.width for r in rows) == 40
    (last,) = [r for r in more.append_sources(spark, top).collect() if r.doc_id == 7]
    assert (last.generation, last.text_md5) == (1, hashlib.md5(b"one the  two of three").hexdigest())
    told = {r.doc_id: r.text_md5 for r in more.append_normalised(spark, top).collect()}
    assert told == {7: hashlib.md5(b"one the two of three").hexdigest(), 8: hashlib.md5(b"").hexdigest()}


def test_cursors_are_found_without_a_row_for_each_boundary(spark, tables):
    top, _ = tables
    for query in (registry.cursor_for_offset_documents, more.cursor_round_trip, more.project_cursors):
        plan = query(spark, top)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "MapInArrow" in plan


def test_cursors_at_texts_are_those_of_their_boundaries(spark):
    from gridloom.operators import layout, projection, rows

    docs = spark.createDataFrame([(1, "ab é \U0001F468‍\U0001F469x\ncd\n"), (2, "世\U00020000界 a-b"), (3, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(i, o) for i in (1, 2, 3) for o in range(-1, 20)], "doc_id long, offset int")
    marks, told = layout.clusters(docs, more.KEPT), lambda f: sorted(map(tuple, f.collect()))
    for bias in projection.BIASES:
        found = projection.snap_offset(docs, asked, bias, more.KEPT)
        assert told(found) == told(projection.cursor_for_offset(marks, asked, bias))
    at = spark.createDataFrame([(i, (s, g)) for i in (1, 2, 3) for s in range(9) for g in range(3)], "doc_id long, cursor struct<seg:int,g:int>")
    held = rows.row_for_cursor(layout.walk(docs, 3, options=more.KEPT), at).select("doc_id", "cursor", "row")
    want = projection.offset_for_cursor(marks, at).join(held, ["doc_id", "cursor"]).select("doc_id", "cursor", "src_offset", "row")
    assert told(projection.locate_cursor(docs, at, 3, options=more.KEPT)) == told(want)


def test_segments_of_all_kinds_of_texts_are_told_alike(spark):
    from gridloom.functions import segment
    from gridloom.operators import layout

    texts = {1: "ab Éa c­­d​世\t\n" * 9, 2: "世界­ ​x " * 12, 3: "ab, (c) אב 3.5", 4: "a\U0001F600 b"}
    texts[1] = texts[1].replace("世", "")
    texts[2] = texts[2].replace("​x", "​")
    found = layout.prepare(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), more.KEPT).collect()
    for r in found:
        want = segment.Prepared(texts[r.doc_id], *segment._units(texts[r.doc_id], True, False))
        told = [(s.text, s.kind, s.src_start, s.break_after) for s in r.segments]
        assert told == list(zip(want.texts, want.kinds, map(want.offset, want.starts), want.breaks, strict=True))
        assert {s.level is None for s in r.segments} == {r.doc_id != 3}
