"""Registered queries over small tables, against plain Python."""

import hashlib

import pytest

from gridloom.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of up to 400 lines, longer than any benchmark text, and a few benchmark texts."""
    top = tmp_path_factory.mktemp("sf")
    docs = {i: "\n".join(f"line {k} of text {i}" for k in range(n)) for i, n in enumerate((1, 3, 9, 400), 1)}
    items = {1: "a b\nc", 2: "one"}
    spark.createDataFrame([(i, t, "en") for i, t in docs.items()], "doc_id long, text string, lang string").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), docs, items


def test_all_rows_are_materialized(spark, tables):
    top, docs, _ = tables
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    told = {(i, n, digest(t), digest(t)) for i, text in docs.items() for n, t in enumerate(text.split("\n"))}
    assert {tuple(r) for r in registry.QUERIES["materialize_all_rows"](spark, top).collect()} == told


def test_projections_and_widths_see_documents(spark, tables):
    top, docs, items = tables
    found = lambda name, *cols: {tuple(r) for r in registry.QUERIES[name](spark, top).select(*cols).collect()}
    lines = {(table, i, n, len(t)) for table, texts in (("documents", docs), ("benchmark", items)) for i, text in texts.items() for n, t in enumerate(text.split("\n"))}
    for name in ("text_width_narrow_all", "text_width_ambiguous_wide_all"):
        assert found(name, "source_table", "doc_id", "line", "width") == lines
    spots = {(i, o, min(o, len(t)), o <= len(t)) for i, t in docs.items() for o in (0, len(t) // 2, len(t), len(t) + 9)}
    for name in ("cursor_for_offset_documents", "project_offset_documents"):
        assert found(name, "doc_id", "offset", "src_offset", "exact") == spots
    middle = {i: t[len(t) // 4 : len(t) - len(t) // 4] for i, t in docs.items()}
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert found("selection_extract_documents", "doc_id", "source_md5") == {(i, digest(t)) for i, t in middle.items()}
    ranged = registry.QUERIES["project_range_documents"](spark, top).collect()
    assert {i: sum(r.src_end - r.src_start for r in ranged if r.doc_id == i) for i in docs} == {i: len(t.replace("\n", "")) for i, t in middle.items()}
    assert {r[0] for r in found("prepare_segments_documents", "doc_id")} == set(docs)


def test_selections_keep_empty_lines_at_their_ends(spark, tmp_path):
    texts = {1: "12345678\n\n\nab\n\n", 2: "123456789\nab", 3: "x" * 249 + "\n\nab", 4: "x" * 248 + "\n\nab", 5: "short", 6: "", 7: "123456789", 8: None, 9: "12345678\n"}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["selection_extract"](spark, str(tmp_path)).collect()}
    cut = {i: t and t[9:250] for i, t in texts.items()}
    assert found == {i: (t, t, None if t is None else t.count("\n") + 1) for i, t in cut.items()}


def test_a_selection_to_the_end_of_a_wrapped_row_has_no_empty_row(spark):
    from gridloom.functions.segment import prepare
    from gridloom.functions.wrap import Layout
    from gridloom.operators.projection import Projector

    p = Projector(Layout(prepare("abcdefgh\n\nij", keep_spaces=True)), 4, 0)
    assert [p.extract(a, b, True)[1] for a, b in ((0, 4), (4, 8), (0, 9), (0, 10), (9, 12), (2, 2))] == [["abcd"], ["efgh"], ["abcd", "efgh", ""], ["abcd", "efgh", "", ""], ["", "ij"], [""]]
    assert [p.extract(a, b)[1] for a, b in ((0, 10), (9, 12), (2, 2))] == [["abcd", "efgh"], ["ij"], []]
