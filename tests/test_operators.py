"""DataFrame operators over small tables."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import layout, projection, ranges, rich, rows, search, telemetry
from gridloom.operators.kernel import Options
from gridloom.sources import text as source
from gridloom.streaming import flow

KEPT = Options(white_space="pre-wrap")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "one two three four five six"), (2, ""), (3, "a\n\nb"), (4, None), (5, "你好 world")], "doc_id long, text string")


def test_walk_and_stats(docs):
    found = layout.walk(docs, 9, texts=True).collect()
    assert [r.text for r in found if r.doc_id == 1] == ["one two", "three", "four", "five six"]
    assert {r.doc_id: (r.rows, r.max_line_width) for r in layout.line_stats(docs, 9).collect()} == {1: (4, 8), 2: (0, 0), 3: (1, 3), 5: (2, 5)}
    assert layout.walk(docs, [9, 80]).groupBy("columns").count().count() == 2
    assert layout.prepare(docs).count() == 4
    again = layout.materialize(docs, layout.walk(docs, 9)).select("doc_id", "row", "text", "source_text").collect()
    assert {tuple(r) for r in again} == {(r.doc_id, r.row, r.text, r.source_text) for r in found}
    first = layout.next_row(docs, docs.select("doc_id", layout.start_cursor().alias("cursor")), 9)
    assert {r.doc_id for r in first.collect()} == {1, 3, 5}


def test_gate(spark):
    bad = spark.createDataFrame([(1, "a\x1b[31m"), (2, "fine")], "doc_id long, text string")
    with pytest.raises(Exception, match="rejected unit"):
        layout.line_stats(bad, 9).collect()
    assert [r.doc_id for r in layout.line_stats(bad, 9, options=Options(on_error="quarantine")).collect()] == [2]
    assert bad.select(source.sanitize_plain(F.col("text")).alias("t")).first().t == "a[31m"


def test_rows_pages_tails(docs):
    found = layout.walk(docs, 9)
    assert [r.row for r in rows.page(found, 1, 2).filter("doc_id = 1").collect()] == [1, 2]
    assert sorted(r.row for r in rows.tail(found, 3).filter("doc_id = 1").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        rows.page(found, 0, 65)
    with pytest.raises(ValueError):
        rows.tail(found, 65, page_size=64)
    assert {r.doc_id: r.rows for r in rows.total_rows(docs, found).collect()} == {1: 4, 2: 0, 3: 1, 4: 0, 5: 2}
    asked = docs.filter("doc_id = 1").select("doc_id", F.explode(F.expr("array(struct(0 as seg, 0 as g), struct(4 as seg, 1 as g), struct(99 as seg, 0 as g))")).alias("cursor"))
    assert sorted(r.row for r in rows.row_for_cursor(found, asked).collect()) == [0, 1, 3]
    assert {r.doc_id: r.first_invalid_row for r in rows.first_invalid_row(found, F.lit(8)).collect()}[1] == 0
    assert rows.valid_prefix(found).filter("row > 0").count() == 0


def test_page_cache(docs):
    found = layout.walk(docs, 9)
    cache = rows.PageCache(found, page_size=4, max_pages=2)
    for start in (0, 0, 1, 2, 0):
        assert cache.get(start, 2).filter("doc_id = 1").count() == 2
    assert cache.counters == {"hits": 1, "misses": 4, "builds": 4, "evictions": 2, "invalidated_pages": 0}
    cache.invalidate(found, 1, 3)  # rows 2 and 3 reach it, rows 0 and 1 do not
    assert list(cache.pages) == [(0, 2)] and cache.counters["invalidated_pages"] == 1 and cache.generation == 1
    cache.invalidate(found, 2)
    assert not cache.pages
    for bad in (lambda: cache.get(0, 5), lambda: cache.invalidate(found, 2), lambda: rows.PageCache(found, 0)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("options", [KEPT, Options()])
def test_bundles_follow_appends(spark, options):
    import random

    r = random.Random(6)
    bits = ["word ", "x", "\n", " ", "longerword", "\r\n", "你好", "\t", "end. "]
    appends = spark.createDataFrame([(d, s, "".join(r.choices(bits, k=r.choice([0, 3, 40, 400])))) for d in range(5) for s in range(4)], "doc_id long, seq long, text string")
    records = spark.createDataFrame(flow.replay(appends, options).collect(), flow.replay(appends, options).schema)
    done = Options(white_space="pre-wrap") if options is KEPT else options
    bundle = rows.LayoutBundle(flow.sources(records, 0), 12, options=done)
    for generation in (1, 2, 3):
        grown = flow.sources(records, generation)
        bundle = bundle.invalidate(grown, records.filter(F.col("generation") == generation), generation)
        fresh = layout.walk(grown, 12, options=done)
        assert sorted(map(str, bundle.rows.collect())) == sorted(map(str, fresh.select(bundle.rows.columns).collect()))
    assert bundle.metadata()["generation"] == 3 and bundle.total().count() == 5
    assert bundle.tail_page(1).count() == layout.walk(grown, 12, options=done).select("doc_id").distinct().count()
    with pytest.raises(ValueError):
        bundle.invalidate(grown, records, 9)
    other = grown.withColumn("text", F.concat(F.lit("z"), "text"))
    with pytest.raises(Exception, match="not an append"):
        bundle.invalidate(other, records.filter("generation = 3"), 4).rows.collect()


def test_projection(docs):
    asked = docs.filter("doc_id in (1, 3)").select("doc_id", F.lit(8).alias("offset"))
    found = {r.doc_id: (r.row, r.column, r.src_offset) for r in projection.project_offset(docs, asked, 9).collect()}
    assert found == {1: (1, 0, 8), 3: (0, 3, 3)}
    lookup = {r.doc_id: (r.src_offset, r.exact) for r in projection.cursor_for_offset(layout.clusters(docs), asked).collect()}
    assert lookup == {1: (8, True), 3: (3, False)}
    cells = docs.select("doc_id", F.lit(1).alias("a_row"), F.lit(2).alias("a_col"), F.lit(0).alias("f_row"), F.lit(4).alias("f_col"))
    picked = {r.doc_id: r for r in projection.select_cells(docs, cells, 9).collect()}
    assert (picked[1].src_start, picked[1].src_end, picked[1].direction) == (4, 10, "backward") and 2 not in picked
    spans = docs.select("doc_id", F.lit(4).alias("q_start"), F.lit(16).alias("q_end"))
    told = {r.doc_id: r for r in projection.extract(docs, spans, 9).collect()}
    assert told[1].source_text == "two three fo" and told[1].visible_text == "two\nthree\nfo"
    assert projection.project_range(docs, spans, 9).filter("doc_id = 1").count() == 3
    at = docs.filter("doc_id = 1").select("doc_id", F.expr("struct(2 as seg, 1 as g)").alias("at"))
    assert projection.project_cursor(docs, at, 9).first()["column"] == 5
    assert projection.project_rows(layout.walk(docs, 9)).columns == ["doc_id", "row", "start_col", "end_col", "src_start", "src_end"]


def test_pushed_down_rows_are_those_of_the_whole_walk(docs):
    whole = layout.walk(docs, 9)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(rows.tail_of(docs, 9, 2), rows.tail(whole, 2)) and same(rows.page_of(docs, 9, 1, 2), rows.page(whole, 1, 2))
    assert same(rows.row_of(docs, 9, 1), rows.row_at(whole, 1))
    plan = rows.tail_of(docs, 9, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    kept = layout.walk(docs.withColumn("lang", F.lit("en")), 9, keep=["lang"])
    assert kept.columns[:3] == ["doc_id", "lang", "row"] and kept.filter("lang = 'en'").count() == whole.count()
    with pytest.raises(ValueError):
        rows.page_of(docs, 9, 0, 65)


def test_offsets_of_cursors(docs):
    marks = layout.clusters(docs)
    asked = docs.filter("doc_id in (1, 5)").select("doc_id", F.expr("explode(array(struct(2 as seg, 1 as g), struct(99 as seg, 0 as g)))").alias("cursor"))
    found = {(r.doc_id, r.cursor.seg): r.src_offset for r in projection.offset_for_cursor(marks, asked).collect()}
    assert found[1, 2] == 5 and found[1, 99] == len("one two three four five six") and found[5, 99] == 8
    spots = docs.filter("doc_id in (1, 2, 5)").select("doc_id", F.explode(F.array(*map(F.lit, (-3, 0, 4, 8, 50)))).alias("offset"))
    for bias in projection.BIASES:
        told = {(r.doc_id, r.offset): (r.src_offset, tuple(r.cursor)) for r in projection.cursor_for_offset(marks, spots, bias).collect()}
        for (doc, offset), at in told.items():
            text = {1: "one two three four five six", 2: "", 5: "你好 world"}[doc]
            assert at == projection.Projector(Options().layout(text), 9, 0).cursor(offset, bias), (doc, offset, bias)


def test_ranges(spark):
    schema = "doc_id long, id string, kind string, src_start int, src_end int"
    base = spark.createDataFrame([(1, "a", "k", 0, 5), (1, "b", "k", 3, 3), (1, "c", "k", 3, 9)], schema)
    at = lambda x: spark.createDataFrame([(1, x)], "doc_id long, offset int")
    assert {r.id for r in ranges.at_offset(base, at(3)).collect()} == {"a", "b", "c"}
    assert {r.id for r in ranges.at_offset(base, at(5)).collect()} == {"c"}
    q = spark.createDataFrame([(1, 0, 3)], "doc_id long, q_start int, q_end int")
    assert {r.id for r in ranges.for_source_range(base, q).collect()} == {"a"}
    more = spark.createDataFrame([(1, "d", "k", 1, 2)], schema)
    assert [r.id for r in ranges.ordered(ranges.append(base, more)).collect()] == ["a", "d", "c", "b"]
    with pytest.raises(Exception, match="repeated range id"):
        ranges.append(base, base).select("src_start").collect()
    with pytest.raises(Exception, match="invalid range"):
        ranges.create(spark.createDataFrame([(1, "x", "k", 4, 2)], schema)).collect()
    assert ranges.invalid_ranges(base.unionAll(base)).count() == 3


def test_search_rules(spark):
    docs = spark.createDataFrame([(1, "aaa x--- the THE theme"), (2, "👩‍💻 the")], "doc_id long, text string")
    at = lambda *a, **k: [(r.doc_id, r.src_start) for r in search.search(docs, *a, **k).orderBy("doc_id", "match_index").collect()]
    assert at("aa") == [(1, 0)]
    assert at("--", whole_word=True) == []
    assert at("the") == [(1, 9), (1, 17), (2, 6)]
    assert at("the", whole_word=True) == [(1, 9), (2, 6)]
    assert at("the", case_sensitive=False, match_limit=2) == [(1, 9), (1, 13), (2, 6)]
    assert at("[a-z]+e", mode="regex", match_limit=1) == [(1, 9), (2, 6)]
    with pytest.raises(ValueError):
        search.search(docs, "")
    with pytest.raises(ValueError):
        search.search(docs, "x*", mode="regex")


def test_case_limits_scopes_and_flags(spark):
    docs = spark.createDataFrame([(1, "\u017f s S \u0130 i \u03c2 \u03a3 \u00b5 \u212a \U00010400\U00010428 x")], "doc_id long, text string")
    hits = lambda q, **k: [r.match_text for r in search.search(docs, q, case_sensitive=False, **k).orderBy("match_index").collect()]
    assert hits("s") == ["s", "S"] and hits("i") == ["i"] and hits("\u03a3") == ["\u03a3"] and hits("\u03bc") == []
    assert hits("K") == ["\u212a"] and hits("\U00010400") == ["\U00010400", "\U00010428"]
    for limit in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            search.search(docs, "s", match_limit=limit)
    with pytest.raises(ValueError):
        search.search(docs, "s", scopes=[])
    assert search.search(docs, "s", scopes=docs.selectExpr("doc_id", "'a' as scope_id", "0 as s_start", "9 as s_end").limit(0)).count() == 0
    told = search.search(docs, "s", scopes=[("a", 0, 3), ("b", 0, 99)]).orderBy("match_index").collect()
    assert [(r.src_start, r.scope_id) for r in told] == [(2, "a"), (2, "b")]
    lines = spark.createDataFrame([(1, "Ab\nab")], "doc_id long, text string")
    found = lambda **k: search.search(lines, "^ab", mode="regex", options=KEPT, **k).count()
    assert (found(), found(flags="m"), found(flags="im"), found(flags="m", case_sensitive=False)) == (0, 1, 1, 2)
    bad = Options(on_error="quarantine")
    two = spark.createDataFrame([(1, "bbb"), (2, "aab")], "doc_id long, text string")
    assert {r.doc_id for r in search.search(two, "b|a*(?=a)", mode="regex", options=bad).collect()} <= {1, 2}


def test_requests_for_matches(spark, docs):
    found = search.search(docs, "o")
    asked = docs.filter("doc_id in (1, 5)").select("doc_id", F.explode(F.array(*map(F.lit, (0, 1, 6, 7, 99)))).alias("offset"))
    for name, pick in (("after", search.after_offset), ("before", search.before_offset)):
        many = {(r.doc_id, r.offset): (r.match_index, r.src_start) for r in pick(found, asked).collect()}
        for offset in (0, 1, 6, 7, 99):
            one = {r.doc_id: (r.match_index, r.src_start) for r in pick(found, offset).collect()}
            assert {d: many.get((d, offset)) for d in (1, 5)} == {d: one.get(d) for d in (1, 5)}, (name, offset)
    spans = docs.filter("doc_id = 1").select("doc_id", F.lit(0).alias("q_start"), F.lit(7).alias("q_end"))
    assert [r.src_start for r in search.for_source_range(found, spans, limit=1).collect()] == [0]
    told = {r.src_start: r for r in search.project_matches(docs, found.filter("doc_id = 1"), 9).collect()}
    assert (told[15].start_row, told[15].start_col, told[15].end_col) == (2, 1, 2) and told[15].fragments[0].src_end == 16
    kinds = ranges.create(spark.createDataFrame([(1, "r1", "k", 2, 12)], "doc_id long, id string, kind string, src_start int, src_end int"))
    scopes = search.range_scopes(kinds, docs.select("doc_id", F.lit(5).alias("q_start"), F.lit(50).alias("q_end")))
    assert [tuple(r) for r in scopes.collect()] == [(1, "r1", 5, 12)]
    assert [(r.doc_id, r.src_start, r.scope_id) for r in search.search(docs, "o", scopes=scopes).collect()] == [(1, 6, "r1")]


def test_extraction_with_fragments_ranges_and_selections(spark, docs):
    kinds = ranges.create(spark.createDataFrame([(1, "a", "k", 0, 6), (1, "b", "k", 0, 9), (1, "c", "k", 20, 22)], "doc_id long, id string, kind string, src_start int, src_end int"))
    cells = docs.select("doc_id", F.lit(1).alias("a_row"), F.lit(2).alias("a_col"), F.lit(0).alias("f_row"), F.lit(4).alias("f_col"))
    picked = projection.select_cells(docs, cells, 9)
    (r,) = projection.extract_selection(docs, picked, 9, annotated=kinds).filter("doc_id = 1").collect()
    assert (r.source_text, r.visible_text, r.direction) == ("two th", "two\nth", "backward")
    assert [(f.row, f.src_start, f.src_end, f.start_col, f.end_col) for f in r.fragments] == [(0, 4, 7, 4, 7), (1, 8, 10, 0, 2)]
    assert [x.id for x in r.ranges] == ["b", "a"]
    spans = docs.filter("doc_id = 1").select("doc_id", F.lit(5).alias("q_start"), F.lit(9).alias("q_end"))
    (e,) = projection.project_range_ends(docs, spans, 9).collect()
    assert (e.start_row, e.start_col, e.end_row, e.end_col, len(e.fragments)) == (0, 5, 1, 1, 2)


def test_range_rules(spark):
    schema = "doc_id long, id string, kind string, src_start int, src_end int, data string"
    with pytest.raises(Exception, match="repeated range id"):
        ranges.create(spark.createDataFrame([(1, "a", "k", 0, 1, None)] * 2, schema)).collect()
    with pytest.raises(Exception, match="invalid range"):
        ranges.create(spark.createDataFrame([(1, "a", "k", 0, 1, "{x")], schema)).collect()
    names = ["\ue000", "\U00010000", "b", "a"]
    found = ranges.ordered(ranges.create(spark.createDataFrame([(1, n, "k", 0, 1, None) for n in names], schema))).collect()
    assert [r.id for r in found] == ["a", "b", "\U00010000", "\ue000"]


def test_rich_extraction(spark):
    docs = spark.createDataFrame([(1, "a\x1b[31mbcd\x1b[0m ef")], "doc_id long, text string")
    asked = docs.select("doc_id", F.lit(2).alias("q_start"), F.lit(6).alias("q_end"))
    (r,) = rich.extract(docs, asked, 80).collect()
    assert r.source_text == "cd e" and [(f.source_text, f.style.fg if f.style else None) for f in r.fragments] == [("cd", "ansi:31"), (" e", None)]
    where = rich.visible_for_raw(rich.raw_map(docs), docs.select("doc_id", F.lit(6).alias("q_start"), F.lit(7).alias("q_end"))).collect()
    assert [(x.src_start, x.src_end) for x in where] == [(1, 4)]
    back = rich.raw_for_visible(rich.raw_map(docs), docs.select("doc_id", F.lit(2).alias("q_start"), F.lit(3).alias("q_end"))).collect()
    assert [(x.raw_start, x.raw_end) for x in back] == [(6, 9)]
    (m,) = rich.memory(docs).collect()
    assert (m.chars, m.slots, m.entries, m.ranges) == (7, 2 + 4 * 3, 1 + 3 + 1, 4) and m.bytes == 2 * 7 + 8 * 14 + 32 * 5 + 96 * 4


def test_counters():
    c = telemetry.Counters()
    c.record("walks")
    assert c.snapshot() == {}
    c.enable()
    c.record("walks", 2)
    c.record("pages")
    c.disable()
    c.record("walks")
    assert c.snapshot() == {"pages": 1, "walks": 2}
    c.reset()
    assert c.snapshot() == {}


def test_rich(spark):
    docs = spark.createDataFrame([(1, "\x1b[31mabcdef\x1b[0m\x1b[2K"), (2, "plain")], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.spans, r.diagnostics) for r in rich.visible(docs).collect()} == {1: ("abcdef", 1, 1), 2: ("plain", 0, 0)}
    found = rich.fragments(docs, 3, reemit="sgr")
    assert [r.ansi_text for r in found.filter("doc_id = 1").orderBy("row").collect()] == ["\x1b[31mabc\x1b[0m", "\x1b[31mdef\x1b[0m"]
    clipped = rich.clipped_fragments(found, 1, 4).filter("doc_id = 1").orderBy("row").collect()
    assert [r.source_text for r in clipped] == ["bc", "d"]
    assert rich.spans_for_source_range(rich.spans(docs), 0, 2).count() == 1 and rich.raw_map(docs).count() == 2


def test_stream_of_appends_equals_replay(spark, tmp_path):
    rows_ = [(d, s, f"part {s} of\r" if s % 2 else "\nnext  line ") for d in (1, 2) for s in range(6)]
    frame = spark.createDataFrame(rows_, "doc_id long, seq long, text string")
    frame.filter("seq < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    query = lambda: (
        flow.stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "pre-wrap")
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    query()
    frame.filter("seq >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query()
    told = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert told == {tuple(r) for r in flow.replay(frame, KEPT).collect()} and len(told) == 12


def test_telemetry(spark, docs):
    found, seen = telemetry.counted(layout.walk(docs, 9), "walk", rows=F.count(F.lit(1)))
    assert telemetry.combined(telemetry.rows_estimate(found)).first().bytes == 160 * seen.get["rows"]
    assert spark.range(1).select(telemetry.estimated_bytes(chars=3, slots=1, entries=1, ranges=1).alias("b")).first().b == 142
    with pytest.raises(ValueError):
        telemetry.estimated_bytes(pages=1)
