"""Queries over the driver tables, and the SQL that states the same result for DuckDB.

Wrapped queries lay out whole documents at real numbers of columns, with every character but small
letters, spaces and line feeds as an x: rows may end after spaces and in words that are too long only,
which a regular expression states in SQL.  Queries over the texts as they are use a number of columns
that no line reaches, where rows are lines.  Other breaks are held by golden cases, by a plain search
over all ends and by invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.width import WidthProfile
from gridloom.operators import layout, projection, ranges, rich, rows, search
from gridloom.operators.kernel import Options
from gridloom.sources import text as source
from gridloom.streaming import flow

KEPT = Options(white_space="pre-wrap")
UNBOUNDED = 10_000_000
WIDTHS = (36, 52, 80, 100)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.read_documents(spark, f"{sf_dir}/documents.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.read_documents(spark, f"{sf_dir}/benchmark.parquet", key="item_id")


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return docs.withColumn("text", F.regexp_replace("text", "[^a-z \n]", "x"))


def line_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = layout.line_stats(_letters(spark, sf_dir), 80, options=KEPT, keep=["lang"])
    return stats.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("rows").alias("rows"), F.max("max_line_width").alias("max_line_width"))


def sanitize_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("\u202e"), F.regexp_replace("text", "e", "\u0007e\u009b"), F.lit("\x1b"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(source.sanitize_plain(dirty)).alias("digest"))


def quarantine_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    marked = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\x1b[31m"))).otherwise(F.col("text")))
    kept, rejected = source.quarantine(marked)
    return kept.select("doc_id", F.lit(True).alias("accepted")).unionAll(rejected.select("doc_id", F.lit(False)))


def normalize_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat(F.lit(" \t"), F.regexp_replace("text", " ", " \t "), F.lit("\n\n"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(source.normalise_column(spaced)).alias("digest"))


def normalize_prewrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    fed = F.regexp_replace(F.regexp_replace("text", "\n", "\r\n"), "e ", "e\r\f")
    return _docs(spark, sf_dir).select("doc_id", F.md5(source.normalise_column(fed, "pre-wrap")).alias("digest"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.posexplode(F.split("text", "\n"))
    return _items(spark, sf_dir).select("doc_id", lines.alias("line", "text"))


def text_width_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line", layout.text_width(F.col("text")).alias("width"))


def text_width_ambiguous_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = WidthProfile(name="wide", ambiguous="wide")
    return _lines(spark, sf_dir).select("doc_id", "line", layout.text_width(F.col("text"), wide).alias("width"))


def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both text tables."""
    named = lambda frame, name: frame.select(F.lit(name).alias("source_table"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return named(_items(spark, sf_dir), "benchmark").unionAll(named(_docs(spark, sf_dir), "documents"))


def text_width_narrow_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_lines(spark, sf_dir).select("source_table", "doc_id", "line", layout.text_width(F.col("text")).alias("width"))


def text_width_ambiguous_wide_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = WidthProfile(name="wide", ambiguous="wide")
    return _all_lines(spark, sf_dir).select("source_table", "doc_id", "line", layout.text_width(F.col("text"), wide).alias("width"))


def tab_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    column = (F.col("event_id") % 97).cast("int")
    return events.select("event_id", layout.tab_advance(column, 8).cast("int").alias("advance8"), layout.tab_advance(column, 3).cast("int").alias("advance3"))


def _told(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "row", "src_start", "src_end", "width", F.col("break.kind").alias("break_kind"))


def walk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(layout.walk(_docs(spark, sf_dir), UNBOUNDED, options=KEPT))


def walk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(layout.walk(_letters(spark, sf_dir), 80, options=KEPT))


def walk_rows_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(layout.walk(_letters(spark, sf_dir), 7, options=KEPT))


def walk_rows_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.walk(_letters(spark, sf_dir), 40, texts=True).withColumn("text_md5", F.md5("text"))
    return found.select("doc_id", "row", "src_start", "src_end", "width", F.col("break.kind").alias("break_kind"), "text_md5")


def walk_many_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.walk(_letters(spark, sf_dir), list(WIDTHS), options=KEPT)
    return found.groupBy("columns").agg(F.count("*").alias("rows"), F.max("width").alias("max_width"), F.count("overflow").alias("overflows"))


def materialize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a walk are taken back to their texts; ``materialize_all_rows`` walks with texts."""
    docs = _letters(spark, sf_dir)
    found = layout.materialize(docs, layout.walk(docs, 80, options=KEPT), KEPT)
    return found.select("doc_id", "row", F.md5("text").alias("text_md5"), F.md5("source_text").alias("source_md5"))


def materialize_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.walk(_docs(spark, sf_dir), UNBOUNDED, options=KEPT, texts=True)
    return found.select("doc_id", "row", F.md5("text").alias("text_md5"), F.md5("source_text").alias("source_md5"))


def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_rows(_letters(spark, sf_dir), 80, options=KEPT)


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_stats(_letters(spark, sf_dir), 52, options=KEPT)


def prepare_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.prepare(_items(spark, sf_dir), KEPT).select("doc_id", "source_len", F.explode("segments").alias("s"))
    return found.groupBy("doc_id", "source_len", F.col("s.kind").alias("kind")).agg(F.sum(F.length("s.text")).alias("chars"))


def prepare_segments_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.prepare(_docs(spark, sf_dir), KEPT).select("doc_id", "source_len", F.explode("segments").alias("s"))
    return found.groupBy("doc_id", "source_len", F.col("s.kind").alias("kind")).agg(F.sum(F.length("s.text")).alias("chars"))


def row_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(rows.row_of(_letters(spark, sf_dir), 80, 2, options=KEPT))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(rows.page_of(_letters(spark, sf_dir), 80, 5, 20, options=KEPT))


def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(rows.tail_of(_letters(spark, sf_dir), 80, 2, options=KEPT))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.index_stats(layout.walk(_letters(spark, sf_dir), 80, options=KEPT), 4)


OFFSETS = (0, 7, 60, 333, 100_000)


def _asked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.array(*[F.lit(o) for o in OFFSETS])).alias("offset"))


def cursor_for_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _items(spark, sf_dir)
    return projection.cursor_for_offset(layout.clusters(docs, KEPT), _asked(docs)).select("doc_id", "offset", "src_offset", "exact")


def project_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _items(spark, sf_dir)
    found = projection.project_offset(docs, _asked(docs), UNBOUNDED, options=KEPT)
    return found.select("doc_id", "offset", "row", "column", "src_offset", "exact", "at_end")


def project_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _items(spark, sf_dir)
    cells = docs.select("doc_id", F.lit(0).alias("q_row"), F.lit(4).alias("q_column"))
    return projection.project_cell(docs, cells, UNBOUNDED, options=KEPT).select("doc_id", "row", "column", "src_offset", "exact")


def project_cell_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the first, the third and the tenth line, near their start and far along."""
    docs = _docs(spark, sf_dir).filter("text is not null")
    each = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    cells = docs.select("doc_id", each((0, 2, 9), "q_row")).select("doc_id", "q_row", each((4, 500), "q_column"))
    return projection.project_cell(docs, cells, UNBOUNDED, options=KEPT).select("doc_id", "q_row", "q_column", "row", "column", "src_offset", "exact")


def project_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _items(spark, sf_dir)
    asked = docs.select("doc_id", F.lit(9).alias("q_start"), F.lit(250).alias("q_end"))
    found = projection.project_range(docs, asked, UNBOUNDED, options=KEPT)
    return found.select("doc_id", "row", "src_start", "src_end", "start_col", "end_col")


def selection_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections with all their lines, empty ones at the ends too; without a text there is nothing to tell."""
    docs = _items(spark, sf_dir)
    asked = docs.select("doc_id", F.lit(9).alias("q_start"), F.lit(250).alias("q_end"))
    found = projection.extract(docs, asked, UNBOUNDED, options=KEPT, edges=True)
    told = found.select("doc_id", "source_text", "visible_text", F.size("visible_rows").alias("visible_rows"))
    none = docs.filter("text is null").select("doc_id", "text", "text", F.lit(None).cast("int"))
    return told.unionAll(none)


def _asked_within(docs: DataFrame) -> DataFrame:
    """Offsets that follow each text's length: its start, middle, end and beyond."""
    n = F.length("text")
    spots = F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), n, n + 9))
    return docs.filter("text is not null").select("doc_id", F.explode(spots).alias("offset"))


def _middle(docs: DataFrame) -> DataFrame:
    """The middle half of each text."""
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    return docs.filter("text is not null").select("doc_id", quarter.alias("q_start"), (n - quarter).alias("q_end"))


def cursor_for_offset_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return projection.snap_offset(docs, _asked_within(docs), options=KEPT).select("doc_id", "offset", "src_offset", "exact")


def project_offset_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = projection.project_offset(docs, _asked_within(docs), UNBOUNDED, options=KEPT)
    return found.select("doc_id", "offset", "row", "column", "src_offset", "exact", "at_end")


def project_range_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _letters(spark, sf_dir)
    found = projection.project_range(docs, _middle(docs), 80, options=KEPT)
    return found.select("doc_id", "row", "src_start", "src_end", "start_col", "end_col")


def selection_extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = projection.extract(docs, _middle(docs), UNBOUNDED, options=KEPT)
    return found.select("doc_id", F.md5("source_text").alias("source_md5"), F.md5("visible_text").alias("visible_md5"), F.size("visible_rows").alias("visible_rows"))


def _line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    start = (F.col("l_linenumber") * 3).cast("int")
    ident = F.concat_ws("-", "l_linenumber", "l_partkey", F.row_number().over(_numbered()).cast("string"))
    length = (F.col("l_quantity") % 11).cast("int")
    return items.select(F.col("l_orderkey").alias("doc_id"), ident.alias("id"), F.lit("item").alias("kind"), start.alias("src_start"), (start + length).alias("src_end"))


def _numbered():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))


def ranges_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _orders(spark, sf_dir).select("doc_id", F.lit(9).alias("offset"))
    found = ranges.at_offset(ranges.create(_line_ranges(spark, sf_dir)), asked)
    return found.select("doc_id", "id", "src_start", "src_end")


def ranges_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _orders(spark, sf_dir).select("doc_id", F.lit(6).alias("q_start"), (F.lit(6) + F.col("doc_id") % 9).cast("int").alias("q_end"))
    found = ranges.for_source_range(ranges.create(_line_ranges(spark, sf_dir)), asked)
    return found.select("doc_id", "q_end", "id", "src_start", "src_end")


def ranges_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = _orders(spark, sf_dir).select("doc_id", F.lit("order").alias("id"), F.lit("order").alias("kind"), F.lit(0).alias("src_start"), F.lit(5).alias("src_end"))
    both = ranges.append(_line_ranges(spark, sf_dir), more)
    return both.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("src_start").cast("long").alias("first"), F.sum("src_end").alias("ends"))


def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_docs(spark, sf_dir), "the", options=KEPT)
    return found.select("doc_id", "match_index", "src_start", "src_end")


def search_ignoring_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_docs(spark, sf_dir), "THE", case_sensitive=False, options=KEPT)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


def search_ignoring_accented_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ``the`` as THÉ and each s as a long s, which only folds to it: capital S alone is a hit for s."""
    text = F.regexp_replace(F.regexp_replace("text", "the", "THÉ"), "s", "\u017f")
    docs = _docs(spark, sf_dir).withColumn("text", text)
    count = lambda query, name: search.match_count(search.search(docs, query, case_sensitive=False, options=KEPT)).withColumn("query", F.lit(name))
    return count("thé", "thé").unionAll(count("s", "s"))


def search_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the rows and cells of their ends."""
    docs = _letters(spark, sf_dir)
    found = search.project_matches(docs, search.search(docs, "the", options=KEPT), 80, options=KEPT)
    return found.select("doc_id", "match_index", "start_row", "start_col", "end_row", "end_col", F.size("fragments").alias("fragments"))


def search_after_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit at or after the middle of each text, and the last before it."""
    docs = _docs(spark, sf_dir)
    found = search.search(docs, "the", options=KEPT)
    asked = docs.filter("text is not null").select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("offset"))
    side = lambda frame, name: frame.select("doc_id", F.lit(name).alias("side"), "offset", "match_index", "src_start")
    return side(search.after_offset(found, asked), "after").unionAll(side(search.before_offset(found, asked), "before"))


def search_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_docs(spark, sf_dir), "the", whole_word=True, options=KEPT)
    return found.select("doc_id", "src_start", "src_end")


def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_docs(spark, sf_dir), "[0-9]{3,}", mode="regex", options=KEPT)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("match_text")).alias("chars"))


def _scopes(docs: DataFrame) -> DataFrame:
    one = docs.select("doc_id", F.lit("head").alias("scope_id"), F.lit(0).alias("s_start"), F.lit(200).alias("s_end"))
    return one.unionAll(docs.select("doc_id", F.lit("next").alias("scope_id"), F.lit(100).alias("s_start"), F.lit(400).alias("s_end")))


def search_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = search.search(docs, "the", scopes=_scopes(docs), match_limit=5, options=KEPT)
    return found.select("doc_id", "match_index", "src_start", "src_end", "scope_id")


def search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return search.stats(docs, search.search(docs, "the", options=KEPT), 6)


def search_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_docs(spark, sf_dir), "the", options=KEPT)
    side = lambda frame, name: frame.select("doc_id", F.lit(name).alias("side"), "match_index", "src_start")
    return side(search.after_offset(found, 150), "after").unionAll(side(search.before_offset(found, 150), "before"))


def search_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_docs(spark, sf_dir), "the", options=KEPT)
    return search.for_source_range(found, 50, 300, limit=4).select("doc_id", "match_index", "src_start")


def _ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with every word ``the`` in red, a link around ``of`` and a cleared line at the end."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")
    red = F.regexp_replace("text", "the", "\x1b[1;31mthe\x1b[0m")
    linked = F.regexp_replace(red, " of ", " \x1b]8;;https://e.test/a\x1b\\\\of\x1b]8;;\x1b\\\\ ")
    return turns.select(key, F.concat(linked, F.lit("\x1b[2K")).alias("text"))


def rich_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich.visible(_ansi(spark, sf_dir), KEPT).select("doc_id", F.md5("text").alias("digest"), "spans", "diagnostics")


def rich_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rich.spans(_ansi(spark, sf_dir), KEPT).filter("kind = 'style'")
    return found.select("doc_id", "src_start", "src_end", F.col("style.fg").alias("fg"), F.col("style.bold").alias("bold"))


def rich_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rich.fragments(_ansi(spark, sf_dir), UNBOUNDED, options=KEPT)
    joined = F.array_join(F.transform("fragments", lambda f: f["text"]), "")
    return found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum(F.size("fragments")).alias("parts"), F.count_if(joined != F.col("text")).alias("torn"))


def rich_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rich.diagnostics(_ansi(spark, sf_dir), KEPT)
    return found.groupBy("kind", "code", "family", "raw_length", "fingerprint").agg(F.count("*").alias("n"))


def append_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text")
    found = flow.replay(turns, KEPT)
    return found.select("doc_id", "seq", "generation", "appended", "stable_prefix", (F.col("stable_prefix") + F.length("source_delta")).alias("length"))


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of conversations after their last turn: those before the first that it can reach are kept from the
    layout of the turns before it."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "text")
    records = flow.replay(turns.withColumn("text", F.regexp_replace("text", "[^a-z \n]", "x")), KEPT)
    last = records.groupBy("doc_id").agg(F.max("generation").alias("last"))
    grown = records.join(last, "doc_id")
    bundle = rows.LayoutBundle(flow.sources(grown.filter("generation < last")), 80, options=KEPT)
    return _told(bundle.invalidate(flow.sources(records), grown.filter("generation = last"), 1).rows)


QUERIES = {
    f.__name__: f
    for f in (
        line_stats_by_lang, sanitize_plain, quarantine_plain, normalize_normal, normalize_prewrap, text_width_narrow, text_width_ambiguous_wide,
        tab_advance, walk_lines, walk_rows, walk_rows_narrow, walk_rows_normal, walk_many_widths, materialize_rows, materialize_all_rows, layout_rows, line_stats, prepare_segments, row_at, page_rows, tail_rows,
        index_stats, cursor_for_offset, project_offset, project_cell, project_range, selection_extract, ranges_at, ranges_overlap, ranges_append,
        search_literal, search_ignoring_case, search_ignoring_accented_case, search_projected, search_after_each, search_whole_word, search_regex, search_scoped, search_limit, search_before_after, search_range,
        rich_visible, rich_spans, rich_fragments, rich_diagnostics, append_flow, append_rows,
        text_width_narrow_all, text_width_ambiguous_wide_all, prepare_segments_documents, cursor_for_offset_documents,
        project_offset_documents, project_cell_documents, project_range_documents, selection_extract_documents,
    )
}


def _lines_sql(table: str = "documents", key: str = "doc_id") -> str:
    """Lines as rows: a final line feed ends the last row and makes no other."""
    return f"""
    parted AS (
        SELECT {key} AS doc_id, text, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10))
            THEN string_split(text[1:length(text) - 1], chr(10)) ELSE string_split(text, chr(10)) END AS lines
        FROM {table} WHERE text IS NOT NULL
    ), each AS (
        SELECT doc_id, text, unnest(lines) AS line, unnest(range(len(lines))) AS row, len(lines) AS n FROM parted
    ), ended AS (
        SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY row) - 1 AS stop FROM each
    ), lined AS (
        SELECT doc_id, CAST(row AS INT) AS row, CAST(stop - length(line) AS INT) AS src_start, CAST(stop AS INT) AS src_end,
            CAST(length(line) AS INT) AS width, CASE WHEN row + 1 < n OR ends_with(text, chr(10)) THEN 'hard' ELSE 'end' END AS break_kind, line, n, text
        FROM ended
    )"""


_LETTERS = "letters AS (SELECT doc_id, lang, regexp_replace(text, '[^a-z ' || chr(10) || ']', 'x', 'g') AS text FROM documents WHERE text IS NOT NULL)"


_GROWN = """letters AS (SELECT conv_id AS doc_id, NULL AS lang, string_agg(regexp_replace(coalesce(text, ''), '[^a-z ' || chr(10) || ']', 'x', 'g'), ''
        ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"""


def _wrapped_sql(columns: int, letters: str = _LETTERS) -> str:
    """Rows of the letters with spaces kept: a row is what is left of a line, or what ends in the last space
    that fits, or as many characters as fit."""
    return f"""{letters}, parted AS (
        SELECT doc_id, lang, text, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10))
            THEN string_split(text[1:length(text) - 1], chr(10)) ELSE string_split(text, chr(10)) END AS lines
        FROM letters
    ), each AS (
        SELECT doc_id, lang, text, unnest(lines) AS line, unnest(range(len(lines))) AS ln, len(lines) AS n FROM parted
    ), cut AS (
        SELECT *, CASE WHEN line = '' THEN [''] ELSE regexp_extract_all(line, '.{{1,{columns}}}$|.{{0,{columns - 1}}} |.{{{columns}}}') END AS parts FROM each
    ), part AS (
        SELECT doc_id, lang, text, ln, n, unnest(parts) AS line, unnest(range(len(parts))) AS k, len(parts) AS m FROM cut
    ), counted AS (
        SELECT *, row_number() OVER w - 1 AS row, count(*) OVER (PARTITION BY doc_id) AS total,
            sum(length(line) + CASE WHEN k + 1 = m THEN 1 ELSE 0 END) OVER w - CASE WHEN k + 1 = m THEN 1 ELSE 0 END AS stop
        FROM part WINDOW w AS (PARTITION BY doc_id ORDER BY ln, k)
    ), lined AS (
        SELECT doc_id, lang, text, line, total, CAST(row AS INT) AS row, CAST(stop - length(line) AS INT) AS src_start, CAST(stop AS INT) AS src_end,
            CAST(length(line) AS INT) AS width, CASE WHEN k + 1 < m THEN 'wrap' WHEN ln + 1 < n OR ends_with(text, chr(10)) THEN 'hard' ELSE 'end' END AS break_kind
        FROM counted
    )"""


def _stats_sql(columns: int) -> str:
    return f"""WITH {_wrapped_sql(columns)}, told AS (SELECT doc_id, count(*) AS rows, max(width) AS most FROM lined GROUP BY doc_id)
        SELECT l.doc_id, l.lang, CAST(coalesce(rows, 0) AS INT) AS rows, CAST(coalesce(most, 0) AS INT) AS max_line_width FROM letters l LEFT JOIN told t ON t.doc_id = l.doc_id"""


_HITS = """
    split AS (
        SELECT doc_id, string_split(text, 'the') AS parts, text FROM documents WHERE text IS NOT NULL
    ), piece AS (
        SELECT doc_id, text, unnest(parts) AS part, unnest(range(len(parts))) AS k, len(parts) AS n FROM split
    ), hits AS (
        SELECT doc_id, text, CAST(k AS INT) AS match_index, n,
            CAST(sum(length(part) + 3) OVER (PARTITION BY doc_id ORDER BY k) - 3 AS INT) AS src_start
        FROM piece
    ), hit AS (
        SELECT doc_id, text, match_index, src_start, src_start + 3 AS src_end FROM hits WHERE match_index + 1 < n
    )"""

_TOLD = "doc_id, row, src_start, src_end, width, break_kind"
_RANGES = """
    ranged AS (
        SELECT l_orderkey AS doc_id, concat_ws('-', l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_quantity)) AS id, l_linenumber * 3 AS src_start,
            l_linenumber * 3 + CAST(l_quantity % 11 AS INT) AS src_end
        FROM lineitem
    )"""
_ALL_LINES = """p AS (SELECT 'benchmark' AS source_table, item_id AS doc_id, string_split(text, chr(10)) AS l FROM benchmark
            UNION ALL SELECT 'documents', doc_id, string_split(text, chr(10)) FROM documents),
        q AS (SELECT source_table, doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM p)"""
_WITHIN = """asked AS (SELECT doc_id, text, unnest(list_distinct([0, length(text) // 2, length(text), length(text) + 9])) AS "offset"
        FROM documents WHERE text IS NOT NULL)"""
_ASKED = "asked AS (SELECT item_id AS doc_id, text, unnest([0, 7, 60, 333, 100000]) AS \"offset\" FROM benchmark)"

ORACLES = {
    "sanitize_plain": "SELECT doc_id, md5(text) AS digest FROM documents",
    "quarantine_plain": "SELECT doc_id, doc_id % 3 <> 0 AS accepted FROM documents",
    "normalize_normal": "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')) AS digest FROM documents",
    "normalize_prewrap": "SELECT doc_id, md5(replace(text, 'e ', 'e' || chr(10) || chr(10))) AS digest FROM documents",
    "text_width_narrow": """WITH p AS (SELECT item_id AS doc_id, string_split(text, chr(10)) AS l FROM benchmark),
        q AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM p)
        SELECT doc_id, CAST(line AS INT) AS line, CAST(length(t) AS INT) AS width FROM q""",
    "text_width_ambiguous_wide": """WITH p AS (SELECT item_id AS doc_id, string_split(text, chr(10)) AS l FROM benchmark),
        q AS (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM p)
        SELECT doc_id, CAST(line AS INT) AS line, CAST(length(t) + len(regexp_extract_all(t, '[ÆÐ×ØÞßàáæèéêìíðòó÷øùúüþ]')) AS INT) AS width FROM q""",
    "tab_advance": """SELECT event_id, CAST(8 - (event_id % 97) % 8 AS INT) AS advance8, CAST(3 - (event_id % 97) % 3 AS INT) AS advance3 FROM events""",
    "line_stats_by_lang": f"""SELECT lang, count(*) AS docs, CAST(sum(rows) AS BIGINT) AS rows, max(max_line_width) AS max_line_width
        FROM ({_stats_sql(80)}) GROUP BY lang""",
    "walk_lines": f"WITH {_lines_sql()} SELECT {_TOLD} FROM lined",
    "walk_rows": f"WITH {_wrapped_sql(80)} SELECT {_TOLD} FROM lined",
    "walk_rows_narrow": f"WITH {_wrapped_sql(7)} SELECT {_TOLD} FROM lined",
    "walk_rows_normal": f"""WITH {_LETTERS}, flowed AS (
            SELECT doc_id, trim(regexp_replace(text, '[ ' || chr(10) || ']+', ' ', 'g'), ' ') AS t FROM letters
        ), cut AS (
            SELECT doc_id, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '.{{1,40}}$|.{{0,39}} |.{{40}} ?') END AS parts FROM flowed
        ), part AS (
            SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS row, len(parts) AS m FROM cut
        ), placed AS (
            SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY row) - length(line) AS a, rtrim(line, ' ') AS shown FROM part
        ) SELECT doc_id, CAST(row AS INT) AS row, CAST(a AS INT) AS src_start, CAST(a + length(shown) AS INT) AS src_end, CAST(length(shown) AS INT) AS width,
            CASE WHEN row + 1 = m THEN 'end' ELSE 'wrap' END AS break_kind, md5(shown) AS text_md5 FROM placed""",
    "walk_many_widths": " UNION ALL ".join(
        f"SELECT {c} AS columns, * FROM (WITH {_wrapped_sql(c)} SELECT count(*) AS rows, max(width) AS max_width, CAST(0 AS BIGINT) AS overflows FROM lined)" for c in WIDTHS
    ),
    "materialize_rows": f"WITH {_wrapped_sql(80)} SELECT doc_id, row, md5(line) AS text_md5, md5(line) AS source_md5 FROM lined",
    "materialize_all_rows": f"WITH {_lines_sql()} SELECT doc_id, row, md5(line) AS text_md5, md5(line) AS source_md5 FROM lined",
    "layout_rows": f"SELECT doc_id, rows FROM ({_stats_sql(80)})",
    "line_stats": f"SELECT doc_id, rows, max_line_width FROM ({_stats_sql(52)})",
    "prepare_segments": """WITH c AS (SELECT item_id AS doc_id, CAST(length(text) AS INT) AS source_len, unnest(string_split(text, '')) AS ch FROM benchmark)
        SELECT doc_id, source_len, CASE ch WHEN ' ' THEN 'preserved-space' WHEN chr(10) THEN 'hard-break' ELSE 'text' END AS kind,
            count(*) AS chars FROM c WHERE ch <> '' GROUP BY ALL""",
    "row_at": f"WITH {_wrapped_sql(80)} SELECT {_TOLD} FROM lined WHERE row = 2",
    "page_rows": f"WITH {_wrapped_sql(80)} SELECT {_TOLD} FROM lined WHERE row BETWEEN 5 AND 24",
    "tail_rows": f"WITH {_wrapped_sql(80)} SELECT {_TOLD} FROM lined WHERE row >= total - 2",
    "index_stats": f"""WITH {_wrapped_sql(80)} SELECT doc_id, CAST(count(*) FILTER (WHERE row % 4 = 0) AS INT) AS anchor_count,
        CAST(count(*) AS INT) AS rows FROM lined GROUP BY doc_id""",
    "cursor_for_offset": f"""WITH {_ASKED} SELECT doc_id, "offset", CAST(least("offset", length(text)) AS INT) AS src_offset,
        "offset" <= length(text) AS exact FROM asked""",
    "project_offset": f"""WITH {_ASKED}, placed AS (
            SELECT *, least("offset", length(text)) AS spot, text[1:least("offset", length(text))] AS head FROM asked
        ) SELECT doc_id, "offset", CAST(length(head) - length(replace(head, chr(10), '')) AS INT) AS row,
            CAST(length(list_last(string_split(head, chr(10)))) AS INT) AS "column", CAST(spot AS INT) AS src_offset,
            "offset" <= length(text) AS exact, spot = length(text) AS at_end FROM placed""",
    "project_cell": """SELECT item_id AS doc_id, 0 AS row, CAST(least(4, length(string_split(text, chr(10))[1])) AS INT) AS "column",
        CAST(least(4, length(string_split(text, chr(10))[1])) AS INT) AS src_offset, length(string_split(text, chr(10))[1]) >= 4 AS exact FROM benchmark""",
    "project_range": f"""WITH {_lines_sql("benchmark", "item_id")} SELECT doc_id, row, greatest(src_start, 9) AS src_start,
            least(src_end, 250) AS src_end, greatest(src_start, 9) - src_start AS start_col, least(src_end, 250) - src_start AS end_col
        FROM lined WHERE greatest(src_start, 9) < least(src_end, 250)""",
    "selection_extract": """SELECT item_id AS doc_id, text[10:250] AS source_text, text[10:250] AS visible_text,
        CAST(len(string_split(text[10:250], chr(10))) AS INT) AS visible_rows FROM benchmark""",
    "ranges_at": f"""WITH {_RANGES} SELECT r.doc_id, id, src_start, src_end FROM ranged r JOIN orders ON o_orderkey = r.doc_id
        WHERE src_start <= 9 AND 9 < src_end OR src_start = src_end AND src_start = 9""",
    "ranges_overlap": f"""WITH {_RANGES}, asked AS (SELECT o_orderkey AS doc_id, 6 AS q_start, CAST(6 + o_orderkey % 9 AS INT) AS q_end FROM orders)
        SELECT r.doc_id, q_end, id, src_start, src_end FROM ranged r JOIN asked a ON a.doc_id = r.doc_id
        WHERE CASE WHEN q_start = q_end THEN src_start <= q_start AND (q_start < src_end OR src_end = q_start AND src_start = q_start)
            WHEN src_start = src_end THEN src_start >= q_start AND src_start < q_end ELSE src_start < q_end AND src_end > q_start END""",
    "ranges_append": f"""WITH {_RANGES}, both_ranges AS (SELECT doc_id, src_start, src_end FROM ranged UNION ALL SELECT o_orderkey, 0, 5 FROM orders)
        SELECT doc_id, count(*) AS n, CAST(min(src_start) AS BIGINT) AS first, CAST(sum(src_end) AS BIGINT) AS ends FROM both_ranges GROUP BY doc_id""",
    "search_literal": f"WITH {_HITS} SELECT doc_id, match_index, src_start, src_end FROM hit",
    "search_ignoring_case": """SELECT doc_id, CAST(len(string_split(lower(text), 'the')) - 1 AS BIGINT) AS n FROM documents
        WHERE contains(lower(text), 'the')""",
    "search_ignoring_accented_case": """WITH t AS (SELECT doc_id, replace(text, 'the', 'THÉ') AS text FROM documents), c AS (
            SELECT doc_id, 'thé' AS query, len(string_split(lower(text), 'thé')) - 1 AS matches FROM t
            UNION ALL SELECT doc_id, 's', len(string_split(text, 'S')) - 1 FROM t
        ) SELECT doc_id, query, CAST(matches AS BIGINT) AS matches FROM c WHERE matches > 0""",
    "search_projected": f"""WITH {_wrapped_sql(80)}, {_HITS.replace("text FROM documents WHERE text IS NOT NULL", "text FROM letters")}, ends AS (
            SELECT h.doc_id, match_index, h.src_start, h.src_end FROM hit h
        ), first AS (
            SELECT e.*, l.row AS start_row, e.src_start - l.src_start AS start_col FROM ends e ASOF JOIN lined l ON e.doc_id = l.doc_id AND e.src_start >= l.src_start
        ), last AS (
            SELECT f.*, l.row AS end_row, f.src_end - l.src_start AS end_col, l.src_start AS begun
            FROM first f ASOF JOIN lined l ON f.doc_id = l.doc_id AND f.src_end >= l.src_start
        ) SELECT doc_id, match_index, start_row, CAST(start_col AS INT) AS start_col, end_row, CAST(end_col AS INT) AS end_col,
            CAST(CASE WHEN begun < src_end THEN end_row - start_row + 1 ELSE end_row - start_row END AS INT) AS fragments FROM last""",
    "search_after_each": f"""WITH {_HITS}, asked AS (SELECT doc_id, CAST(length(text) // 2 AS INT) AS "offset" FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, 'after' AS side, "offset", min(match_index) AS match_index, min(src_start) AS src_start
        FROM hit JOIN asked USING (doc_id) WHERE src_start >= "offset" GROUP BY ALL
        UNION ALL SELECT doc_id, 'before', "offset", max(match_index), max(src_start) FROM hit JOIN asked USING (doc_id) WHERE src_start < "offset" GROUP BY ALL""",
    "search_whole_word": f"""WITH {_HITS} SELECT doc_id, src_start, src_end FROM hit
        WHERE NOT regexp_matches(text[src_start:src_start], '^[0-9A-Za-z_]$') AND NOT regexp_matches(text[src_end + 1:src_end + 1], '^[0-9A-Za-z_]$')""",
    "search_regex": """WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3,}')) AS t FROM documents)
        SELECT doc_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM m GROUP BY doc_id""",
    "search_scoped": f"""WITH {_HITS}, scoped AS (
            SELECT doc_id, src_start, src_end, scope_id FROM hit, (VALUES ('head', 0, 200), ('next', 100, 400)) s(scope_id, a, b)
            WHERE a <= src_start AND src_end <= b
        ), numbered AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY src_start, src_end, scope_id) - 1 AS INT) AS match_index FROM scoped
        ) SELECT doc_id, match_index, src_start, src_end, scope_id FROM numbered WHERE match_index < 5""",
    "search_limit": """WITH c AS (SELECT doc_id, len(string_split(text, 'the')) - 1 AS n FROM documents)
        SELECT doc_id, CAST(6 AS BIGINT) AS match_limit, CAST(least(n, 6) AS BIGINT) AS stored, n > 6 AS truncated FROM c""",
    "search_before_after": f"""WITH {_HITS} SELECT doc_id, 'after' AS side, min(match_index) AS match_index, min(src_start) AS src_start
        FROM hit WHERE src_start >= 150 GROUP BY doc_id
        UNION ALL SELECT doc_id, 'before', max(match_index), max(src_start) FROM hit WHERE src_start < 150 GROUP BY doc_id""",
    "search_range": f"""WITH {_HITS}, met AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY match_index) AS k FROM hit
            WHERE src_start < 300 AND src_end > 50)
        SELECT doc_id, match_index, src_start FROM met WHERE k <= 4""",
    "rich_visible": """SELECT conv_id * 1000 + turn AS doc_id, md5(text) AS digest,
        CAST(len(string_split(text, 'the')) - 1 + len(string_split(text, ' of ')) - 1 AS INT) AS spans, 1 AS diagnostics FROM conversations""",
    "rich_spans": f"""WITH {_HITS.replace("SELECT doc_id, string_split(text, 'the') AS parts, text FROM documents", "SELECT conv_id * 1000 + turn AS doc_id, string_split(text, 'the') AS parts, text FROM conversations")}
        SELECT doc_id, src_start, src_end, 'ansi:31' AS fg, TRUE AS bold FROM hit""",
    "rich_diagnostics": """SELECT 'unsupported-control' AS kind, 'csi-unsupported' AS code, 'csi' AS family, 4 AS raw_length,
        '9a378348' AS fingerprint, count(*) AS n FROM conversations""",
    "append_flow": """WITH t AS (SELECT conv_id AS doc_id, turn AS seq, text FROM conversations)
        SELECT doc_id, seq, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq, text) - 1 AS INT) AS generation, CAST(length(text) AS INT) AS appended,
            CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seq, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS stable_prefix,
            CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seq, text) AS INT) AS length FROM t""",
    "rich_fragments": f"""WITH {_lines_sql("conversations", "conv_id * 1000 + turn")}, marked AS (
            SELECT doc_id, line, trim(regexp_replace(replace(replace(line, 'the', chr(1) || 'the' || chr(1)), ' of ', ' ' || chr(1) || 'of' || chr(1) || ' '),
                chr(1) || '+', chr(1), 'g'), chr(1)) AS edges FROM lined
        ) SELECT doc_id, count(*) AS rows, CAST(sum(CASE WHEN line = '' THEN 0 ELSE len(string_split(edges, chr(1))) END) AS BIGINT) AS parts,
            CAST(0 AS BIGINT) AS torn FROM marked GROUP BY doc_id""",
    "selection_extract_documents": """WITH cut AS (SELECT doc_id, text[length(text) // 4 + 1:length(text) - length(text) // 4] AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5(t) AS source_md5, md5(trim(t, chr(10))) AS visible_md5,
            CAST(CASE WHEN trim(t, chr(10)) = '' THEN 0 ELSE len(string_split(trim(t, chr(10)), chr(10))) END AS INT) AS visible_rows FROM cut""",
    "append_rows": f"WITH {_wrapped_sql(80, _GROWN)} SELECT {_TOLD} FROM lined",
    "text_width_narrow_all": f"WITH {_ALL_LINES} SELECT source_table, doc_id, CAST(line AS INT) AS line, CAST(length(t) AS INT) AS width FROM q",
    "text_width_ambiguous_wide_all": f"""WITH {_ALL_LINES} SELECT source_table, doc_id, CAST(line AS INT) AS line,
        CAST(length(t) + len(regexp_extract_all(t, '[ÆÐ×ØÞßàáæèéêìíðòó÷øùúüþ]')) AS INT) AS width FROM q""",
    "prepare_segments_documents": """WITH c AS (SELECT doc_id, CAST(length(text) AS INT) AS source_len, unnest(string_split(text, '')) AS ch FROM documents)
        SELECT doc_id, source_len, CASE ch WHEN ' ' THEN 'preserved-space' WHEN chr(10) THEN 'hard-break' ELSE 'text' END AS kind,
            count(*) AS chars FROM c WHERE ch <> '' GROUP BY ALL""",
    "cursor_for_offset_documents": f"""WITH {_WITHIN} SELECT doc_id, CAST("offset" AS INT) AS "offset",
        CAST(least("offset", length(text)) AS INT) AS src_offset, "offset" <= length(text) AS exact FROM asked""",
    "project_offset_documents": f"""WITH {_WITHIN}, placed AS (
            SELECT *, least("offset", length(text)) AS spot, text[1:least("offset", length(text))] AS head FROM asked
        ) SELECT doc_id, CAST("offset" AS INT) AS "offset", CAST(length(head) - length(replace(head, chr(10), '')) AS INT) AS row,
            CAST(length(list_last(string_split(head, chr(10)))) AS INT) AS "column", CAST(spot AS INT) AS src_offset,
            "offset" <= length(text) AS exact, spot = length(text) AS at_end FROM placed""",
    "project_cell_documents": f"""WITH {_lines_sql()}, asked AS (SELECT *, unnest([4, 500]) AS q FROM lined WHERE row IN (0, 2, 9))
        SELECT doc_id, row AS q_row, CAST(q AS INT) AS q_column, row, CAST(least(q, width) AS INT) AS "column", CAST(src_start + least(q, width) AS INT) AS src_offset,
            q <= width AS exact FROM asked""",
    "project_range_documents": f"""WITH {_wrapped_sql(80)}, cropped AS (
            SELECT *, greatest(src_start, length(text) // 4) AS lo, least(src_end, length(text) - length(text) // 4) AS hi FROM lined
        ) SELECT doc_id, row, CAST(lo AS INT) AS src_start, CAST(hi AS INT) AS src_end, CAST(lo - src_start AS INT) AS start_col,
            CAST(hi - src_start AS INT) AS end_col FROM cropped WHERE lo < hi""",
}
