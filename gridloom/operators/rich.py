"""Inline ANSI over DataFrames: visible texts, spans, diagnostics, fragments and extraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.functions import ansi
from gridloom.functions.segment import Prepared
from gridloom.functions.wrap import check
from gridloom.operators import telemetry
from gridloom.operators.kernel import OUT_ROWS, Options, _batch, spread

STYLE = "struct<fg:string,bg:string,bold:boolean,dim:boolean,italic:boolean,underline:boolean,inverse:boolean,strikethrough:boolean>"
_STYLE_NAMES = ("fg", "bg", "bold", "dim", "italic", "underline", "inverse", "strikethrough")


def _style(style: dict | None) -> dict | None:
    return None if style is None else {n: style.get(n) for n in _STYLE_NAMES}


def _rows(docs: DataFrame, schema: str, rows_of, options: Options, policy: ansi.Policy) -> DataFrame:
    """``rows_of(doc_id, raw, rich)`` for each document; texts that the policy rejects go in quarantine."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out.extend(rows_of(doc, raw, ansi.tokenize(raw, options.white_space, policy)))
                except ValueError:
                    if options.on_error == "raise":
                        raise
                if len(out) >= OUT_ROWS:
                    yield _batch(out, arrow)
                    out = []
        if out:
            yield _batch(out, arrow)

    return spread(docs.filter(F.col("text").isNotNull()).select("doc_id", "text")).mapInArrow(run, kind)


def _utf16(text: str) -> Prepared:
    return Prepared(text, [], [], [], [])


def _key(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def visible(docs: DataFrame, options: Options = Options(), policy: ansi.Policy = ansi.Policy()) -> DataFrame:
    """doc_id and the visible text, with counts of spans and diagnostics; raw summary as the policy says."""

    def rows_of(doc, raw, rich):
        kept = policy.raw_retention != "none"
        sample = ansi.escape_sample(raw, policy.sample) if policy.raw_retention == "capped-sample" else None
        yield (
            doc, rich.visible, len(rich.spans), len(rich.diagnostics), rich.diagnostics_truncated, rich.spans_truncated, rich.raw_map_truncated,
            len(raw) if kept else None, ansi.fingerprint(raw) if kept else None, sample,
        )

    schema = (
        f"doc_id {_key(docs)}, text string, spans int, diagnostics int, diagnostics_truncated boolean, spans_truncated boolean,"
        " raw_map_truncated boolean, raw_length int, raw_fingerprint string, raw_sample string"
    )
    return _rows(docs, schema, rows_of, options, policy)


def spans(docs: DataFrame, options: Options = Options(), policy: ansi.Policy = ansi.Policy()) -> DataFrame:
    """Style and link spans in the order in which they were met."""

    def rows_of(doc, raw, rich):
        r, v = _utf16(raw), _utf16(rich.visible)
        for n, (kind, a, b, s, e, value) in enumerate(rich.spans):
            style = _style(value) if kind == "style" else None
            yield doc, n, kind, r.offset(a), r.offset(b), v.offset(s), v.offset(e), style, value if kind == "link" else None

    schema = f"doc_id {_key(docs)}, ord int, kind string, raw_start int, raw_end int, src_start int, src_end int, style {STYLE}, uri string"
    return _rows(docs, schema, rows_of, options, policy)


def diagnostics(docs: DataFrame, options: Options = Options(), policy: ansi.Policy = ansi.Policy()) -> DataFrame:
    def rows_of(doc, raw, rich):
        r = _utf16(raw)
        for n, d in enumerate(rich.diagnostics):
            a, b = r.offset(d["raw_start"]), r.offset(d["raw_end"])
            yield (doc, n, d["kind"], d["code"], d["family"], a, b, b - a, d["sample"], d["sample_truncated"], d["fingerprint"], d["redacted"], d["profile"])

    schema = (
        f"doc_id {_key(docs)}, ord int, kind string, code string, family string, raw_start int, raw_end int, raw_length int, sample string,"
        " sample_truncated boolean, fingerprint string, redacted boolean, profile string"
    )
    return _rows(docs, schema, rows_of, options, policy)


def raw_map(docs: DataFrame, options: Options = Options(), policy: ansi.Policy = ansi.Policy()) -> DataFrame:
    """Where each visible run stood in the raw text."""

    def rows_of(doc, raw, rich):
        r, v = _utf16(raw), _utf16(rich.visible)
        for a, b, s, e in rich.raw_map:
            yield doc, r.offset(a), r.offset(b), v.offset(s), v.offset(e)

    return _rows(docs, f"doc_id {_key(docs)}, raw_start int, raw_end int, src_start int, src_end int", rows_of, options, policy)


def fragments(
    docs: DataFrame, columns: int, start_column: int = 0, options: Options = Options(), policy: ansi.Policy = ansi.Policy(), reemit: str = "none"
) -> DataFrame:
    """Rows of the visible text with their fragments, and with sequences where asked and allowed."""
    check(columns, start_column)
    if reemit not in ("none", "sgr", "sgr-osc8"):
        raise ValueError("reemit must be none, sgr or sgr-osc8")
    mode = "none" if "none" in (reemit, policy.reemit) else "sgr" if policy.reemit == "sgr" else reemit

    def rows_of(doc, raw, rich):
        layout = options.layout(rich.visible)
        at = layout.prepared.offset
        index = ansi.SpanIndex(rich.spans)
        for n, row in enumerate(layout.rows(columns, start_column)):
            parts, told = ansi.fragments(layout, row, index, mode, policy.max_ansi_output)
            cells = [
                {"text": t, "source_text": s, "src_start": at(a), "src_end": at(b), "start_col": x, "end_col": y, "style": _style(style), "link": link}
                for t, s, a, b, x, y, style, link in parts
            ]
            yield doc, n, row.src_start, row.src_end, row.width, row.break_kind, layout.texts(row)[0], cells, told

    schema = (
        f"doc_id {_key(docs)}, row int, src_start int, src_end int, width int, break_kind string, text string, fragments array<struct<text:string,"
        f"source_text:string,src_start:int,src_end:int,start_col:int,end_col:int,style:{STYLE},link:string>>, ansi_text string"
    )
    return _rows(docs, schema, rows_of, options, policy)


def visible_for_raw(found: DataFrame, requests: DataFrame) -> DataFrame:
    """Where each (doc_id, q_start, q_end) of the raw text lies in the visible one: the entries of
    ``raw_map`` that it meets."""
    asked = requests.select("doc_id", "q_start", "q_end")
    return asked.join(found, "doc_id").filter((F.col("raw_start") < F.col("q_end")) & (F.col("raw_end") > F.col("q_start")))


def raw_for_visible(found: DataFrame, requests: DataFrame) -> DataFrame:
    """The entries of ``raw_map`` that each (doc_id, q_start, q_end) of the visible text meets."""
    asked = requests.select("doc_id", "q_start", "q_end")
    return asked.join(found, "doc_id").filter((F.col("src_start") < F.col("q_end")) & (F.col("src_end") > F.col("q_start")))


def memory(docs: DataFrame, options: Options = Options(), policy: ansi.Policy = ansi.Policy()) -> DataFrame:
    """Amounts and modelled bytes of each document's visible text, spans, diagnostics and raw map."""

    def rows_of(doc, raw, rich):
        units = lambda t: _utf16(t).offset(len(t))
        styles = [s[5] for s in rich.spans if s[0] == "style"]
        told = [d[k] or "" for d in rich.diagnostics for k in ("code", "fingerprint", "family", "sample")]
        told += [s[5] for s in rich.spans if s[0] == "link"]
        if policy.raw_retention == "capped-sample":
            told.append(ansi.escape_sample(raw, policy.sample))
        n, d, m = len(rich.spans), len(rich.diagnostics), len(rich.raw_map)
        yield doc, units(rich.visible) + sum(map(units, told)), 2 * n + 4 * m + d, n + d + m + sum(map(len, styles)), n + m

    found = _rows(docs, f"doc_id {_key(docs)}, chars int, slots int, entries int, ranges int", rows_of, options, policy)
    return found.withColumn("bytes", telemetry.estimated_bytes(**{c: F.col(c) for c in ("chars", "slots", "entries", "ranges")}))


def spans_for_source_range(found: DataFrame, start: int, end: int) -> DataFrame:
    """Spans that overlap a source range, in emission order."""
    return found.filter((F.col("src_start") < end) & (F.col("src_end") > start)).orderBy("doc_id", "ord")


def clipped_fragments(found: DataFrame, start: int, end: int) -> DataFrame:
    """Fragments within a source range, one row each."""
    each = found.select("doc_id", "row", F.explode("fragments").alias("f")).select("doc_id", "row", "f.*")
    inside = each.filter((F.col("src_start") < end) & (F.col("src_end") > start))
    lo, hi = F.greatest("src_start", F.lit(start)), F.least("src_end", F.lit(end))
    return inside.select("doc_id", "row", lo.alias("src_start"), hi.alias("src_end"), F.substr("source_text", lo - F.col("src_start") + 1, hi - lo).alias("source_text"), "style", "link")


def extract(
    docs: DataFrame, requests: DataFrame, columns: int, start_column: int = 0, options: Options = Options(), policy: ansi.Policy = ansi.Policy(), reemit: str = "none"
) -> DataFrame:
    """Each (doc_id, q_start, q_end) of the visible text: its source text and its fragments within it, row by row."""
    parts = fragments(docs, columns, start_column, options, policy, reemit).select("doc_id", "row", F.explode("fragments").alias("f"))
    asked = requests.select("doc_id", "q_start", "q_end").distinct()
    met = asked.join(parts, "doc_id").filter((F.col("f.src_start") < F.col("q_end")) & (F.col("f.src_end") > F.col("q_start")))
    lo, hi = F.greatest("f.src_start", "q_start"), F.least("f.src_end", "q_end")
    text = F.substr("f.source_text", lo - F.col("f.src_start") + 1, hi - lo)
    cut = F.struct("row", lo.alias("src_start"), hi.alias("src_end"), text.alias("source_text"), F.col("f.style").alias("style"), F.col("f.link").alias("link"))
    found = met.groupBy("doc_id", "q_start", "q_end").agg(F.array_sort(F.collect_list(cut)).alias("fragments"))
    texts = visible(docs, options, policy).select("doc_id", F.col("text").alias("_text"))
    whole = asked.join(texts, "doc_id").withColumn("source_text", F.substr("_text", F.col("q_start") + 1, F.greatest(F.lit(0), F.col("q_end") - F.col("q_start"))))
    return whole.drop("_text").join(found, ["doc_id", "q_start", "q_end"], "left")


def extract_selection(docs: DataFrame, selections: DataFrame, columns: int, **how) -> DataFrame:
    """``extract`` for selections (``projection.select_cells`` over the visible texts)."""
    return extract(docs, selections.select("doc_id", F.col("src_start").alias("q_start"), F.col("src_end").alias("q_end")), columns, **how)
