"""Preparing, walking, measuring and materialising documents.

Input is a DataFrame with ``doc_id`` and ``text``.  Offsets in all outputs are UTF-16 code units of the
normalised source.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import bidi, dense
from gridloom.functions import width as W
from gridloom.functions.wrap import Row, check
from gridloom.operators.kernel import Columns, Options, gated, run_kernel, with_requests

CURSOR = "struct<seg:int,g:int>"
#: A row as the kernel gives it; ``_shaped`` makes its structs, without Python.
_FLAT = (
    "start_seg int, start_g int, end_seg int, end_g int, src_start int, src_end int, width int, columns int, start_column int,"
    " break_kind string, overflow int"
)


def start_cursor() -> Column:
    return F.struct(F.lit(0).alias("seg"), F.lit(0).alias("g"))


def row_values(row: Row) -> tuple:
    return (*row.start, *row.end, *row[2:])


def _shaped(flat: DataFrame, lead: Sequence[str], rest: Sequence[str] = ()) -> DataFrame:
    hyphen = F.when(F.col("break_kind") == "soft-hyphen", F.lit("-"))
    stop = F.struct(F.col("break_kind").alias("kind"), F.col("src_end").alias("src_offset"), hyphen.alias("text"))
    over = F.when(F.col("overflow").isNotNull(), F.struct(F.col("overflow").alias("width"), F.col("columns").alias("columns")))
    cursor = lambda side: F.struct(F.col(f"{side}_seg").alias("seg"), F.col(f"{side}_g").alias("g")).alias(side)
    told = ["src_start", "src_end", "width", "columns", "start_column"]
    return flat.select(*lead, cursor("start"), cursor("end"), *told, stop.alias("break"), over.alias("overflow"), *rest)


def _kept(docs: DataFrame, keep: Sequence[str]) -> str:
    return "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ("doc_id", *keep))


def _dense_segments(p: dense.Dense) -> list[pa.Array]:
    """Texts, kinds, starts and breaks of the segments; no string is made of any."""
    units = np.frombuffer(p.source.encode("utf-16-le"), dtype=np.uint16)
    ends = np.zeros(len(units) + 1, dtype=np.int32)  # of characters in UTF-8; none has four bytes
    np.cumsum(1 + (units >= 0x80) + (units >= 0x800), out=ends[1:])
    places = ends[np.append(p.at, len(units))]
    texts = pa.StringArray.from_buffers(len(p.at), pa.py_buffer(places), pa.py_buffer(p.source.encode()))
    return [texts, pa.array(dense.KINDS).take(pa.array(p.codes)), pa.array(p.at.astype(np.int32)), pa.array(p.parts)]


def prepare(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """One row per document: source, its length and segments, and the layout identity."""

    of = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32()]
    fields = [pa.field(n, t) for n, t in zip(("text", "kind", "src_start", "break_after", "level"), of, strict=True)]

    def rows_of(layout, row):
        p = layout.prepared
        if isinstance(p, dense.Dense):
            n, each = len(p.at), [*_dense_segments(p), pa.nulls(len(p.at), pa.int32())]
        else:
            n, level = len(p.texts), bidi.levels(p.source)
            starts = p.starts if p.utf16 is None else [p.offset(s) for s in p.starts]
            levels = pa.array([level[s] for s in p.starts], type=pa.int32()) if level else pa.nulls(n, pa.int32())
            each = [*(pa.array(v, type=t) for v, t in zip((p.texts, p.kinds, starts, p.breaks), of, strict=False)), levels]
        segments = pa.ListArray.from_arrays(pa.array([0, n], type=pa.int32()), pa.StructArray.from_arrays(each, fields=fields), type=pa.list_(pa.field("element", pa.struct(fields))))
        return Columns([[row["doc_id"]], [p.source], [p.offset(len(p.source))], [layout.tab], [layout.hyphen], [options.key], segments])

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {key}, source string, source_len int, tab int, hyphen_width int, layout_key string,"
        " segments array<struct<text:string,kind:string,src_start:int,break_after:boolean,level:int>>"
    )
    return run_kernel(gated(docs, options).select("doc_id", "text"), schema, rows_of, options)


def walk(
    docs: DataFrame, columns: int | Sequence[int], start_column: int = 0, options: Options = Options(), texts: bool = False,
    first_row: int = 0, row_count: int | None = None, last_rows: int | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """All rows of all documents, at one or several numbers of columns (a text is prepared once).

    ``start_column`` holds for the first row only.  With ``texts`` rows also carry their rendered and
    source text.  ``row_count`` rows from ``first_row`` on end the walk when they are found, and
    ``last_rows`` keeps a document's last ones; other columns of the documents go along by ``keep``.
    """
    widths = [columns] if isinstance(columns, int) else list(columns)
    for c in widths:
        check(c, start_column)

    whole = not first_row and row_count is None and last_rows is None

    def rows_of(layout, row):
        own = [row[c] for c in ("doc_id", *keep)]
        if whole and len(widths) == 1 and (found := dense.rows(layout, widths[0], start_column)) is not None:
            return dense_rows(found, own)
        return plain_rows(layout, own)

    def dense_rows(found, own):
        n, c = len(found.start), found.columns
        over = [w if w > c else None for w in found.width.tolist()] if (found.width > c).any() else [None] * n
        told = [found.start, found.start_g, found.end, found.end_g, found.src_start, found.src_end, found.width, [c] * n, [0] * n]
        kinds = [dense.ENDS[k] for k in found.kind.tolist()]
        return Columns([*([v] * n for v in own), np.arange(n), *told, kinds, over, *(found.texts() if texts else ())])

    def plain_rows(layout, own):
        for c in widths:
            found = enumerate(layout.rows(c, start_column))
            if first_row or row_count is not None:
                found = islice(found, first_row, None if row_count is None else first_row + row_count)
            if last_rows is not None:
                found = deque(found, maxlen=last_rows)
            for n, line in found:
                yield (*own, n, *row_values(line), *(layout.texts(line) if texts else ()))

    rest = ("text", "source_text") if texts else ()
    schema = f"{_kept(docs, keep)}row int, {_FLAT}" + "".join(f", {c} string" for c in rest)
    return _shaped(run_kernel(gated(docs, options).select("doc_id", *keep, "text"), schema, rows_of, options), ["doc_id", *keep, "row"], rest)


def line_stats(docs: DataFrame, columns: int, start_column: int = 0, options: Options = Options(), keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, rows and max_line_width; an empty text has none and 0."""
    check(columns, start_column)

    def rows_of(layout, row):
        widths = [line.width for line in layout.rows(columns, start_column)]
        yield (*(row[c] for c in ("doc_id", *keep)), len(widths), max(widths, default=0))

    schema = f"{_kept(docs, keep)}rows int, max_line_width int"
    return run_kernel(gated(docs, options).select("doc_id", *keep, "text"), schema, rows_of, options)


def layout_rows(docs: DataFrame, columns: int, start_column: int = 0, options: Options = Options()) -> DataFrame:
    return line_stats(docs, columns, start_column, options).select("doc_id", "rows")


def next_row(docs: DataFrame, cursors: DataFrame, columns: int, start_column: int = 0, options: Options = Options()) -> DataFrame:
    """The row at each cursor (doc_id, cursor); no row where nothing is left."""
    check(columns, start_column)

    def rows_of(layout, row):
        for asked in row["asked"]:
            at = (asked["cursor"]["seg"], asked["cursor"]["g"])
            if (line := layout.next_row(at, columns, start_column)) is not None:
                yield (row["doc_id"], *at, *row_values(line))

    flat = run_kernel(with_requests(docs, cursors.select("doc_id", "cursor"), options), f"{_kept(docs, ())}seg int, g int, {_FLAT}", rows_of, options)
    return _shaped(flat.withColumn("cursor", F.struct("seg", "g")), ["doc_id", "cursor"])


def walk_from(docs: DataFrame, cursors: DataFrame, columns: int, options: Options = Options()) -> DataFrame:
    """The rows from a cursor on, for one (doc_id, cursor, row, start_column) of each document; ``row`` is the
    number of the first, which alone begins at the start column."""

    def rows_of(layout, row):
        for asked in row["asked"]:
            found = layout.rows(columns, asked["start_column"], (asked["cursor"]["seg"], asked["cursor"]["g"]))
            for n, line in enumerate(found, asked["row"]):
                yield row["doc_id"], n, *row_values(line)

    asked = with_requests(docs, cursors.select("doc_id", "cursor", "row", "start_column"), options)
    return _shaped(run_kernel(asked, f"{_kept(docs, ())}row int, {_FLAT}", rows_of, options), ["doc_id", "row"])


def materialize(docs: DataFrame, rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds text and source_text to rows of ``walk`` (any subset of them).

    A document's rows travel as one array to its text.  Where all rows are wanted, ``walk`` with ``texts``
    needs no exchange at all.
    """
    names = [c for c in rows.columns if c != "doc_id"]

    def rows_of(layout, row):
        for asked in row["asked"]:
            line = layout.next_row((asked["start"]["seg"], asked["start"]["g"]), asked["columns"], asked["start_column"])
            yield (row["doc_id"], *(asked[n] for n in names), *layout.texts(line))

    told = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in names)
    found = run_kernel(with_requests(docs, rows, options), f"{_kept(docs, ())}{told}text string, source_text string", rows_of, options)
    return found.select(*rows.columns, "text", "source_text")


def clusters(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """Every cluster boundary, the end of the text included: doc_id, seg, g, src_offset, text, width."""

    def rows_of(layout, row):
        p = layout.prepared
        for i in range(len(p.texts)):
            group, widths = layout.clusters(i), layout.widths(i)
            for g, c in enumerate(group):
                yield row["doc_id"], i, g, p.offset(p.starts[i] + layout.local(i, g)), c, widths[g]
        yield row["doc_id"], len(p.texts), 0, p.offset(len(p.source)), None, None

    key = docs.schema["doc_id"].dataType.simpleString()
    return run_kernel(gated(docs, options).select("doc_id", "text"), f"doc_id {key}, seg int, g int, src_offset int, text string, width int", rows_of, options)


def text_width(text: Column, profile: W.WidthProfile = W.DEFAULT) -> Column:
    """Cells of a text column.  Visible ASCII is measured in the JVM's own pass over the batch."""
    @F.pandas_udf(T.IntegerType())
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else W.text_width(t, profile)).astype("Int32")

    if profile.measure is not None:
        return measured(text)
    # ASCII needs no Python: a CASE keeps such rows out of the function's result, and their input is null.
    plain = text.rlike(r"^[ -~]*\z")
    return F.when(plain, F.char_length(text)).otherwise(measured(F.when(~plain, text)))


def tab_advance(column: Column, size: int) -> Column:
    W.check_tab_size(size)
    return F.lit(size) - F.pmod(column, F.lit(size))
