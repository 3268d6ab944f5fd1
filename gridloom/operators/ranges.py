"""Annotated source ranges: doc_id, id, kind, src_start, src_end, tags, data (JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _units(text: str) -> Column:
    """A key that sorts texts by UTF-16 code units, as surrogates come before U+E000 and what follows it."""
    return F.encode(F.col(text), "UTF-16BE")


def _ordered(frame: DataFrame, by: list[str]) -> DataFrame:
    """By start, falling end, id and kind; ranges that agree in all keep the order of ``ord``, if there is one."""
    return frame.orderBy(*by, "src_start", F.desc("src_end"), _units("id"), _units("kind"), *(["ord"] if "ord" in frame.columns else []))


def invalid_ranges(ranges: DataFrame) -> DataFrame:
    """Rows that no index may hold, with a reason; repeated ids of a document are told once."""
    why = (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "empty id")
        .when(F.coalesce(F.col("kind"), F.lit("")) == "", "empty kind")
        .when(F.col("src_start").isNull() | F.col("src_end").isNull() | (F.col("src_start") < 0) | (F.col("src_end") < F.col("src_start")), "bad bounds")
    )
    if "data" in ranges.columns:
        why = why.when(F.col("data").isNotNull() & F.try_parse_json("data").isNull(), "data is not JSON")
    bad = ranges.withColumn("reason", why).filter("reason is not null").select("doc_id", "id", "reason")
    twice = ranges.groupBy("doc_id", "id").agg(F.count("*").alias("n")).filter("n > 1")
    return bad.unionByName(twice.select("doc_id", "id", F.lit("repeated id").alias("reason")))


def _checked(ranges: DataFrame) -> DataFrame:
    bad = (
        (F.coalesce(F.col("id"), F.lit("")) == "") | (F.coalesce(F.col("kind"), F.lit("")) == "")
        | F.coalesce((F.col("src_start") < 0) | (F.col("src_end") < F.col("src_start")), F.lit(True))
    )
    if "data" in ranges.columns:
        bad = bad | (F.col("data").isNotNull() & F.try_parse_json("data").isNull())
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid range "), F.coalesce("id", F.lit("null")))).cast("int")).otherwise(F.col("src_start"))
    return ranges.withColumn("src_start", checked)


def _unique(ranges: DataFrame) -> DataFrame:
    """The ranges, with an error where they are read for an id that a document has twice.

    A window over (document, id) needs one exchange on a key that is unique in valid data.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "id"))
    twice = F.raise_error(F.concat(F.lit("repeated range id "), F.col("id"))).cast("int")
    return ranges.withColumn("_n", n).withColumn("src_start", F.when(F.col("_n") > 1, twice).otherwise(F.col("src_start"))).drop("_n")


def create(ranges: DataFrame) -> DataFrame:
    """The ranges, checked where they are read: bad bounds, empty names, data that is not JSON and ids that a
    document has twice are errors."""
    return _unique(_checked(ranges))


def append(ranges: DataFrame, more: DataFrame) -> DataFrame:
    """Both sets of ranges; an id that a document has twice is an error where rows are read."""
    return _unique(_checked(ranges).unionByName(_checked(more), allowMissingColumns=True))


def holds(offset: Column) -> Column:
    """Half-open containment; an empty range holds its own point."""
    s, e = F.col("src_start"), F.col("src_end")
    return ((s <= offset) & (offset < e)) | ((s == e) & (s == offset))


def overlaps(start: Column, end: Column) -> Column:
    """Overlap with a range; a collapsed query is a point, and an empty range is met from its point on."""
    s, e = F.col("src_start"), F.col("src_end")
    empty = (s == e) & (start <= s) & (s < end)
    return F.when(start == end, holds(start)).otherwise(((s < e) & (s < end) & (e > start)) | empty)


def at_offset(ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """Ranges at each (doc_id, offset): a hash join on the document with the test as residual."""
    return requests.select("doc_id", "offset").join(ranges, "doc_id").filter(holds(F.col("offset")))


def for_source_range(ranges: DataFrame, requests: DataFrame) -> DataFrame:
    """Ranges that overlap each (doc_id, q_start, q_end)."""
    return requests.select("doc_id", "q_start", "q_end").join(ranges, "doc_id").filter(overlaps(F.col("q_start"), F.col("q_end")))


def ordered(ranges: DataFrame) -> DataFrame:
    return _ordered(ranges, ["doc_id"])
