"""Row lookup, pages, tails and invalidation over the rows of ``layout.walk``.

Rows are an ordinary DataFrame; write or persist it where it is used several times.
"""

from __future__ import annotations

import functools
from collections import OrderedDict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import layout
from gridloom.operators.kernel import Options, gated


def row_at(rows: DataFrame, row: int) -> DataFrame:
    return rows.filter(F.col("row") == row)


def rows_between(rows: DataFrame, start: int, count: int) -> DataFrame:
    return rows.filter((F.col("row") >= start) & (F.col("row") < start + count))


def total_rows(docs_ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of each document; documents without rows have 0."""
    counted = rows.groupBy("doc_id").agg(F.count("*").alias("rows"))
    return docs_ids.select("doc_id").join(counted, "doc_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)).cast("int"))


def page(rows: DataFrame, start_row: int, row_count: int, page_size: int = 64) -> DataFrame:
    """The rows of a page; more rows than a page holds are an error."""
    if start_row < 0 or row_count <= 0:
        raise ValueError("a page starts at a row of 0 or more and has rows")
    if row_count > page_size:
        raise ValueError(f"a page holds {page_size} rows, {row_count} were asked for")
    return rows_between(rows, start_row, row_count)


def row_of(docs: DataFrame, columns: int, row: int, **walked) -> DataFrame:
    """One row of each document; the walk ends with it."""
    if row < 0:
        raise ValueError("rows count from 0")
    return layout.walk(docs, columns, first_row=row, row_count=1, **walked)


def page_of(docs: DataFrame, columns: int, start_row: int, row_count: int, page_size: int = 64, **walked) -> DataFrame:
    """A page of each document without its other rows: the walk ends with the page."""
    if start_row < 0 or row_count <= 0:
        raise ValueError("a page starts at a row of 0 or more and has rows")
    if row_count > page_size:
        raise ValueError(f"a page holds {page_size} rows, {row_count} were asked for")
    return layout.walk(docs, columns, first_row=start_row, row_count=row_count, **walked)


def tail_of(docs: DataFrame, columns: int, row_count: int, page_size: int | None = None, **walked) -> DataFrame:
    """The last rows of each document, in one pass and without an exchange."""
    if row_count <= 0:
        raise ValueError("a tail has rows")
    if page_size is not None and row_count > page_size:
        raise ValueError(f"a page holds {page_size} rows, {row_count} were asked for")
    return layout.walk(docs, columns, last_rows=row_count, **walked)


def tail(rows: DataFrame, row_count: int, page_size: int | None = None) -> DataFrame:
    """The last rows of each document, ascending.

    The last row number comes from a partial aggregate, so no document's rows are gathered.
    """
    if row_count <= 0:
        raise ValueError("a tail has rows")
    if page_size is not None and row_count > page_size:
        raise ValueError(f"a page holds {page_size} rows, {row_count} were asked for")
    last = rows.groupBy("doc_id").agg(F.max("row").alias("_last"))
    return rows.join(last, "doc_id").filter(F.col("row") > F.col("_last") - row_count).drop("_last")


def row_for_cursor(rows: DataFrame, cursors: DataFrame) -> DataFrame:
    """The row that holds each cursor (doc_id, cursor): the first that ends after it, else the last.

    Rows and cursors of a document are sorted together, so there are no pairs of them.
    """
    asked = cursors.select("doc_id", F.struct("cursor.seg", "cursor.g").alias("at"), F.lit(1).alias("side")).distinct()
    both = rows.select("doc_id", F.struct("end.seg", "end.g").alias("at"), F.lit(0).alias("side"), "row").unionByName(asked, allowMissingColumns=True)
    by = Window.partitionBy("doc_id")
    later = by.orderBy(F.desc("at"), F.desc("side")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("row", F.coalesce(F.last("row", ignorenulls=True).over(later), F.max("row").over(by))).filter("side = 1")
    return found.select("doc_id", F.col("at").alias("cursor"), "row").join(rows, ["doc_id", "row"])


def anchors(rows: DataFrame, interval: int = 64) -> DataFrame:
    """Every ``interval``-th row's cursor: where a replay may begin."""
    if interval <= 0:
        raise ValueError("an interval is positive")
    return rows.filter(F.pmod("row", F.lit(interval)) == 0).select("doc_id", "row", "start")


def index_stats(rows: DataFrame, interval: int = 64) -> DataFrame:
    return rows.groupBy("doc_id").agg(
        F.count_if(F.pmod("row", F.lit(interval)) == 0).cast("int").alias("anchor_count"), F.count("*").cast("int").alias("rows")
    )


def first_invalid_row(rows: DataFrame, src_offset: Column) -> DataFrame:
    """The first row that a change at a source offset can reach: one before, at an exact row start."""
    hit = F.min(F.when(F.col("src_end") >= src_offset, F.when(F.col("src_start") == src_offset, F.greatest(F.col("row") - 1, F.lit(0))).otherwise(F.col("row"))))
    return rows.groupBy("doc_id").agg(F.coalesce(hit, F.max("row")).alias("first_invalid_row"))


def valid_prefix(rows: DataFrame, first_invalid: int | None = None) -> DataFrame:
    """Rows that stay when rows from ``first_invalid`` on are dropped; without a bound only row 0 stays."""
    return rows.filter(F.col("row") < (1 if first_invalid is None else max(first_invalid, 1)))


class PageCache:
    """Pages of rows that stay persisted while they are among the last ``max_pages`` asked for.

    Counters tell hits, misses, builds, evictions and pages that an invalidation has dropped.
    """

    def __init__(self, rows: DataFrame, page_size: int = 64, max_pages: int = 16, generation: int = 0):
        if page_size <= 0 or max_pages <= 0:
            raise ValueError("a cache has pages, and pages have rows")
        self.rows, self.page_size, self.max_pages, self.generation = rows, page_size, max_pages, generation
        self.pages: OrderedDict[tuple[int, int], DataFrame] = OrderedDict()
        self.counters = dict.fromkeys(("hits", "misses", "builds", "evictions", "invalidated_pages"), 0)

    def get(self, start_row: int, row_count: int) -> DataFrame:
        key = (start_row, row_count)
        if key in self.pages:
            self.counters["hits"] += 1
            self.pages.move_to_end(key)
            return self.pages[key]
        found = page(self.rows, start_row, row_count, self.page_size)
        self.counters["misses"] += 1
        self.counters["builds"] += 1
        self.pages[key] = found.persist()
        if len(self.pages) > self.max_pages:
            self._drop(next(iter(self.pages)), "evictions")
        return found

    def _drop(self, key: tuple[int, int], why: str) -> None:
        self.pages.pop(key).unpersist()
        self.counters[why] += 1

    def invalidate(self, rows: DataFrame, generation: int, first_invalid_row: int | None = None) -> None:
        """Goes on with new rows; pages whose asked-for span reaches the first invalid row are dropped, and
        without one all are."""
        if generation <= self.generation:
            raise ValueError(f"generation {generation} does not follow {self.generation}")
        for start, count in [k for k in self.pages if first_invalid_row is None or sum(k) > first_invalid_row]:
            self._drop((start, count), "invalidated_pages")
        self.rows, self.generation = rows, generation

    def clear(self) -> None:
        for key in list(self.pages):
            self._drop(key, "evictions")


class LayoutBundle:
    """Rows, a page cache and a source index of documents under one layout, with a generation that each
    append raises."""

    def __init__(
        self, docs: DataFrame, columns: int, start_column: int = 0, options: Options = Options(), page_size: int = 64, max_pages: int = 16,
        interval: int = 64, generation: int = 0, rows: DataFrame | None = None,
    ):
        self.docs, self.columns, self.start_column, self.options, self.interval = docs, columns, start_column, options, interval
        self.rows = layout.walk(docs, columns, start_column, options) if rows is None else rows
        self.cache = PageCache(self.rows, page_size, max_pages, generation)

    @property
    def generation(self) -> int:
        return self.cache.generation

    @functools.cached_property
    def source_index(self) -> DataFrame:
        return layout.clusters(self.docs, self.options)

    def page(self, start_row: int, row_count: int) -> DataFrame:
        return self.cache.get(start_row, row_count)

    def tail_page(self, row_count: int) -> DataFrame:
        return tail(self.rows, row_count, self.cache.page_size)

    def total(self) -> DataFrame:
        return total_rows(self.docs, self.rows)

    def invalidate(self, docs: DataFrame, records: DataFrame, generation: int) -> LayoutBundle:
        """The bundle of the next generation, for ``docs`` with their grown sources and the records of their
        appends (``flow.replay``: doc_id, stable_prefix, first_invalid).

        A document whose source does not begin with the one before, as long as its record says, is an error
        where rows are read.  Rows before the first that the append can reach stay; the others are laid out
        again from there.  Documents without a record keep all their rows.
        """
        if generation != self.generation + 1:
            raise ValueError(f"generation {generation} does not follow {self.generation}")
        told = records.groupBy("doc_id").agg(F.min("stable_prefix").alias("stable"), F.min("first_invalid").alias("first"))
        old = gated(self.docs, self.options, over_cores=False).select("doc_id", F.col("text").alias("old"))
        new = gated(docs, self.options, over_cores=False).select("doc_id", F.col("text").alias("text"))
        units = F.octet_length(F.encode("old", "UTF-16BE")) / 2
        grown = told.join(new, "doc_id").join(old, "doc_id", "left").withColumn("old", F.coalesce("old", F.lit("")))
        broken = (units != F.col("stable")) | ~F.startswith("text", "old")
        checked = F.when(broken, F.raise_error(F.concat(F.lit("not an append: document "), F.col("doc_id").cast("string"))).cast("int")).otherwise(F.col("first"))
        bounds = grown.select("doc_id", checked.alias("first"))
        # The first row that the change can reach, one earlier at an exact row start.
        reached = self.rows.join(bounds, "doc_id")
        hit = F.when(F.col("src_start") == F.col("first"), F.greatest(F.col("row") - 1, F.lit(0))).otherwise(F.col("row"))
        asked = reached.groupBy("doc_id").agg(
            F.coalesce(F.min(F.when(F.col("src_end") >= F.col("first"), hit)), F.max("row")).alias("from"),
            F.map_from_entries(F.collect_list(F.struct("row", "start"))).alias("starts"),
        )
        begun = bounds.join(asked, "doc_id", "left").select(
            "doc_id", F.coalesce(F.col("starts")[F.col("from")], layout.start_cursor()).alias("cursor"), F.coalesce("from", F.lit(0)).alias("row")
        )
        begun = begun.withColumn("start_column", F.when(F.col("row") == 0, self.start_column).otherwise(0))
        suffix = layout.walk_from(docs, begun, self.columns, self.options)
        kept = self.rows.join(begun.select("doc_id", F.col("row").alias("_from")), "doc_id", "left").filter("_from is null or row < _from").drop("_from")
        rows = kept.unionByName(suffix)
        out = LayoutBundle(docs, self.columns, self.start_column, self.options, self.cache.page_size, self.cache.max_pages, self.interval, generation, rows)
        self.cache.clear()
        out.cache.counters = self.cache.counters
        return out

    def metadata(self) -> dict:
        return {
            "generation": self.generation, "layout_key": self.options.key, "columns": self.columns, "start_column": self.start_column,
            "interval": self.interval, "page_size": self.cache.page_size, "max_pages": self.cache.max_pages,
        }
