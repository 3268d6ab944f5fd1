"""Search over normalised sources: literal or regular expression, with scopes and limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import projection, ranges
from gridloom.operators.kernel import Options, gated, run_kernel

_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")


def _ignoring_case(text: str, query: str) -> Iterator[tuple[int, int]]:
    """Slices of the query's UTF-16 length whose lower case is that of the query."""
    low, n = query.lower(), len(query)
    plain = max(text, default="") <= "\uffff" and max(query) <= "\uffff"
    firsts = {c for c in set(text) if c.lower()[:1] == low[:1]}
    size = sum(2 if c > "\uffff" else 1 for c in query)
    at, stop = 0, len(text)
    while at < stop:
        if text[at] in firsts:
            end = at + n
            if not plain:
                end, left = at, size
                while left > 0 and end < stop:
                    left -= 2 if text[end] > "\uffff" else 1
                    end += 1
                end = end if not left else stop + 1
            if end <= stop and text[at:end].lower() == low:
                yield at, end
                at = end
                continue
        at += 1


def find(text: str, query: str, mode: str = "literal", case_sensitive: bool = True, whole_word: bool = False, flags: str = "") -> Iterator[tuple[int, int]]:
    """Code point spans of all matches, left to right and without overlap.

    A hit that is not a whole word is passed over and not searched again.  Without case, slices of the
    query's length are compared in lower case, so a letter never matches one that only folds to it.
    ``flags`` are those of a regular expression (of ``i``, ``m``, ``s``); a case-sensitive search drops i.
    """
    if mode == "literal":
        if not query:
            raise ValueError("an empty query")
        if case_sensitive or (text.isascii() and query.isascii()):
            pattern = regex.compile(regex.escape(query), 0 if case_sensitive else regex.IGNORECASE | regex.ASCII)
            spans = (m.span() for m in pattern.finditer(text))
        else:
            spans = _ignoring_case(text, query)
    elif mode == "regex":
        if unknown := set(flags) - set("gimsuy"):
            raise ValueError(f"unknown flags {sorted(unknown)}")
        wanted = (set(flags) - {"i"}) | (set() if case_sensitive else {"i"})
        told = {"i": regex.IGNORECASE, "m": regex.MULTILINE, "s": regex.DOTALL}
        pattern = regex.compile(query, sum(told[f] for f in wanted if f in told))
        spans = (m.span() for m in pattern.finditer(text))
    else:
        raise ValueError("mode must be literal or regex")
    for a, b in spans:
        if a == b:
            raise ValueError("a regular expression matched nothing")
        if whole_word and ((a and text[a - 1] in _WORD) or (b < len(text) and text[b] in _WORD)):
            continue
        yield a, b


def range_scopes(found: DataFrame, requests: DataFrame) -> DataFrame:
    """Scopes from annotated ranges that overlap each (doc_id, q_start, q_end), cut to it; their ids name
    the scopes.  A document without ranges has no scope and so no hits."""
    met = ranges.for_source_range(found, requests)
    return met.select(
        "doc_id", F.col("id").alias("scope_id"), F.greatest("src_start", "q_start").alias("s_start"), F.least("src_end", "q_end").alias("s_end")
    )


def search(
    docs: DataFrame, query: str, mode: str = "literal", case_sensitive: bool = True, whole_word: bool = False,
    scopes: DataFrame | Sequence[tuple[str, int, int]] | None = None, match_limit: int | None = None, options: Options = Options(), flags: str = "",
) -> DataFrame:
    """doc_id, match_index, match_text, src_start, src_end, scope_id.

    ``scopes`` has doc_id, scope_id, s_start, s_end, or is a list of (scope_id, s_start, s_end) for all
    documents; a match is told once for each scope that contains it, and documents without a scope have
    none.  An empty list is an error.  Matches are numbered by start, end and scope, and
    those beyond ``match_limit`` are cut off in each document.
    """
    list(find("", query, mode, case_sensitive, whole_word, flags))
    if match_limit is not None and (not isinstance(match_limit, int) or isinstance(match_limit, bool) or match_limit <= 0):
        raise ValueError("a limit is a positive integer")
    if scopes is not None and not isinstance(scopes, DataFrame):
        if not scopes:
            raise ValueError("no scope")
        each = F.array(*[F.struct(F.lit(i).alias("scope_id"), F.lit(a).alias("s_start"), F.lit(b).alias("s_end")) for i, a, b in scopes])
        scopes = docs.select("doc_id", F.explode(each).alias("s")).select("doc_id", "s.*")

    scoped = scopes is not None

    def rows_of(layout, row):
        p = layout.prepared
        for n, (a, b) in enumerate(find(p.source, query, mode, case_sensitive, whole_word, flags)):
            if not scoped and match_limit is not None and n >= match_limit:
                break
            yield row["doc_id"], n, p.source[a:b], p.offset(a), p.offset(b)

    key = docs.schema["doc_id"].dataType.simpleString()
    found = _sources(gated(docs, options).select("doc_id", "text"), f"doc_id {key}, match_index int, match_text string, src_start int, src_end int", rows_of, options)
    if not scoped:
        return found.withColumn("scope_id", F.lit(None).cast("string"))
    inside = (F.col("s_start") <= F.col("src_start")) & (F.col("src_end") <= F.col("s_end"))
    joined = found.drop("match_index").join(scopes.select("doc_id", "scope_id", "s_start", "s_end"), "doc_id").filter(inside)
    by = Window.partitionBy("doc_id").orderBy("src_start", "src_end", "scope_id")
    numbered = joined.withColumn("match_index", F.row_number().over(by) - 1)
    if match_limit is not None:
        numbered = numbered.filter(F.col("match_index") < match_limit)
    return numbered.select("doc_id", "match_index", "match_text", "src_start", "src_end", "scope_id")


class _Plain:
    """Only the source of a prepared text; search needs no segments."""

    def __init__(self, text: str):
        from gridloom.functions.segment import Prepared

        self.prepared = Prepared(text, [], [], [], [])


class _SourceOnly:
    def __init__(self, on_error: str):
        self.on_error = on_error

    @staticmethod
    def layout(text: str) -> _Plain:
        return _Plain(text)


def _sources(frame: DataFrame, schema: str, rows_of, options: Options) -> DataFrame:
    return run_kernel(frame, schema, lambda layout, row: list(rows_of(layout, row)), _SourceOnly(options.on_error))


def match_count(matches: DataFrame) -> DataFrame:
    return matches.groupBy("doc_id").agg(F.count("*").alias("matches"))


def stats(docs: DataFrame, all_matches: DataFrame, match_limit: int | None) -> DataFrame:
    """match_limit, stored and whether matches were cut off, for each document."""
    n = F.coalesce("matches", F.lit(0))
    counted = docs.select("doc_id").join(match_count(all_matches), "doc_id", "left")
    limit = F.lit(match_limit).cast("long")
    return counted.select(
        "doc_id", limit.alias("match_limit"), F.coalesce(F.least(n, limit), n).cast("long").alias("stored"),
        F.coalesce(n > limit, F.lit(False)).alias("truncated"),
    )


def project_matches(docs: DataFrame, matches: DataFrame, columns: int, start_column: int = 0, options: Options = Options()) -> DataFrame:
    """Matches with the rows and cells of their ends, and their fragments row by row."""
    asked = matches.select("doc_id", F.col("src_start").alias("q_start"), F.col("src_end").alias("q_end")).distinct()
    told = projection.project_range_ends(docs, asked, columns, start_column, options)
    told = told.withColumnsRenamed({"q_start": "src_start", "q_end": "src_end"})
    return matches.join(told, ["doc_id", "src_start", "src_end"])


def for_source_range(matches: DataFrame, start: int | DataFrame, end: int | None = None, scope_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Matches that overlap a source range, the first ``limit`` of each document; or those of each of many
    ranges in a DataFrame (doc_id, q_start, q_end)."""
    if isinstance(start, DataFrame):
        found = start.select("doc_id", "q_start", "q_end").join(matches, "doc_id").filter((F.col("src_start") < F.col("q_end")) & (F.col("src_end") > F.col("q_start")))
        keys = ["doc_id", "q_start", "q_end"]
    else:
        found, keys = matches.filter((F.col("src_start") < end) & (F.col("src_end") > start)), ["doc_id"]
    if scope_id is not None:
        found = found.filter(F.col("scope_id") == scope_id)
    if limit is not None:
        by = Window.partitionBy(*keys).orderBy("match_index")
        found = found.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= limit).drop("_n")
    return found


_MATCH = ("match_index", "match_text", "src_start", "src_end", "scope_id")


def _beside(matches: DataFrame, requests: DataFrame, after: bool) -> DataFrame:
    """As-of lookup of (doc_id, offset): matches and requests of a document are sorted together."""
    both = matches.select("doc_id", F.col("src_start").alias("at"), F.lit(1 if after else 0).alias("side"), F.struct(*_MATCH).alias("m"))
    # A match at the offset itself is after it; of several at one offset the first (last) counts.
    asked = requests.select("doc_id", F.col("offset").alias("at"), F.lit(0).alias("side"), F.lit(True).alias("asked")).distinct()
    turn = F.desc if after else F.asc
    by = Window.partitionBy("doc_id").orderBy(turn("at"), F.desc("side") if after else F.desc("asked"), turn(F.col("m.match_index")))
    found = both.unionByName(asked, allowMissingColumns=True).withColumn("m", F.last("m", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return found.filter("asked and m is not null").select("doc_id", F.col("at").alias("offset"), "m.*")


def after_offset(matches: DataFrame, offset: int | DataFrame) -> DataFrame:
    """The first match of each document that starts at or after an offset, or of each (doc_id, offset)."""
    if isinstance(offset, DataFrame):
        return _beside(matches, offset, True)
    return matches.filter(F.col("src_start") >= offset).groupBy("doc_id").agg(F.min_by(F.struct(*_MATCH), "match_index").alias("m")).select("doc_id", "m.*")


def before_offset(matches: DataFrame, offset: int | DataFrame) -> DataFrame:
    """The last match of each document that starts before an offset, or of each (doc_id, offset)."""
    if isinstance(offset, DataFrame):
        return _beside(matches, offset, False)
    return matches.filter(F.col("src_start") < offset).groupBy("doc_id").agg(F.max_by(F.struct(*_MATCH), "match_index").alias("m")).select("doc_id", "m.*")
