"""Query and oracle of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import quality
from gridloom.llm.queries.inputs import documents


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = quality.judge(docs, metrics=quality.METRICS)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept"
    )


ORACLE = r"""
WITH worded AS (
    SELECT doc_id, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windowed AS (
    SELECT *, list_transform(range(1, greatest(len(words) - 3, 1)), lambda i: array_to_string(words[i:i + 4], ' ')) AS grams
    FROM worded
), placed AS (
    SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS pos FROM windowed
), repeated AS (
    SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM placed) WHERE n > 1
), covered AS (
    SELECT doc_id, count(DISTINCT word) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS word FROM repeated) GROUP BY doc_id
), measured AS (
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM worded w LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 30 * n_words
        OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > n_words) AS kept
FROM measured
"""
