"""Query and oracle of near-duplicates at the contract's shingles and threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import dedup
from gridloom.llm.queries.inputs import documents

SHINGLE, PERCENT = 3, 85


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return dedup.near_duplicates(docs, SHINGLE, PERCENT)


ORACLE = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), shingled AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS grams
    FROM worded
), sized AS (
    SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles FROM shingled
), flat AS (
    SELECT doc_id, unnest(grams) AS gram FROM shingled
), inter AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n
    FROM flat a JOIN flat b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT u, v FROM inter JOIN sized s ON s.doc_id = u JOIN sized t ON t.doc_id = v
    WHERE 100 * n >= 85 * (s.n_shingles + t.n_shingles - n)
), sides AS (
    SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, seen) AS (
    SELECT doc_id, doc_id FROM sized
    UNION
    SELECT r.doc_id, b.v FROM reach r JOIN sides b ON r.seen = b.u
), least AS (
    SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, s.n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sized s JOIN least l ON s.doc_id = l.doc_id
"""
