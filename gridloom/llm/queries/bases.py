"""The parts of two queries that SQL can state, over the same whole tables and through the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.queries.op02 import op2_secret_scans
from gridloom.llm.queries.op08 import op8_document_fingerprints


def secret_scans_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the patterns find."""
    return op2_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and edited texts."""
    return op8_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


_ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)".replace("\\\"", '"')

ORACLES = {
    "secret_scans_base": f"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), k AS (
    SELECT doc_id, 'assign' AS kind, 0 AS turn, string_split_regex(text, '{_ASSIGN}') AS parts, regexp_extract_all(text, '{_ASSIGN}') AS hits,
        regexp_extract_all(text, '{_ASSIGN}', 2) AS told, 6 AS least FROM t
    UNION ALL
    SELECT doc_id, 'access', 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), 20 FROM t
    UNION ALL
    SELECT doc_id, 'hex', 2, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), 24 FROM t
), each AS (
    SELECT doc_id, kind, turn, least, unnest(hits) AS hit, unnest(told) AS told, unnest(parts[1:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM k
), placed AS (
    SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM each
), found AS (
    SELECT doc_id, kind, turn, stop - length(hit) AS start, stop FROM placed WHERE length(told) >= least
), summed AS (
    SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
        count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, turn) AS spans
    FROM found GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM t LEFT JOIN summed s ON s.doc_id = t.doc_id
""",
    "fingerprint_edits": """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), paired AS (
    SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS after FROM t WINDOW w AS (ORDER BY doc_id)
)
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(after, length(text) // 2)) AS edited_sha256 FROM paired
""",
}
