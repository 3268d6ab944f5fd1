"""Query and oracle of the URL filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.urlfilter import Rule, judge

RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Sites that are blocked where no rule fits.
NAMES = ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
SITES = tuple(f"{n}.example.{zone}" for n in NAMES for zone in ("com", "net", "org"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES, spark.createDataFrame([(s,) for s in SITES], "key string"))


ORACLE = r"""
WITH parts AS (
    SELECT page_id,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|\.)(ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
