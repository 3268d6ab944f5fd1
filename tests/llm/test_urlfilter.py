import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import urlfilter
from gridloom.llm.queries.op07 import RULES

URLS = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://example.net", "http://example.net/", "http://badexample.net/en/",
        "https://x.org/fr/", "https://org/fr", "http://example.com/de/1", "http://sub.example.com/de/", "x://y?z://w/e", "http://u:p@h.com:80/p\n/q?x"]


def plain(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)).name if fits else None


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    listed = spark.createDataFrame([("u:p@h.com:80",), ("other.example.org",)], "key string")
    for r in urlfilter.judge(pages, RULES, listed).collect():
        assert (r.host, r.path, r.rule) == plain(URLS[r.page_id])
        if r.rule is None:
            assert r.verdict == ("block" if r.host.endswith("h.com:80") else "allow")


@pytest.mark.parametrize(("shard_keys", "shards"), [(1 << 20, 1), (500, 6)])
def test_cascade_is_exact_on_its_universe(spark, shard_keys, shards):
    r = random.Random(1)
    universe = [f"host{r.randint(0, 10**9)}.example" for _ in range(3000)]
    listed = set(universe[:300]) | {"absent.example"}
    keys = spark.createDataFrame([(u,) for u in universe + universe[:50]] + [(None,)], "key string")
    cascade = urlfilter.build_cascade(keys, spark.createDataFrame([(k,) for k in listed], "key string"), shard_keys=shard_keys)
    assert len(cascade.hashes) == shards and all(len(h) > 1 for h in cascade.hashes)
    for row in keys.filter("key is not null").withColumn("hit", urlfilter.is_listed(cascade, F.col("key"))).collect():
        assert row.hit == (row.key in listed)


def test_a_long_list_needs_few_bytes_a_key():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, (2, 400_000), dtype=np.uint64)
    listed = np.arange(len(a)) < 40_000
    levels = urlfilter.levels_of(a, b, listed)
    assert (urlfilter.ask(levels, a, b) == listed).all()
    assert sum(len(x.words) * 8 for x in levels) < 3 * 40_000


def test_columns_with_clashing_names(spark):
    rows = [(1, "http://a.org/fr/x", "h", "p", "r", "v", True), (None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string, listed boolean")
    found = urlfilter.judge(pages, RULES, spark.createDataFrame([("a.org",)], "key string"))
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert {tuple(r) for r in found.collect()} == {(1, "a.org", "/fr/x", "org/fr/", "allow"), (None, "", "", None, "allow")}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urlfilter.judge(pages, RULES, spark.createDataFrame([("a",)], "key string")).count() == 0
    some = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in urlfilter.judge(some, RULES, spark.createDataFrame([], "key string")).collect()] == ["allow"] * 3
