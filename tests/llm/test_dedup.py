import random

import pytest

from gridloom.llm import dedup, graph


def sets(text, size):
    words = (text or "").lower().encode().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < size else frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    told = [(i, sets(t, size)) for i, t in rows]
    for k, (i, a) in enumerate(told):
        for j, b in told[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in told}


@pytest.fixture(scope="module")
def copies():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=4)) for _ in range(400)]
    docs = []
    for count in (150, 30, 6):
        base = [r.choice(words) for _ in range(110)]
        for _ in range(count):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
                t[r.randrange(len(t))] = r.choice(words)
            docs.append(" ".join(t))
    docs += ["", "  ", None, "one", "One", "a b", "a b c", "A b  c"]
    r.shuffle(docs)
    return [(i * 7 % 1009, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 256), (3, 85, 8), (5, 80, 16)])
def test_components_are_those_of_all_pairs(spark, copies, monkeypatch, size, percent, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "SIG_BLOCK", block)
    monkeypatch.setattr(dedup, "TILE", block // 2)
    found = dedup.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(copies, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_index_covers_every_pair_within_the_distance():
    import numpy as np

    rng = np.random.default_rng(1)
    distance = dedup.max_distance(85)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, (1, dedup.SLOTS), dtype=np.uint16)
        b = a.copy()
        at = rng.choice(dedup.SLOTS, distance, replace=False)
        b[0, at] ^= 1
        assert (dedup.index_keys(a, distance) == dedup.index_keys(b, distance)).any()


def test_messy_rows(messy):
    found = dedup.near_duplicates(messy, 3, 85).collect()
    assert len(found) == messy.count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.component_id for r in by[2]] == [1, 1] and by[8][0].component_id == 1
    assert by[3][0].n_shingles == by[4][0].n_shingles == by[6][0].n_shingles == 0
    assert by[3][0].component_id == 3 and by[4][0].component_id == 4
    assert by[None][0].component_id is None and by[None][0].kept
    kept = dedup.deduplicate(messy)
    assert kept.columns == messy.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "None"]


def test_empty_table(none):
    assert dedup.near_duplicates(none).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "u long, v long")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert set(roots.values()) == {0, 1000} and len(roots) == 303


def test_a_chain_of_texts_whose_rows_all_occur_twice(spark):
    words = ["".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(400)]
    chain = [(i * 37 % 61, " ".join(words[3 * i : 3 * i + 110])) for i in range(60)]
    found = dedup.near_duplicates(spark.createDataFrame(chain * 2, "doc_id long, text string"), 3, 85).collect()
    assert len(found) == 120 and {r.component_id for r in found} == {0}


def test_each_text_of_an_id_finds_its_partner(spark):
    words = ["".join(random.Random(i).choices("abcdefghij", k=6)) for i in range(4000)]
    rows = []
    for k in range(10):
        a, b = words[400 * k : 400 * k + 120], words[400 * k + 200 : 400 * k + 320]
        rows += [(3 * k, " ".join(a)), (3 * k, " ".join(b)), (3 * k + 1, " ".join([*a[:-1], "x"])), (3 * k + 2, " ".join([*b[:-1], "x"]))]
    found = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i // 3 * 3 for i in range(30)}


def test_blocks_are_bounded_by_bytes_too(spark, copies, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_BYTES", 4000)
    found = dedup.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(copies, 3, 85)


@pytest.mark.parametrize("block", [1, 2, 5, 100])
def test_meetings_hold_every_pair_of_different_components_once_or_more(spark, block):
    rows = [("g", i, 0 if i < 20 else i - i % 3, 1) for i in range(33)] + [("h", 1, 1, 1), ("h", 2, 1, 1)]
    met = dedup.open_meetings(spark.createDataFrame(rows, "grp string, rep long, root long, bytes int"), "grp", block)
    seen = set()
    for table in dedup._runs(iter(met.orderBy("grp", "bi", "bj").toArrow().to_batches()), ("grp", "bi", "bj")):
        one, two = dedup._sides(table)
        ids, root = table["rep"].to_numpy(), table["root"].to_numpy()
        seen |= {(*sorted((int(ids[i]), int(ids[j]))),) for i in one for j in two if root[i] != root[j]}
    root = {i: r for g, i, r, _ in rows if g == "g"}
    assert seen == {(i, j) for i in root for j in root if i < j and root[i] != root[j]}


def test_members_of_buckets_are_worked_out_once(spark, copies, monkeypatch):
    """Meetings read their members twice, so these come from a table and not from the joins that find them."""
    given = []

    def meetings(members, by, block, really=dedup.open_meetings):
        given.append(members._jdf.queryExecution().optimizedPlan().toString())
        return really(members, by, block)

    monkeypatch.setattr(dedup, "open_meetings", meetings)
    dedup.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), 3, 85).collect()
    assert given and all("Join" not in plan for plan in given)
