import random
from collections import defaultdict

from gridloom.llm import packing


def plain(items, capacity):
    """Looks at every bin for each item."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [k for k, b in enumerate(bins) if b["left"] >= size and (source < 0 or source not in b["s"]) and (cluster < 0 or cluster not in b["c"])]
        if fits:
            k = min(fits, key=lambda k: (bins[k]["left"], k))
        else:
            bins.append({"left": capacity, "s": set(), "c": set()})
            k = len(bins) - 1
        bins[k]["left"] -= size
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
        out.append(k)
    return out


def test_the_tightest_compatible_bin_is_found():
    r = random.Random(6)
    for _ in range(60):
        items = [(r.randint(1, 40), r.choice([-1, 0, 0, 0, 1, 2]), r.choice([-1, -1, 0, 1, 2, 3])) for _ in range(r.randint(0, 120))]
        items.sort(key=lambda x: -x[0])
        assert packing.pack(items, 40) == plain(items, 40)


def check(rows, docs, capacity):
    held, parts = defaultdict(list), defaultdict(int)
    for r in rows:
        if r.bin_id is None:
            assert r.n_words == 0
            continue
        held[r.bin_id].append(r)
        parts[r.doc_id] += r.end - r.start
    for members in held.values():
        assert sum(m.end - m.start for m in members) <= capacity
        at = 0
        for m in sorted(members, key=lambda m: m.bin_offset):
            assert m.bin_offset == at
            at += m.end - m.start
        sources = [docs[m.doc_id][0] for m in members if docs[m.doc_id][0] is not None]
        assert len(sources) == len(set(sources))


def test_every_word_is_packed_once(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w%d" % r.randint(0, 5)] * r.choice([0, 1, 3, 20, 250])), r.choice(["hot", "hot", "a", "b", None])) for i in range(400)]
    found = packing.best_fit(packing.measure(spark.createDataFrame(rows, "doc_id long, text string, source string")), 100, 90).collect()
    check(found, {i: (s, t) for i, t, s in rows}, 100)
    packed = defaultdict(int)
    for f in found:
        packed[f.doc_id] += f.end - f.start
    assert packed == {i: len(t.split()) for i, t, _ in rows}


def test_shards_are_packed_as_by_a_plain_search(spark):
    from pyspark.sql import functions as F

    r = random.Random(14)
    words = ["w%d" % i for i in range(900)]
    rows, base = [], []
    for i in range(240):
        base = r.sample(words, 30) if i % 6 == 0 else base
        rows.append((i, " ".join([*base[:-1], f"x{i}"] * r.choice([1, 1, 2, 5])), r.choice(["hot", "hot", "a", "b", None])))
    measured = packing.measure(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    near = {x.doc_id: x.cluster for x in measured.collect()}
    assert 30 < len(set(near.values())) < 200  # clusters of several texts, and texts alone
    found = packing.best_fit(measured, 100, 60).collect()
    shards = 4
    of = {x.doc_id: x for x in measured.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(shards))).collect()}
    got = {(f.doc_id, f.piece): f.bin_id for f in found}
    for shard in range(shards):
        own = sorted((x for x in of.values() if x.shard == shard), key=lambda x: x.doc_id)
        pieces = [(min(100, x.n_words - k * 100), n, k, x) for n, x in enumerate(own) for k in range(-(-x.n_words // 100))]
        pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
        number = lambda names: {v: i for i, v in enumerate(sorted({str(x) for x in names if x is not None}))}
        sources, clusters = number(x.source for x in own), number(x.cluster for x in own)
        bins = plain([(size, sources.get(x.source, -1), clusters[str(x.cluster)]) for size, _, _, x in pieces], 100)
        assert [got[x.doc_id, k] for _, _, k, x in pieces] == [shard << 32 | b for b in bins]
    held = defaultdict(list)
    for f in found:
        held[f.bin_id].append(near[f.doc_id])
    assert all(len(m) == len(set(m)) for m in held.values())


def test_messy_and_empty_tables(messy, none):
    found = packing.pack_documents(messy).collect()
    assert sum(f.end - f.start for f in found if f.doc_id == 5) == 30_000
    assert {f.doc_id for f in found if f.bin_id is None} == {3, 4, 6}
    assert sum(f.piece == 0 for f in found) == messy.count()
    assert packing.pack_documents(none).count() == 0


def test_no_bin_holds_two_near_copies(spark):
    r = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    rows, group = [], {}
    for k in range(6):
        base = r.sample(words, 60)
        for n in range(5):
            i = None if (k, n) == (0, 0) else 5 * k + n
            rows.append((i, " ".join([*base[:-1], f"x{n}"]), f"s{5 * k + n}"))
            group[i] = k
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    held = defaultdict(list)
    for f in found:
        held[f.bin_id].append(group[f.doc_id])
    assert len(found) == len(rows) and all(len(m) == len(set(m)) for m in held.values())
