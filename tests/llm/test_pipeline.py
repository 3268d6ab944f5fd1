import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import quality, secrets

PATH = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_do_what_they_say(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(stage(spark, states[-1], PATH))
    for state in states[:-1]:
        assert state.columns == docs.columns
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in states]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5]
    assert ids[1] == {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    texts = [r.text for r in states[4].collect()]
    assert not any(secrets.pattern_spans(t.encode()) for t in texts)
    words = {r.doc_id: len(r.text.encode().split()) for r in states[4].collect()}
    packed = {r.doc_id: r.n for r in states[5].groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n")).collect()}
    assert packed == words
    whole = {r.doc_id: r for r in states[4].collect()}
    for r in states[5].collect():
        doc = whole[r.doc_id]
        assert r.source == doc.source and (r.text or "").encode().split() == doc.text.encode().split()[r.start : r.end]
        assert r.text is None or r.text in doc.text


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, PATH).columns == ["doc_id", "source", "n_words", "piece", "start", "end", "bin_id", "bin_offset", "text"]


@pytest.mark.parametrize("k", range(4))
def test_stages_take_messy_tables(spark, k, messy):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, docs, PATH).columns == docs.columns, name
    assert stage(spark, docs.limit(0), PATH).count() == 0


def test_packing_takes_messy_tables(spark, messy):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    found = corpus_pipeline.best_fit_packing(spark, docs, PATH).collect()
    assert sum(r.piece == 0 for r in found) == docs.count() and {r.doc_id for r in found if r.bin_id is None} == {3, 4, 6}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in found:
        assert (r.text or "").split(" ") == (texts[r.doc_id] or "").split(" ")[r.start : r.end] if r.doc_id == 5 else True
        assert (r.text is None) == (r.n_words == 0)
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), PATH).count() == 0


def test_run_on_a_small_table_is_each_stage_by_hand(spark, tmp_path):
    """Rules, labels, groups, masks and bins of a small corpus, by plain loops."""
    import random
    import re

    from test_packing import check
    from test_quality import metrics

    r = random.Random(3)
    words = ["w%s" % "".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = {i: " ".join(r.choices(words, k=r.choice([4, 30, 60, 90]))) for i in range(60)}
    for i in range(60, 75):  # near copies, one with a secret
        texts[i] = texts[(i - 60) * 4 + 1] + " tail"
    texts[3] += " password = hunter22x"
    texts[9] = "a b c d e " * 12
    rows = [(i, t, "en", f"s{i % 7}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(75)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    states = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES[:4]:
        states.append(stage(spark, states[-1], str(tmp_path)))
    ids = [{x.doc_id for x in s.select("doc_id").collect()} for s in states]
    failed = {i for i, t in texts.items() if metrics(t)[0] < 10 or 100 * metrics(t)[4] > 20 * metrics(t)[0]}
    assert failed and not failed & ids[1] and ids[1] == {x.doc_id for x in quality.judge(states[0]).filter("kept").collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    up = {i: i for i in ids[2]}
    for i in sorted(ids[2]):
        for j in sorted(ids[2]):
            a, b = grams(texts[i]), grams(texts[j])
            if i < j and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    assert ids[3] == {i for i in up if up[i] == i} and len(ids[3]) < len(ids[2])
    masked = {x.doc_id: x.text for x in states[4].collect()}
    assert ids[4] == ids[3]
    for i, t in masked.items():
        assert t == re.sub(r"password = hunter22x", secrets.REDACTED, texts[i])
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check(found, {i: (f"s{i % 7}", t) for i, t in masked.items()}, 1024)
    assert {(x.doc_id, x.text) for x in found} == set(masked.items())
