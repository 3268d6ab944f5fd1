import itertools

import numpy as np

from gridloom.llm import pulearn, quality


def metrics(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


TEXTS = ["", None, "a b c", "x y z w v " * 3, "one\none\n \n\none two\n", "a # b $ c % d & e | f < g > h * i j", "é ü " * 20, "same line here\n" * 9,
         "The quick brown fox jumps over the lazy dog near the old river bank."]


def test_metrics_are_exact(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r.doc_id: r for r in quality.judge(rows, metrics=quality.METRICS).collect()}
    for i, text in enumerate(TEXTS):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == metrics(text), text


def test_the_order_of_rules_does_not_change_the_verdict():
    import pyarrow as pa

    from gridloom.llm import textkit as tk

    column = pa.array([t or "" for t in TEXTS])
    for _, _, offsets, data in tk.slices(column):
        whole = quality.Measures(offsets, data)
        want = ~np.any([r.rejects(whole) for r in quality.RULES], axis=0)
        for order in itertools.permutations(quality.RULES):
            assert (quality.cascade(quality.Measures(offsets, data), order) == want).all()


def test_rules_on_messy_and_empty_tables(messy, none):
    kept = quality.filter_documents(messy)
    assert kept.columns == messy.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, None, 8} and not {3, 4, 6} & {r.doc_id for r in kept.collect()}
    assert quality.filter_documents(none).count() == 0
    assert [r.name for r in quality.plan_cascade(none)] == [r.name for r in quality.RULES]


def test_risk_and_its_gradient_are_those_of_plain_loops():
    import math

    rng = np.random.default_rng(4)
    p, u = rng.normal(0.5, 1, (30, 4)), rng.normal(-0.5, 1, (50, 4))
    loss = lambda z: 1 / (1 + math.exp(z))

    def plain(w, prior):
        g = lambda x: sum(a * b for a, b in zip(x, w, strict=True))
        first = prior * sum(loss(g(x)) for x in p) / len(p)
        return first, sum(loss(-g(x)) for x in u) / len(u) - prior * sum(loss(-g(x)) for x in p) / len(p)

    met = set()
    for prior in (0.1, 0.5, 0.95):
        for _ in range(8):
            w = rng.normal(0, 2, 4)
            first, bracket, gradient = pulearn.risk(w, p, u, prior)
            assert np.allclose((first, bracket), plain(w, prior))
            met.add(bracket >= 0)
            goal = (lambda v, q=prior: sum(plain(v, q))) if bracket >= 0 else (lambda v, q=prior: -plain(v, q)[1])
            steps = [(goal(w + 1e-5 * e) - goal(w - 1e-5 * e)) / 2e-5 for e in np.eye(4)]
            assert np.allclose(gradient, steps, atol=1e-6)
    assert met == {True, False}


def test_prior_is_the_least_bound_over_quantiles():
    rng = np.random.default_rng(2)
    pos, unl = rng.normal(1, 1, 300), np.concatenate([rng.normal(1, 1, 400), rng.normal(-3, 1, 600)])
    best = 1.0
    for k in range(35):
        cut = np.quantile(pos, 0.02 + k * 0.68 / 34)
        above = sum(x >= cut for x in unl) / len(unl)
        best = min(best, (above + (above * (1 - above) / len(unl)) ** 0.5) / (sum(x >= cut for x in pos) / len(pos)))
    assert np.isclose(pulearn.estimate_prior(pos, unl), best) and 0.35 < best < 0.5


def test_repeated_ids_are_learnt_once(spark):
    rows = [(i % 20, ("fine words in a long sentence %d. " % (i % 20)) * 5) for i in range(400)] + [(100 + i, "zz ## %d" % i) for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    every = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    one, many = (pulearn.fit(t, labels, F.lit(True)) for t in (every.dropDuplicates(["doc_id"]), every))
    assert np.allclose(one.weights, many.weights) and one.prior == many.prior


def test_prior_and_scores_of_separable_classes():
    rng = np.random.default_rng(0)
    n = pulearn.N_FEATURES
    pos, neg = rng.normal(1, 1, (600, n)), rng.normal(-1, 1, (600, n))
    unl = np.vstack([rng.normal(1, 1, (700, n)), neg[:300]])
    scorer = pulearn.fit_arrays(pos, unl)
    assert 0.6 < scorer.prior < 0.85
    assert (scorer.probability(rng.normal(1, 1, (300, n))) >= 0.3).mean() > 0.97
    assert (scorer.probability(neg[300:]) >= 0.3).mean() < 0.05


def test_classifier_on_messy_and_empty_tables(spark, messy, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 0), (6, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    from gridloom.llm.queries.op10 import fold

    scorer = pulearn.fit(messy, labels, fold() != 0)
    scores = [r.score for r in pulearn.score(messy, scorer).collect()]
    assert len(scores) == messy.count() and all(0 <= s <= 1 for s in scores)
    assert pulearn.fit(none, labels, fold() != 0).weights is None
    assert pulearn.fit(messy, labels.limit(0), fold() != 0).weights is None
    assert pulearn.score(none, scorer).count() == 0


def test_held_out_accuracy(spark):
    from gridloom.llm.queries.op10 import op10_quality_classifier

    path = "/root/testdata/sf0.01"
    scores = op10_quality_classifier(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (scores["predicted"] == scores["quality"]).mean() > 0.95
