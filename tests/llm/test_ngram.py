import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import arrays, ngram
from gridloom.llm.queries.op03 import held_out

BASE = ["The cat sat on the mat", "the dog sat on the log", "A cat and a dog", "", "the the the cat", "on the mat the cat sat again and again"]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def plain_discounts(values):
    """Modified Kneser-Ney discounts from counts of counts; half a count where there is no estimate."""
    n = [sum(1 for c in values if c == r) for r in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = [0.0]
    for r in (1, 2, 3):
        d = r - (r + 1) * y * n[r] / n[r - 1] if n[r - 1] and n[r] else r / 2
        out.append(d if 0 < d <= r else r / 2)
    return out


class Plain:
    """The model over dictionaries."""

    def __init__(self, texts):
        self.tokens, self.pairs = Counter(), Counter()
        for t in texts:
            self.tokens.update(words(t))
            self.pairs.update(zip(["<s>", *words(t)], words(t), strict=False))
        self.follow, before = defaultdict(list), defaultdict(set)
        for (v, w), c in self.pairs.items():
            self.follow[v].append(c)
            before[w].add(v)
        self.kinds = {w: len(s) for w, s in before.items()}
        self.d, self.e = plain_discounts(self.pairs.values()), plain_discounts(self.kinds.values())

    def low(self, w):
        k, total = self.kinds.get(w, 0), sum(self.kinds.values())
        return (k - self.e[min(k, 3)]) / total + sum(self.e[min(x, 3)] for x in self.kinds.values()) / total / (len(self.kinds) + 1)

    def score(self, text):
        out = 0.0
        for v, w in zip(["<s>", *words(text)], words(text), strict=False):
            c, of = self.pairs[v, w], sum(self.follow.get(v, []))
            held = sum(self.d[min(x, 3)] for x in self.follow[v]) / of if of else 1.0
            out += math.log10((c - self.d[min(c, 3)]) / max(of, 1) + held * self.low(w))
        return out

    def base(self, text):
        n, v = sum(self.tokens.values()), len(self.tokens)
        return sum(math.log10((self.tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(text))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    words = "the cat dog sat on mat log a and again runs far".split()
    return BASE + [" ".join(r.choices(words, weights=range(12, 0, -1), k=r.randint(1, 30))) for _ in range(60)]


@pytest.mark.parametrize("shard_tokens", [4_000_000, 40])
def test_scores_are_those_of_plain_dictionaries(spark, corpus, monkeypatch, shard_tokens):
    monkeypatch.setattr(ngram, "SHARD_TOKENS", shard_tokens)
    model = ngram.fit(spark.createDataFrame(enumerate(corpus), "doc_id long, text string"))
    assert (model.shards > 20) == (shard_tokens == 40)
    asked = corpus[:10] + ["unseen words here", "cat unseen the cat", "", None, "The\x0bCAT sat"]
    found = {r.doc_id: r for r in ngram.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    plain = Plain(corpus)
    for i, text in enumerate(asked):
        r = found[i]
        assert math.isclose(r.score, plain.score(text), rel_tol=1e-9) and math.isclose(r.base_score, plain.base(text), rel_tol=1e-9), text
        assert r.n_tokens == len(words(text)) and r.n_known == sum(plain.tokens[w] > 0 for w in words(text))
        assert math.isclose(r.perplexity, 10 ** (-plain.score(text) / len(words(text))), rel_tol=1e-9)
    assert model.tokens == sum(plain.tokens.values())


def test_the_query_learns_from_four_folds(spark, corpus, tmp_path):
    import zlib

    from gridloom.llm.queries.op03 import op3_lm_scoring

    rows = [*enumerate(corpus), (900, None), (901, "The Cat sat on an unseen mat")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    plain = Plain([t for i, t in rows if not out(i)])
    found = {r.doc_id: r for r in op3_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows) and 5 < sum(r.held_out for r in found.values()) < len(rows) / 2
    for i, text in rows:
        r = found[i]
        assert r.held_out == out(i) and r.train_tokens == sum(plain.tokens.values())
        assert r.n_known == sum(plain.tokens[w] > 0 for w in words(text)) and r.n_tokens == len(words(text))
        assert math.isclose(r.base_score, plain.base(text), rel_tol=1e-9) and math.isclose(r.score, plain.score(text), rel_tol=1e-9)


def test_probabilities_add_up(spark, corpus):
    model = ngram.fit(spark.createDataFrame(enumerate(corpus), "doc_id long, text string"))
    scorer = ngram.Scorer(model)
    for prev in ("the", "cat"):
        ids = scorer.known.ids(ngram.token_hashes(np.array([0, len(prev)]), np.frombuffer(prev.encode(), dtype=np.uint8))[0])
        every = np.arange(1, model.words + 1)
        pairs = scorer._pair_counts(np.full(len(every), ids[0]), every)
        q = ngram._discounted(scorer.low[every].astype(np.int64), model.low_discounts) / model.low_total + model.low_left / (model.words + 1)
        p = ngram._discounted(pairs, model.discounts) / scorer.known.counts[ids[0]] + scorer.left[ids[0]] * q
        unknown = scorer.left[ids[0]] * model.low_left / (model.words + 1)
        assert math.isclose(p.sum() + unknown, 1.0, rel_tol=1e-9)


def test_counts_of_any_size_survive_runs_and_files(tmp_path):
    keys, counts = np.array([3, 9, 1 << 40], dtype=np.uint64), np.array([7, 3 * 2**32 + 5, 2**40], dtype=np.int64)
    again = ngram.merged([ngram._unpack(ngram._pack(keys, counts))])
    assert (again[0] == keys).all() and (again[1] == counts).all()
    both = ngram.merged([again, (keys[1:], counts[1:])])
    assert both[1].tolist() == [7, 2 * counts[1], 2 * counts[2]]
    small = np.array([1, 254, 255, 256, 2**40, 0], dtype=np.int64)
    arrays.Counts.save(str(tmp_path), "n", small)
    assert (arrays.Counts(str(tmp_path), "n")[np.array([5, 4, 3, 2, 1, 0, 4])] == small[[5, 4, 3, 2, 1, 0, 4]]).all()


def test_messy_and_empty_tables(spark, messy, none):
    model = ngram.fit(messy.filter(~held_out()))
    assert ngram.score(messy, model).count() == messy.count()
    nothing = ngram.fit(none)
    assert nothing.tokens == 0
    for r in ngram.score(messy, nothing).collect():
        assert r.score == 0.0 and r.base_score == 0.0 and r.n_known == 0
    assert ngram.score(none, model).count() == 0
