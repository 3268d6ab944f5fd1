"""Positive-unlabelled quality classifier with the non-negative unbiased risk.

Trusted positives and unlabelled texts train a linear scorer on text statistics.  With class prior
p, sigmoid loss l and scorer g the minimised risk is

    p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)])

and where the bracket falls below zero, its gradient is reversed.  The prior is estimated first: a
plain positive-versus-unlabelled logistic fit gives scores, and the prior is the smallest ratio of
unlabelled to positive mass above any score quantile of the positives (one-sided bound, the share
of unlabelled texts that look like positives).  A last Platt step on the same training rows turns
the scorer into a probability.

Only the fit uses a sample: at most ``MAX_POSITIVES`` positives and ``MAX_UNLABELLED`` unlabelled
texts, those with the smallest hash of their id.  Every text is scored, whole; a null or empty text
has the features of no words.  Without any positive every score is the prior, 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import quality
from gridloom.llm import textkit as tk

MAX_POSITIVES = 3000
MAX_UNLABELLED = 6000

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": quality.SYMBOLS,
    "stop": b".!?", "bang": b"!", "comma": b",;:", "pipe": b"|", "line": b"\n", "at": b"@", "high": range(128, 256),
    "dash": b"-_=+", "quote": b"\"'`()[]{}",
}
_IN_CLASS = np.zeros((len(_CLASSES), 256), dtype=bool)
for _row, _bytes in enumerate(_CLASSES.values()):
    _IN_CLASS[_row, list(_bytes)] = True
N_FEATURES = len(_CLASSES) + 9


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Statistics of each text; none depends on another row."""
    m = quality.Measures(offsets, data)
    n, chars = m["n_words"].astype(float), m["word_chars"].astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    per_word = 1.0 / np.maximum(n, 1.0)
    counts = [tk.sums(_IN_CLASS[k][data], offsets) for k in range(len(_CLASSES))]
    words = m["words"]
    rows = np.repeat(np.arange(len(n)), words.counts())
    hashes = tk.mix(words.hashes() ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    ranked = np.sort((hashes & np.uint64(0xFFFFFFFF)) | (rows.astype(np.uint64) << np.uint64(32)))
    new = np.ones(len(ranked), dtype=np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    distinct = tk.sums(new, words.rows)
    repeat_next = np.zeros(len(hashes), dtype=np.int64)
    repeat_next[1:] = hashes[1:] == hashes[:-1]
    columns = [np.sqrt(c / size) for c in counts]
    columns += [
        np.log1p(n) / 10.0,
        np.minimum(n, 10.0) / 10.0,
        np.minimum(chars * per_word, 30.0) / 10.0,
        np.sqrt(m["n_repeat_words"] * per_word),
        np.sqrt(m["n_dup_lines"] * per_word),
        np.sqrt(tk.sums(repeat_next, words.rows) * per_word),
        distinct * per_word,
        np.minimum(m["n_symbols"] * per_word, 1.0),
        np.minimum(m["n_repeat_words"] * per_word, 0.4),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Scorer:
    prior: float = 0.5
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def decision(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return _sigmoid(self.slope * self.decision(x) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class _Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-9)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int, decay: float) -> np.ndarray:
    w, adam = np.zeros(x.shape[1]), _Adam(x.shape[1], 0.05)
    for _ in range(steps):
        w -= adam.step(x.T @ ((_sigmoid(x @ w) - y) * weight) / weight.sum() + decay * w)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """From scores of positives and unlabelled: the least share of unlabelled above a quantile of the
    positives, over the share of positives there, with a one-sided allowance for small counts."""
    best = 1.0
    for q in np.linspace(0.02, 0.7, 35):
        cut = np.quantile(pos, q)
        above, held = np.mean(unl >= cut), np.mean(pos >= cut)
        best = min(best, (above + np.sqrt(above * (1 - above) / len(unl))) / max(held, 1e-9))
    return float(np.clip(best, 0.05, 0.95))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The positives' part of the risk, the bracket, and the direction of descent.

    The sigmoid loss is l(z) = 1 / (1 + e^z): with s = sigmoid(g), l(g) = 1 - s and l(-g) = s.  A bracket
    below zero is raised again instead of the risk being lowered further.
    """
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    gp, gu = p.T @ (sp * (1 - sp)) / len(p), u.T @ (su * (1 - su)) / len(u)
    bracket = float(su.mean() - prior * sp.mean())
    rise = gu - prior * gp
    return float(prior * (1 - sp).mean()), bracket, -prior * gp + rise if bracket >= 0 else -rise


def fit_arrays(pos: np.ndarray, unl: np.ndarray, steps: int = 600) -> Scorer:
    """The scorer from features of positives and of unlabelled texts."""
    if not len(pos) or not len(unl):
        return Scorer()
    both = np.vstack([pos, unl])
    scorer = Scorer(mean=both.mean(axis=0), scale=np.maximum(both.std(axis=0), 1e-3))
    shrink = lambda x: _with_one(np.clip((x - scorer.mean) / scorer.scale, -6, 6))
    p, u = shrink(pos), shrink(unl)
    y = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
    even = np.concatenate([np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))])
    first = _logistic(np.vstack([p, u]), y, even, 300, 1e-3)
    scorer.prior = prior = estimate_prior(p @ first, u @ first)
    w, adam, decay = first.copy(), _Adam(len(first), 0.02), 2e-3 + 1.0 / len(p)
    for _ in range(steps):
        _, _, gradient = risk(w, p, u, prior)
        w -= adam.step(gradient + decay * np.append(w[:-1], 0.0))
    scorer.weights, scorer.bias = w[:-1], float(w[-1])
    # Platt step: an unlabelled text is a positive with probability prior on average.
    zp, zu = scorer.decision(pos), scorer.decision(unl)
    cut = np.quantile(zu, 1 - prior)
    target = np.concatenate([np.ones(len(zp)), (zu >= cut).astype(float)])
    z = _with_one(np.concatenate([zp, zu])[:, None])
    weight = np.concatenate([np.full(len(zp), prior / len(zp)), np.full(len(zu), 1.0 / len(zu))])
    line = _logistic(z, target, weight, 400, 1e-3)
    scorer.slope, scorer.shift = max(float(line[0]), 1e-3), float(line[1])
    return scorer


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, offsets, data in tk.slices(tk.text_column(batch)):
                x = features(offsets, data)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
                passed = [batch.column(batch.schema.get_field_index(c)).slice(first, end - first) for c in ("doc_id", "positive")]
                yield pa.RecordBatch.from_arrays([*passed, lists], names=["doc_id", "positive", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "positive", "text").mapInArrow(run, f"doc_id {kind}, positive boolean, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Scorer:
    """Learns from documents for which ``may_learn`` (over doc_id) holds: positives are those labelled
    quality 1, unlabelled are texts without a label.  Label rows of other documents are never read."""
    usable = labels.filter(may_learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", "quality")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    positives = usable.filter("quality = 1").select("doc_id").distinct().orderBy(*order).limit(MAX_POSITIVES)
    ids = docs.filter(may_learn & F.col("doc_id").isNotNull()).select("doc_id")
    unlabelled = ids.join(usable.select("doc_id"), "doc_id", "left_anti").distinct().orderBy(*order).limit(MAX_UNLABELLED)
    chosen = positives.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    # Both sides of the union are limited by the two constants, so the broadcast is bounded.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One row of each id, however often it is repeated.
    rows = _featured(sample).groupBy("doc_id", "positive").agg(F.min("x").alias("x")).toPandas()
    if rows.empty:
        return Scorer()
    x, mark = np.stack(rows["x"].to_numpy()), rows["positive"].to_numpy(dtype=bool)
    order_rows = np.lexsort(x.T)  # the fit must not depend on the order in which tasks end
    x, mark = x[order_rows], mark[order_rows]
    return fit_arrays(x[mark], x[~mark])


def score(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` for every row."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # a few dozen numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            for first, end, offsets, data in tk.slices(tk.text_column(batch)):
                arrays = [c.slice(first, end - first) for c in passed]
                arrays.append(pa.array(held.value.probability(features(offsets, data))))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "score"])

    source = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep]
    return source.mapInArrow(run, ", ".join([*kinds, "score double"]))
