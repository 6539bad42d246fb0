"""Operator 6, quality classifier: positive-unlabelled learning.

A linear model over form features minimises the non-negative unbiased risk  pi R_P(+) + max(0, R_U(-) - pi R_P(-))  with
logistic loss (where the second term is negative, the step goes the other way, as published). Positives are trusted rows
(quality 1 and not toxic); unlabelled rows are the documents themselves; no negative label is used. The class prior pi is
estimated from the scores of a first, positive-against-unlabelled fit: over all cuts, the smallest upper bound of the share of
unlabelled rows above the cut by the share of held-out positives above it (best bin estimation).

Weights are fitted on bounded samples (POSITIVES, UNLABELLED: lowest hashed ids), whose features, not texts, reach the driver. The
prior comes from the scores of all documents, as a histogram of at most 2 * 10000 + 1 cells. Scoring is one projection of the
whole text column. Features are of form only, so toxic words go unseen, though no toxic row is a positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest_hashed, table
from .kernels import chunks, string_bytes, word_hashes

POSITIVES, UNLABELLED, SEED = 2000, 4000, 17
#: Share of trusted positives that the cut may reject at most.
POSITIVE_LOSS = 0.002
#: Digits after the point of the scores from which the prior is estimated.
BIN_DIGITS = 2
#: Classes of bytes: other, three kinds of ASCII letters and digits, 16 marks, and bytes of longer characters (not first, first).
CLASSES = 22
_CLASS = np.full(256, 0, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _i, _c in enumerate(" \n\t.,!?'\"|*$%&#-", 4):
    _CLASS[ord(_c)] = _i
_CLASS[128:192], _CLASS[192:] = 20, 21
WIDTH = CLASSES * CLASSES + 4


def features(text: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of WIDTH features for each text: square roots of the shares of byte-class bigrams, share of words equal to the
    word before, share of distinct words, mean word length and log length. A text of no words has zeros only."""
    data, offsets = string_bytes(text)
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    for i, j in chunks(offsets):
        own = offsets[i : j + 1]
        kind = _CLASS[data[own[0] : own[-1]]].astype(np.int32)
        words, rows = word_hashes(data, own)
        n = np.diff(rows)
        row = np.repeat(np.arange(j - i), n)
        pair = kind[:-1] * CLASSES + kind[1:] if len(kind) > 1 else np.zeros(0, np.int32)
        for r in range(j - i):
            lo, hi = own[r] - own[0], own[r + 1] - own[0]
            if n[r] == 0:
                continue
            if hi - lo > 1:
                out[i + r, : CLASSES * CLASSES] = np.sqrt(np.bincount(pair[lo : hi - 1], minlength=CLASSES * CLASSES) / (hi - lo - 1))
        if len(words):
            same = np.zeros(len(words))
            same[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
            by = np.lexsort((words, row))
            new = np.ones(len(words))
            new[1:] = (words[by][1:] != words[by][:-1]) | (row[by][1:] != row[by][:-1])
            some = np.maximum(n, 1)
            block = out[i:j, CLASSES * CLASSES :]
            block[:, 0] = np.bincount(row, same, minlength=j - i) / some
            block[:, 1] = np.bincount(row[by], new, minlength=j - i) / some
            block[:, 2] = np.where(n > 0, np.diff(own) / some / 20, 0)
            block[:, 3] = np.log1p(n) / 10
    return out


class Model:
    """A linear model over scaled features; `cut` is the least score that is kept."""

    def __init__(self, mean, scale, weights, bias, prior, cut=0.0):
        self.mean, self.scale, self.weights, self.bias, self.prior, self.cut = mean, scale, weights, bias, prior, cut

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores, rounded so that they don't depend on what else is in a batch."""
        return np.round(np.clip((x - self.mean) / self.scale, -5, 5) @ self.weights + self.bias, 9)


def _descend(p: np.ndarray, u: np.ndarray, prior: float, steps: int, rate: float, l2: float, nonnegative: bool) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk, or with nonnegative=False on plain logistic loss of positive against unlabelled."""
    up = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    w, m, v = np.zeros(p.shape[1] + 1), 0.0, 0.0
    for t in range(1, steps + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        grad = lambda x, dz: np.append(x.T @ dz / len(x), dz.mean())
        plus = grad(p, up(zp) - 1)  # of the loss of calling positives positive
        minus_p, minus_u = grad(p, up(zp)), grad(u, up(zu))
        if not nonnegative:
            g = plus + minus_u
        elif np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
            g = prior * plus + minus_u - prior * minus_p
        else:
            g = prior * minus_p - minus_u
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1, weight: np.ndarray | None = None) -> float:
    """Best bin estimation of the share of positives among the unlabelled, from scores of held-out positives and of unlabelled rows,
    which may be distinct scores with a weight (number of rows) each."""
    slack = lambda n: np.sqrt(np.log(4 / confidence) / (2 * n))
    weight = np.ones(len(unlabelled)) if weight is None else weight
    cuts = np.unique(np.concatenate([positive, unlabelled]))

    def above(x, w):
        by = np.argsort(x)
        below = np.concatenate([[0.0], np.cumsum(w[by])])
        return 1 - below[np.searchsorted(x[by], cuts, "left")] / w.sum()

    qp, qu = above(positive, np.ones(len(positive))), above(unlabelled, weight)
    ok = qp > 0
    bound = (qu + slack(weight.sum()) + slack(len(positive)))[ok] / qp[ok]
    best = int(np.argmin(bound))
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, loss: float = POSITIVE_LOSS, steps: int = 300, scores_of_all=None) -> Model | None:
    """A model from feature rows; None without positives or unlabelled rows. A third of each is held out, for the prior and
    for the cut: 0, or lower if more than `loss` of the held-out positives lie below 0. scores_of_all: a function of a model that gives
    (score, rows) of the whole corpus, for the prior; without it the held-out unlabelled rows stand for the corpus."""
    if len(positive) < 3 or len(unlabelled) < 3:
        return None
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 0.02
    ready = lambda x: np.clip((x - mean) / scale, -5, 5)
    held = lambda x: (x[np.arange(len(x)) % 3 != 0], x[::3])
    (p, p0), (u, u0) = held(ready(positive)), held(ready(unlabelled))
    if prior is None:
        w, b = _descend(p, u, 0.5, steps // 2, 0.02, 1e-3, False)
        found = scores_of_all(Model(mean, scale, w, b, None)) if scores_of_all else (u0 @ w + b, None)
        prior = estimate_prior(np.round(p0 @ w + b, BIN_DIGITS), np.round(found[0], BIN_DIGITS), weight=found[1])
    w, b = _descend(p, u, prior, steps, 0.02, 1e-3, True)
    model = Model(mean, scale, w, b, prior)
    model.cut = min(0.0, float(np.quantile(p0 @ w + b, loss)) - 0.05)
    return model


def histogram(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The scores of all rows, rounded to BIN_DIGITS and held within 100, and how many rows have each."""
    score = F.round(F.least(F.greatest(scorer(model)(F.col("text")), F.lit(-100.0)), F.lit(100.0)), BIN_DIGITS)
    got = docs.select(score.alias("score")).groupBy("score").agg(F.count("*").alias("n")).toArrow()
    return got["score"].to_numpy(), got["n"].to_numpy().astype(float)


def fit_from(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = SEED) -> Model | None:
    """Fits on the features of bounded samples of trusted rows and of all of docs; the prior is of all rows of docs. Null ids can't be
    sampled; of rows that repeat an id the lowest text counts."""
    d = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("id")).distinct()
    ids = d.where("id IS NOT NULL").select("id").distinct()
    p = lowest_hashed(good.join(ids, "id", "left_semi"), "id", positives, seed).select("id", F.lit(True).alias("trusted"))
    u = lowest_hashed(ids, "id", unlabelled, seed + 1).select("id", F.lit(False).alias("trusted"))
    chosen = p.union(u).select(F.col("id").alias("__id"), "trusted")
    rows = d.join(F.broadcast(chosen), F.col("id") == F.col("__id")).groupBy("id", "trusted").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "trusted", "x"])

    got = sorted(rows.mapInArrow(run, "id long, trusted boolean, x binary").collect(), key=lambda r: r.id)
    part = lambda t: np.array([np.frombuffer(r.x, np.float32) for r in got if r.trusted == t]).reshape(-1, WIDTH)
    return fit(part(True), part(False), scores_of_all=lambda m: histogram(d, m))


def scorer(model: Model):
    @F.arrow_udf("double")
    def quality_score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(features(text)).astype(np.float64))

    return quality_score


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each document: doc_id, score and keep.

    Null and empty texts have the score of all-zero features and are judged like any other. Without trusted rows or documents
    there is no model: score is null and everything is kept. A score equal to the cut is kept. Each row is judged alone: repeated
    rows repeat, an empty table gives none, other columns are ignored.
    """
    model = model or fit_from(docs, labels)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    d = docs.select("doc_id", scorer(model)("text").alias("score"))
    return d.withColumn("keep", F.col("score") >= model.cut)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier rejects."""
    model = fit_from(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    name = "__score_" + str(len(docs.columns))
    return docs.withColumn(name, scorer(model)("text")).where(F.col(name) >= model.cut).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
