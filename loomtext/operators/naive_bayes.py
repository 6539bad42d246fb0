"""Naive Bayes: training by counting, scoring by joins, increments, generation, and semi-supervised Gibbs sampling.

Labelled documents are long tables (doc_id, label, feature), one row for each occurrence of a feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logprob import ZERO, to_log
from .counts import CondCounts, Counts, cond_add_lambda, cond_dist, freq_dist, passthrough, sample
from .perceptron import interned
from .stored import once


@dataclass
class Trainer:
    """Document counts by label and feature counts by label; adding data merges counts, so batches can come one by one."""

    labels: DataFrame  # label, cnt
    features: DataFrame  # label, feature, cnt

    @classmethod
    def of(cls, docs: DataFrame) -> Trainer:
        labels = docs.select("doc_id", "label").distinct().groupBy("label").agg(F.count("*").cast("double").alias("cnt"))
        return cls(labels, once(docs.groupBy("label", "feature").agg(F.count("*").cast("double").alias("cnt"))))

    def add(self, more: Trainer) -> Trainer:
        both = lambda a, b, *k: a.unionByName(b).groupBy(*k).agg(F.sum("cnt").alias("cnt"))
        return Trainer(both(self.labels, more.labels, "label"), both(self.features, more.features, "label", "feature"))

    def model(self, lam: float = 0.0, smooth_prior=passthrough) -> Model:
        """lam = 0: plain shares; otherwise every label has every known feature with lam more, and lam for an unknown one."""
        c = CondCounts.plain(self.features.select(F.col("label").alias("cond"), F.col("feature").alias("item"), "cnt"))
        prior, _ = freq_dist(smooth_prior(Counts(self.labels.select(F.col("label").alias("item"), "cnt"))))
        return Model(prior.select(F.col("item").alias("label"), F.col("p").alias("prior")), c, lam)


@dataclass
class Model:
    prior: DataFrame  # label, prior
    counts: CondCounts  # label, feature, cnt
    lam: float

    def likelihood(self) -> DataFrame:
        """(label, feature, p) for every label and known feature."""
        d = cond_dist(cond_add_lambda(self.lam)(self.counts) if self.lam else self.counts)
        return d.cells.select(F.col("cond").alias("label"), F.col("item").alias("feature"), "p")

    def classify(self, docs: DataFrame) -> DataFrame:
        """docs (doc_id, feature) to (doc_id, label, logp), normalised over labels; uniform where every label has probability 0.

        A label's score is its prior and denominators, which are the same for each occurrence, and the seen pairs' counts, so
        only pairs that occur are joined: no label is filled with the whole vocabulary.
        """
        lam = self.lam
        cells = self.counts.cells.select(F.col("cond").alias("__l"), F.col("item").alias("__f"), "cnt")
        vocab = self.counts.cells.agg(F.count_distinct("item").alias("__v"))
        totals = self.counts.cells.groupBy(F.col("cond").alias("__t")).agg(F.sum("cnt").alias("__n")).crossJoin(vocab)
        labels = self.prior.join(totals, F.col("label") == F.col("__t"), "left").select("label", "prior", (F.coalesce("__n", F.lit(0.0)) + lam * (F.coalesce("__v", F.lit(0)) + 1 if lam else 0)).alias("__den"))
        per_doc = docs.groupBy("doc_id").agg(F.count("feature").alias("__k"))
        grid = per_doc.crossJoin(F.broadcast(labels))
        n = docs.groupBy("doc_id", "feature").agg(F.count("feature").alias("__m"))
        hits = n.join(cells, F.col("feature") == F.col("__f")).groupBy("doc_id", "__l")
        hits = hits.agg(F.sum(F.col("__m") * (F.log(F.col("cnt") + lam) - (F.log(F.lit(lam)) if lam else F.lit(0.0)))).alias("__s"), F.sum("__m").alias("__hit")).withColumnsRenamed({"doc_id": "__d"})
        d = grid.join(hits, (F.col("doc_id") == F.col("__d")) & (F.col("label") == F.col("__l")), "left")
        base = F.coalesce("__s", F.lit(0.0)) - F.col("__k") * to_log(F.col("__den"))
        if lam:
            score = to_log(F.col("prior")) + base + F.col("__k") * F.log(F.lit(lam))
        else:
            score = F.when(F.coalesce("__hit", F.lit(0)) < F.col("__k"), F.lit(ZERO)).otherwise(to_log(F.col("prior")) + F.when(F.col("__k") == 0, 0.0).otherwise(base))
        d = d.select("doc_id", "label", score.alias("__x"))
        w = Window.partitionBy("doc_id")
        d = d.withColumn("__top", F.max("__x").over(w))
        d = d.withColumn("__e", F.when(F.col("__top") == ZERO, 1.0).otherwise(F.exp(F.col("__x") - F.col("__top"))))
        return d.select("doc_id", "label", to_log(F.col("__e") / F.sum("__e").over(w)).alias("logp"))

    def best(self, docs: DataFrame) -> DataFrame:
        return best_label(self.classify(docs))

    def generate(self, spark, n_docs: int, n_features: int, seed: int = 0) -> DataFrame:
        """(doc_id, label, pos, feature): sampled labels, and for each n_features sampled features."""
        docs = sample(self.prior.select(F.col("label").alias("item"), F.col("prior").alias("p")), spark.range(n_docs).select(F.col("id").alias("doc_id")), "doc_id", seed)
        draws = docs.select("doc_id", F.col("item").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("pos")).withColumn("__key", F.concat_ws("-", "doc_id", "pos"))
        cells = self.likelihood().select(F.col("label").alias("cond"), F.col("feature").alias("item"), "p")
        got = sample(cells, draws.withColumnRenamed("label", "cond"), "__key", seed + 1, "cond")
        return got.select("doc_id", F.col("cond").alias("label"), "pos", F.col("item").alias("feature"))


def best_label(scores: DataFrame) -> DataFrame:
    """The label of the highest score of each document; ties go to the lowest label."""
    return scores.groupBy("doc_id").agg(F.min_by("label", F.struct(-F.col("logp"), F.col("label"))).alias("label"))


def evaluate(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: right and all documents."""
    both = gold.select("doc_id", F.col("label").alias("__g")).join(predicted.select("doc_id", F.col("label").alias("__p")), "doc_id")
    return both.agg(F.count_if(F.col("__g") == F.col("__p")).alias("correct"), F.count("*").alias("total"))


def evaluate_all(predicted: dict[str, DataFrame], gold: DataFrame) -> DataFrame:
    """(name, correct, total, accuracy) of several classifiers."""
    rows = [evaluate(p, gold).select(F.lit(name).alias("name"), "correct", "total", F.try_divide("correct", "total").alias("accuracy")) for name, p in predicted.items()]
    return reduce(DataFrame.unionByName, rows)


def mistakes(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, gold, output) of the documents with a wrong label."""
    both = gold.select("doc_id", F.col("label").alias("gold")).join(predicted.select("doc_id", F.col("label").alias("output")), "doc_id")
    return both.where(~F.col("gold").eqNullSafe(F.col("output")))


def gibbs(unlabelled: DataFrame, labelled: DataFrame, labels: list[str], burn_in: int = 5, rounds: int = 10, lag: int = 1, pseudo: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, label): the majority label of each unlabelled document over the kept rounds of a Gibbs sampler.

    Documents are long (doc_id, feature), labelled ones also have label. Each round draws word distributions for every label from
    the counts, which are then held on all workers, and samples every document's label in parallel given these and the label counts
    of the round before (a blocked sampler; document by document it would be sequential). Features are numbered by a plan, so the
    driver and the workers hold labels x features numbers, and no words; counts come to the driver as Arrow columns. Rounds are
    fixed by the seed. Ties of the vote go to the lowest label.
    """
    spark = unlabelled.sparkSession
    known_docs = {r.label: r.n for r in labelled.select("doc_id", "label").distinct().groupBy("label").agg(F.count("*").alias("n")).collect()}
    if more := sorted(known_docs.keys() - set(labels)):
        raise ValueError(f"labels that aren't listed: {more}")
    vocab = once(interned(unlabelled.select("feature").unionByName(labelled.select("feature")), "feature", 0))
    shape = (len(labels), vocab.count())
    v = vocab.select(F.col("value").alias("__f"), F.col("number").alias("f"))
    n = unlabelled.groupBy("doc_id", "feature").agg(F.count("*").alias("n")).join(v, F.col("feature") == F.col("__f"))
    bags = once(n.groupBy("doc_id").agg(F.collect_list(F.struct("f", "n")).alias("b")).select("doc_id", F.col("b.f").alias("f"), F.col("b.n").alias("n")))
    place = F.create_map(*[x for i, k in enumerate(labels) for x in (F.lit(k), F.lit(i))])
    known = labelled.groupBy("label", "feature").agg(F.count("*").alias("n")).join(v, F.col("feature") == F.col("__f")).select(place[F.col("label")].alias("lab"), "f", "n")
    base = _dense(known, shape)
    rng = np.random.default_rng(seed)
    prior = np.array([known_docs.get(k, 0) + pseudo for k in labels], float)
    word_counts, votes = base, []

    def draw(counts: np.ndarray) -> np.ndarray:
        g = rng.gamma(counts + pseudo)
        g /= g.sum(1, keepdims=True)
        return np.log(np.maximum(g, 1e-300, out=g), out=g)

    kind = bags.schema["doc_id"].dataType.simpleString()
    for k in range(burn_in + rounds):
        shared = spark.sparkContext.broadcast((draw(word_counts), np.log(prior / prior.sum()), seed + k, k == 0))
        labs = once(bags.mapInArrow(_drawn_labels(shared), f"doc_id {kind}, lab int"))
        if k >= burn_in and (k - burn_in) % (lag + 1) == 0:
            votes.append(labs)
        sizes = {r.lab: r["count"] for r in labs.groupBy("lab").count().collect()}
        if k + 1 < burn_in + rounds:
            sums = bags.mapInArrow(_drawn_counts(shared), "lab int, f int, n long").groupBy("lab", "f").agg(F.sum("n").alias("n"))
            word_counts = base + _dense(sums, shape)
        shared.unpersist()
        prior = np.array([known_docs.get(x, 0) + sizes.get(i, 0) + pseudo for i, x in enumerate(labels)], float)
    n = reduce(DataFrame.unionByName, votes).groupBy("doc_id", "lab").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.min_by("lab", F.struct(-F.col("n"), F.col("lab"))).alias("lab"))
    return n.select("doc_id", F.array(*[F.lit(k) for k in labels])[F.col("lab")].alias("label"))


def _dense(counts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Counts (lab, f, n) as an array, gathered as columns of numbers."""
    out, t = np.zeros(shape), counts.select("lab", "f", "n").toArrow()
    for b in t.to_batches():
        out[b.column(0).to_numpy(), b.column(1).to_numpy()] = b.column(2).to_numpy()
    return out


def _draw_batch(b: pa.RecordBatch, words: np.ndarray, logprior: np.ndarray, seed: int, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels drawn for a batch of bags (doc_id, f, n), and each feature's number, count and the label of its document."""
    sizes = pc.list_value_length(b.column("f")).to_numpy(zero_copy_only=False)
    f, n = b.column("f").flatten().to_numpy(), b.column("n").flatten().to_numpy()
    x = np.repeat(logprior[:, None], len(sizes), 1)
    if not first and len(f):
        starts = np.cumsum(sizes) - sizes
        for i in range(len(x)):
            x[i] += np.add.reduceat(words[i, f] * n, starts)
    e = np.exp(x - x.max(0))
    keys = pd.util.hash_array(np.array([str(d) for d in b.column("doc_id").to_pylist()], object)) & 0xFFFFFFFF
    u = np.array([np.random.default_rng([seed, int(h)]).random() for h in keys])
    lab = np.minimum((np.cumsum(e, 0) / e.sum(0) <= u).sum(0), len(x) - 1).astype(np.int32)
    return lab, f, n, np.repeat(lab, sizes)


def _drawn_labels(shared):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_draw_batch(b, *shared.value)[0])], ["doc_id", "lab"])

    return run


def _drawn_counts(shared):
    """Counts by label and feature of what a task drew: each task adds up its own before they are shuffled."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value[0].shape, np.int64)
        for b in parts:
            _, f, n, lab = _draw_batch(b, *shared.value)
            np.add.at(total, (lab, f), n)
        for i, row in enumerate(total):
            there = np.flatnonzero(row)
            for k in range(0, len(there), 100_000):
                at = there[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lab", "f", "n"])

    return run
