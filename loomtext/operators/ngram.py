"""n-gram language models over token sequences (seq_id, pos, sym): training, scoring, generation.

A sequence is padded with n - 1 boundaries before and one after; a boundary is null. Contexts are structs of n - 1 symbols, so a
model is a CondCounts of (context, symbol) and takes every smoother of counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logprob import to_log
from .counts import CondCounts, CondDist, cond_dist, passthrough
from .stored import once


def ngrams(seqs: DataFrame, n: int, pad: bool = True, key: str = "seq_id") -> DataFrame:
    """(key, pos, cond, item): each symbol, and the end, after its n - 1 predecessors. A sequence without symbols has no rows
    in a long table, and so no n-grams."""
    w = Window.partitionBy(key).orderBy("pos")
    tokens = seqs.select(key, F.col("pos").cast("long").alias("pos"), F.col("sym").alias("item"))
    if pad:
        ends = tokens.groupBy(key).agg((F.max("pos") + 1).alias("pos")).withColumn("item", F.lit(None).cast(seqs.schema["sym"].dataType))
        tokens = tokens.unionByName(ends)
    names = [F.lag("item", k).over(w).alias(f"w{k}") for k in range(n - 1, 0, -1)]
    out = tokens.select(key, "pos", F.struct(*names).alias("cond") if names else F.struct(F.lit(0).alias("w0")).alias("cond"), "item", F.row_number().over(w).alias("__i"))
    return (out if pad else out.where(f"__i >= {n}")).drop("__i")


@dataclass
class Model:
    n: int
    counts: CondCounts
    dist: CondDist

    def score(self, seqs: DataFrame, pad: bool = True, key: str = "seq_id") -> DataFrame:
        """(key, logp): each sequence's log probability. Unpadded sequences shorter than n have no n-grams, and no row."""
        found = self.dist.lookup(ngrams(seqs, self.n, pad, key))
        return found.groupBy(key).agg(F.sum(to_log(F.col("p"))).alias("logp"))

    def probability(self, wanted: DataFrame) -> DataFrame:
        return self.dist.lookup(wanted)

    def generate(self, how_many: int, longest: int = 100, seed: int = 0) -> list[list]:
        """Sequences sampled symbol by symbol until the boundary, one after the other from one stream of draws. The driver holds no
        cells: as it isn't known at which draw a sequence begins, one from each possible draw grows in step with the others, and
        each step looks up the symbols that it needs in one job; so there are `longest` jobs at most."""
        import numpy as np

        spark = self.dist.cells.sparkSession
        draws = np.random.default_rng(seed).random(how_many * longest).tolist()
        cells = once(self.dist.cells.where("p > 0"))
        first = (None,) * (self.n - 1) if self.n > 1 else (0,)
        found: dict[tuple[int, tuple], tuple | None] = {}  # (draw, context) -> (symbol,), or None where the context has no symbols
        grown = {k: ([], first) for k in range(len(draws))}
        ended: dict[int, tuple[list, int]] = {}  # the sequence that begins at a draw, and the number of its draws
        while grown:
            wanted: dict[tuple, list[int]] = {}
            for k, (seq, context) in list(grown.items()):
                at = k + len(seq)
                while len(seq) < longest and (at, context) in found and (got := found[at, context]) is not None and got[0] is not None:
                    seq.append(got[0])
                    context, at = (*context[1:], got[0]) if self.n > 1 else context, at + 1
                grown[k] = (seq, context)
                if len(seq) == longest or (at, context) in found:
                    ended[k] = (seq, len(seq) + (len(seq) < longest and found[at, context] is not None))
                elif at < len(draws):
                    wanted.setdefault(context, []).append(at)
                if k in ended or at >= len(draws):
                    del grown[k]
            if wanted:
                found.update(_sampled(spark, cells, {c: sorted(set(ats)) for c, ats in wanted.items()}, draws))
        out, k = [], 0
        for _ in range(how_many):
            seq, used = ended.get(k, ([], 0))
            out.append(list(seq))
            k += used
        return out


def _sampled(spark, cells: DataFrame, wanted: dict[tuple, list[int]], draws: list[float]) -> dict[tuple[int, tuple], tuple | None]:
    """For each context and draw the symbol at which the cumulative probability, from the largest on, passes the draw's share."""
    contexts = list(wanted)
    kind = cells.schema["cond"].dataType.simpleString()
    c = F.broadcast(spark.createDataFrame([(i, x) for i, x in enumerate(contexts)], f"__c int, __cond {kind}"))
    u = F.broadcast(spark.createDataFrame([(i, k, draws[k]) for i, x in enumerate(contexts) for k in wanted[x]], "__d int, __k int, __u double"))
    w = Window.partitionBy("__c").orderBy(F.desc("p"), F.col("item").isNotNull(), F.col("item").cast("string"))
    options = cells.join(c, F.col("cond").eqNullSafe(F.col("__cond"))).withColumn("__hi", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    options = options.select("__c", "item", "__hi", F.lag("__hi", 1, 0.0).over(w).alias("__lo"), F.lead("__hi").over(w).isNull().alias("__last"), F.max("__hi").over(Window.partitionBy("__c")).alias("__all"))
    share = F.col("__u") * F.col("__all")
    got = options.join(u, (F.col("__c") == F.col("__d")) & (share >= F.col("__lo")) & ((share < F.col("__hi")) | F.col("__last"))).select("__c", "__k", "item").collect()
    out: dict[tuple[int, tuple], tuple | None] = {(k, x): None for x, ks in wanted.items() for k in ks}
    return out | {(r["__k"], contexts[r["__c"]]): (r["item"],) for r in got}


def train(seqs: DataFrame, n: int, smooth=passthrough, key: str = "seq_id") -> Model:
    """Counts once, and smooths and divides these counts."""
    c = smooth(CondCounts.plain(once(CondCounts.of(ngrams(seqs, n, True, key), "cond", "item").cells)))
    return Model(n, c, cond_dist(c))
