"""Tag dictionaries: which tags a symbol may have, with weights, and what holds for unknown symbols."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import CondCounts, cond_dist, passthrough


@dataclass
class TagDict:
    """pairs (sym, tag, weight) and defaults (tag, weight) for symbols that aren't there; weights are probabilities."""

    pairs: DataFrame
    defaults: DataFrame

    def symbols(self) -> DataFrame:
        return self.pairs.select("sym").distinct()

    def all_tags(self) -> DataFrame:
        return self.pairs.select("tag").union(self.defaults.select("tag")).distinct()

    def size(self) -> int:
        return self.pairs.select("sym", "tag").distinct().count()

    def lookup(self, syms: DataFrame) -> DataFrame:
        """syms (sym, ..) with each tag that the symbol may have and its weight."""
        p = self.pairs.select(F.col("sym").alias("__s"), "tag", "weight")
        known = syms.join(p, F.col("sym") == F.col("__s"), "left")
        return known.where("__s IS NOT NULL").drop("__s").unionByName(known.where("__s IS NULL").drop("__s", "tag", "weight").crossJoin(F.broadcast(self.defaults)))

    def contains(self, syms: DataFrame) -> DataFrame:
        """syms (sym, ..) with known: whether the dictionary has the symbol."""
        s = self.symbols().select(F.col("sym").alias("__s"))
        return syms.join(s, F.col("sym") == F.col("__s"), "left").withColumn("known", F.col("__s").isNotNull()).drop("__s")

    def without_default(self) -> TagDict:
        return TagDict(self.pairs, self.defaults.limit(0))

    def lifted(self) -> TagDict:
        """With the boundary, whose only tag is the boundary."""
        row = self.pairs.sparkSession.range(1).select(F.lit(None).cast("string").alias("sym"), F.lit(None).cast("string").alias("tag"), F.lit(1.0).alias("weight"))
        return TagDict(self.pairs.unionByName(row), self.defaults)


def _uniform(pairs: DataFrame, defaults: DataFrame | None = None) -> TagDict:
    defaults = pairs.select("tag").distinct() if defaults is None else defaults
    return TagDict(pairs.withColumn("weight", F.lit(1.0)), defaults.withColumn("weight", F.lit(1.0)))


def simple(tagged: DataFrame) -> TagDict:
    """From tagged tokens (sym, tag): every pair that occurs; every tag for unknown symbols."""
    return _uniform(tagged.select("sym", "tag").distinct())


def weighted(tagged: DataFrame, smooth=passthrough) -> TagDict:
    """Weights are the smoothed shares of a symbol's tags."""
    d = cond_dist(smooth(CondCounts.of(tagged, "sym", "tag")))
    return TagDict(d.cells.select(F.col("cond").alias("sym"), F.col("item").alias("tag"), F.col("p").alias("weight")), d.back.select(F.col("item").alias("tag"), F.col("p").alias("weight")))


def top_pairs(tagged: DataFrame, k: int) -> TagDict:
    """The k most frequent pairs; ties go to the lower symbol and tag. Defaults: all tags that occur."""
    ranked = tagged.groupBy("sym", "tag").count().orderBy(F.desc("count"), "sym", "tag").limit(k)
    return _uniform(ranked.select("sym", "tag"), tagged.select("tag").distinct())


def top_symbols(tagged: DataFrame, k: int, tagset: DataFrame | None = None) -> TagDict:
    """All tags of the k most frequent symbols."""
    syms = tagged.groupBy("sym").count().orderBy(F.desc("count"), "sym").limit(k).select("sym")
    return _uniform(tagged.select("sym", "tag").distinct().join(syms, "sym", "left_semi"), tagset if tagset is not None else tagged.select("tag").distinct())


def limit_defaults(d: TagDict, n: int) -> TagDict:
    """Unknown symbols get only the n tags that the most symbols have."""
    top = d.pairs.groupBy("tag").agg(F.count_distinct("sym").alias("n")).orderBy(F.desc("n"), "tag").limit(n).select("tag")
    return TagDict(d.pairs, d.defaults.join(top, "tag", "left_semi"))


def from_lines(lines: DataFrame, tagset: DataFrame) -> TagDict:
    """From lines (value) `word tag tag ..`; repeated words add up."""
    words = F.split(F.trim("value"), r"\s+")
    pairs = lines.where(F.trim("value") != "").select(F.get(words, F.lit(0)).alias("sym"), F.explode(F.slice(words, F.lit(2), F.size(words) - 1)).alias("tag")).distinct()
    return _uniform(pairs, tagset)
