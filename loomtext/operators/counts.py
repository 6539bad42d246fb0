"""Frequency counts with a default, smoothing, and the distributions they give.

Counts is a table (item, cnt) with two numbers: what counts beyond the table (total_add) and the count of an item that isn't in it
(default_cnt). CondCounts is the same for each condition: cells (cond, item, cnt) and conds (cond, total_add, default_cnt).
Smoothers are functions CondCounts -> CondCounts (or Counts -> Counts) and compose as such; the innermost runs first.

Filling every condition with every known item, as smoothing over conditions needs, is a cross join. `sparse_eisner` and
`lookup` give the same probabilities for wanted pairs without it, for large vocabularies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-100


@dataclass
class Counts:
    df: DataFrame
    total_add: float = 0.0
    default_cnt: float = 0.0

    @classmethod
    def of(cls, df: DataFrame, item: str, cnt: str | None = None, total_add: float = 0.0, default_cnt: float = 0.0) -> Counts:
        """Counts of rows, or sums of a column."""
        n = (F.count("*") if cnt is None else F.sum(cnt)).cast("double")
        return cls(df.groupBy(F.col(item).alias("item")).agg(n.alias("cnt")), float(total_add), float(default_cnt))

    def merge(self, other: Counts) -> Counts:
        """Adds counts; the additions and defaults must agree, unless one side has none."""
        pairs = ((self.total_add, other.total_add), (self.default_cnt, other.default_cnt))
        mine, theirs = any(p[0] for p in pairs), any(p[1] for p in pairs)
        if mine and theirs and any(a != b for a, b in pairs):
            raise ValueError("the additions and defaults of the two sides differ")
        base = self if mine else other
        return Counts(self.df.unionByName(other.df).groupBy("item").agg(F.sum("cnt").alias("cnt")), base.total_add, base.default_cnt)


@dataclass
class CondCounts:
    cells: DataFrame
    conds: DataFrame

    @classmethod
    def of(cls, df: DataFrame, cond: str, item: str, cnt: str | None = None) -> CondCounts:
        n = (F.count("*") if cnt is None else F.sum(cnt)).cast("double")
        cells = df.groupBy(F.col(cond).alias("cond"), F.col(item).alias("item")).agg(n.alias("cnt"))
        return cls.plain(cells)

    @classmethod
    def plain(cls, cells: DataFrame) -> CondCounts:
        """From cells (cond, item, cnt), without additions or defaults."""
        zero = F.lit(0.0)
        return cls(cells, cells.select("cond").distinct().withColumns({"total_add": zero, "default_cnt": zero}))

    def merge(self, other: CondCounts) -> CondCounts:
        cells = self.cells.unionByName(other.cells).groupBy("cond", "item").agg(F.sum("cnt").alias("cnt"))
        both = self.conds.unionByName(other.conds).groupBy("cond")
        return CondCounts(cells, both.agg(F.max("total_add").alias("total_add"), F.max("default_cnt").alias("default_cnt")))


# --- smoothing of plain counts ---


def passthrough(c):
    return c


def constrain(valid: DataFrame, then: Callable[[Counts], Counts] = passthrough) -> Callable[[Counts], Counts]:
    """Items of valid (item) keep their counts, or get the default if they had none; other items get 0. No additions are left."""

    def run(c: Counts) -> Counts:
        c = then(c)
        v = valid.select("item").distinct().withColumn("__ok", F.lit(True))
        both = c.df.join(v, c.df["item"].eqNullSafe(v["item"]), "full_outer").select(F.coalesce(c.df["item"], v["item"]).alias("item"), F.when(F.col("__ok"), F.coalesce("cnt", F.lit(c.default_cnt))).otherwise(0.0).alias("cnt"))
        return Counts(both)

    return run


def drop_items(items: DataFrame, then: Callable[[Counts], Counts] = passthrough) -> Callable[[Counts], Counts]:
    def run(c: Counts) -> Counts:
        c = then(c)
        gone = items.select(F.col("item").alias("__item")).distinct()
        return Counts(c.df.join(gone, F.col("item").eqNullSafe(F.col("__item")), "left_anti"), c.total_add, c.default_cnt)

    return run


def add_lambda(lam: float, then: Callable[[Counts], Counts] = passthrough) -> Callable[[Counts], Counts]:
    def run(c: Counts) -> Counts:
        c = then(c)
        return Counts(c.df.withColumn("cnt", F.col("cnt") + lam), c.total_add + lam, c.default_cnt + lam)

    return run


# --- smoothing of conditional counts ---


def fill(c: CondCounts) -> DataFrame:
    """cells for every condition and every item that any condition has; missing ones with the condition's default."""
    items = c.cells.select(F.col("item").alias("__item")).distinct()
    grid = c.conds.select(F.col("cond").alias("__cond"), "total_add", "default_cnt").crossJoin(items)
    joined = grid.join(c.cells, F.col("__cond").eqNullSafe(F.col("cond")) & F.col("__item").eqNullSafe(F.col("item")), "left")
    return joined.select(F.col("__cond").alias("cond"), F.col("__item").alias("item"), F.coalesce("cnt", "default_cnt").alias("cnt"), "total_add", "default_cnt")


def cond_add_lambda(lam: float, then: Callable[[CondCounts], CondCounts] = passthrough) -> Callable[[CondCounts], CondCounts]:
    """Every condition has every known item, each with lam more; so have the addition and the default."""

    def run(c: CondCounts) -> CondCounts:
        c = then(c)
        cells = fill(c).select("cond", "item", (F.col("cnt") + lam).alias("cnt"))
        return CondCounts(cells, c.conds.withColumns({"total_add": F.col("total_add") + lam, "default_cnt": F.col("default_cnt") + lam}))

    return run


def cond_constrain(valid: DataFrame, zero_defaults: bool = True, then: Callable[[CondCounts], CondCounts] = passthrough) -> Callable[[CondCounts], CondCounts]:
    """valid (cond, item): what a condition may have.

    zero_defaults: valid pairs keep their counts or get the default, other known items get 0, no additions stay, and every valid
    condition is there. Otherwise only items that valid lists for some condition are set to 0 where they aren't valid; the rest
    stays.
    """

    def run(c: CondCounts) -> CondCounts:
        c = then(c)
        v = valid.select(F.col("cond").alias("__c"), F.col("item").alias("__i")).distinct()
        on = F.col("cond").eqNullSafe(F.col("__c")) & F.col("item").eqNullSafe(F.col("__i"))
        if not zero_defaults:
            listed = v.select(F.col("__i").alias("__listed")).distinct().withColumn("__has", F.lit(True))
            cells = c.cells.join(v.withColumn("__ok", F.lit(True)), on, "left").join(listed, F.col("item").eqNullSafe(F.col("__listed")), "left")
            return CondCounts(cells.select("cond", "item", F.when(F.col("__has") & F.col("__ok").isNull(), 0.0).otherwise(F.col("cnt")).alias("cnt")), c.conds)
        known = c.cells.select("item").union(v.select("__i")).distinct()
        conds = c.conds.select("cond").union(v.select("__c")).distinct().join(c.conds.select(F.col("cond").alias("__k"), "default_cnt"), F.col("cond").eqNullSafe(F.col("__k")), "left").select("cond", F.coalesce("default_cnt", F.lit(0.0)).alias("default_cnt"))
        has_entry = v.select(F.col("__c").alias("__e")).distinct()
        grid = conds.join(has_entry, F.col("cond").eqNullSafe(F.col("__e")), "left_semi").crossJoin(known)
        now = c.cells.select(F.col("cond").alias("__a"), F.col("item").alias("__b"), "cnt")
        cells = grid.join(now, F.col("cond").eqNullSafe(F.col("__a")) & F.col("item").eqNullSafe(F.col("__b")), "left").join(v.withColumn("__ok", F.lit(True)), on, "left")
        cells = cells.select("cond", "item", F.when(F.col("__ok"), F.coalesce("cnt", "default_cnt")).otherwise(0.0).alias("cnt"))
        zero = F.lit(0.0)
        return CondCounts(cells, conds.select("cond", zero.alias("total_add"), zero.alias("default_cnt")))

    return run


def _backoff(c: CondCounts, smooth: Callable[[Counts], Counts]) -> tuple[DataFrame, Column, DataFrame]:
    """(item, p_back), its default, and one row with the total: the smoothed sums of the seen pairs over all conditions; the
    conditions' own additions and defaults don't count here."""
    summed = smooth(Counts(c.cells.groupBy("item").agg(F.sum("cnt").alias("cnt"))))
    total = summed.df.agg((F.coalesce(F.sum("cnt"), F.lit(0.0)) + summed.total_add).alias("__total"))
    p = summed.df.crossJoin(F.broadcast(total)).select(F.col("item").alias("__bi"), F.try_divide("cnt", "__total").alias("p_back"))
    return p, F.try_divide(F.lit(summed.default_cnt), F.col("__total")), total


def eisner(lam: float, smooth: Callable[[Counts], Counts] = passthrough, then: Callable[[CondCounts], CondCounts] = passthrough) -> Callable[[CondCounts], CondCounts]:
    """One-count smoothing: a condition gets lam * (its number of items counted once) more counts, shared by the smoothed
    distribution over all conditions."""

    def run(c: CondCounts) -> CondCounts:
        c = then(c)
        p, p_default, total = _backoff(c, smooth)
        ones = c.cells.groupBy(F.col("cond").alias("__oc")).agg((F.lit(lam) * (F.count_if((F.col("cnt") > 0.5) & (F.col("cnt") < 1.5)) + TINY)).alias("__l"))
        weight = F.coalesce("__l", F.lit(lam * TINY))
        cells = fill(c).join(ones, F.col("cond").eqNullSafe(F.col("__oc")), "left").join(p, F.col("item").eqNullSafe(F.col("__bi")), "left")
        cells = cells.select("cond", "item", (F.col("cnt") + weight * F.coalesce("p_back", F.lit(0.0))).alias("cnt"))
        conds = c.conds.join(ones, F.col("cond").eqNullSafe(F.col("__oc")), "left").crossJoin(F.broadcast(total))
        more = weight * p_default
        return CondCounts(cells, conds.select("cond", (F.col("total_add") + more).alias("total_add"), (F.col("default_cnt") + more).alias("default_cnt")))

    return run


def sparse_eisner(c: CondCounts, wanted: DataFrame, lam: float, add: float = 1.0) -> DataFrame:
    """wanted (cond, item, ..) with p: one-count smoothing with add-`add` backoff, for counts without additions, by joins with
    the seen pairs only; no condition is filled. An unseen condition has the smoothed sums of all conditions."""
    items = c.cells.groupBy(F.col("item").alias("__bi")).agg(F.sum("cnt").alias("__n"))
    total = items.agg(F.sum("__n").alias("__sum"), F.count("*").alias("__types"))
    conds = c.cells.groupBy(F.col("cond").alias("__oc")).agg(F.sum("cnt").alias("__have"), (F.lit(lam) * (F.count_if((F.col("cnt") > 0.5) & (F.col("cnt") < 1.5)) + TINY)).alias("__l"))
    all_conds = conds.agg(F.sum("__l").alias("__all_l"))
    cells = c.cells.select(F.col("cond").alias("__cc"), F.col("item").alias("__ci"), "cnt")
    d = wanted.join(items, F.col("item").eqNullSafe(F.col("__bi")), "left").join(conds, F.col("cond").eqNullSafe(F.col("__oc")), "left")
    d = d.join(cells, F.col("cond").eqNullSafe(F.col("__cc")) & F.col("item").eqNullSafe(F.col("__ci")), "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(all_conds))
    back = (F.coalesce("__n", F.lit(0.0)) + add) / (F.col("__sum") + add * F.col("__types") + add)
    seen = (F.coalesce("cnt", F.lit(0.0)) + F.col("__l") * back) / (F.col("__have") + F.col("__l"))
    unseen = (F.coalesce("__n", F.lit(0.0)) + F.col("__all_l") * back) / (F.col("__sum") + F.col("__all_l"))
    return d.withColumn("p", F.when(F.col("__l").isNotNull(), seen).otherwise(unseen)).select(*wanted.columns, "p")


def cond_random(top: int, seed: int = 0, then: Callable[[CondCounts], CondCounts] = passthrough) -> Callable[[CondCounts], CondCounts]:
    """Adds to every pair a pseudo-random integer from 0 to top that the seed and the pair fix."""

    def run(c: CondCounts) -> CondCounts:
        c = then(c)
        noise = F.pmod(_digest("cond", "item", seed=seed), F.lit(top + 1))
        return CondCounts(fill(c).select("cond", "item", (F.col("cnt") + noise).alias("cnt")), c.conds)

    return run


# --- distributions ---


def freq_dist(c: Counts) -> tuple[DataFrame, DataFrame]:
    """(item, p), and one row with the probability of an item that isn't there (default_p); 0 everywhere if nothing counts."""
    total = c.df.agg((F.coalesce(F.sum("cnt"), F.lit(0.0)) + c.total_add).alias("total"))
    p = c.df.crossJoin(F.broadcast(total)).select("item", F.coalesce(F.try_divide("cnt", "total"), F.lit(0.0)).alias("p"))
    return p, total.select(F.coalesce(F.try_divide(F.lit(c.default_cnt), F.col("total")), F.lit(0.0)).alias("default_p"))


@dataclass
class CondDist:
    """cells (cond, item, p), conds (cond, default_p), and for unseen conditions back (item, p) and back_default (default_p)."""

    cells: DataFrame
    conds: DataFrame
    back: DataFrame
    back_default: DataFrame

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """wanted (cond, item, ..) with p. A condition that is known never backs off."""
        cells = self.cells.select(F.col("cond").alias("__cc"), F.col("item").alias("__ci"), F.col("p").alias("__p"))
        conds = self.conds.select(F.col("cond").alias("__oc"), F.col("default_p").alias("__d"))
        back = self.back.select(F.col("item").alias("__bi"), F.col("p").alias("__b"))
        d = wanted.join(cells, F.col("cond").eqNullSafe(F.col("__cc")) & F.col("item").eqNullSafe(F.col("__ci")), "left")
        d = d.join(conds, F.col("cond").eqNullSafe(F.col("__oc")), "left").join(back, F.col("item").eqNullSafe(F.col("__bi")), "left")
        d = d.crossJoin(F.broadcast(self.back_default.select(F.col("default_p").alias("__bd"))))
        p = F.when(F.col("__d").isNotNull(), F.coalesce("__p", "__d")).otherwise(F.coalesce("__b", "__bd"))
        return d.withColumn("p", p).select(*wanted.columns, "p")


def cond_dist(c: CondCounts) -> CondDist:
    sums = c.cells.groupBy(F.col("cond").alias("__c")).agg(F.sum("cnt").alias("__s"))
    conds = c.conds.join(sums, F.col("cond").eqNullSafe(F.col("__c")), "left").select("cond", "default_cnt", (F.coalesce("__s", F.lit(0.0)) + F.col("total_add")).alias("__t"))
    share = lambda x: F.coalesce(F.try_divide(x, F.col("__t")), F.lit(0.0))
    totals = conds.select(F.col("cond").alias("__oc"), "__t")
    cells = c.cells.join(totals, F.col("cond").eqNullSafe(F.col("__oc")), "left").select("cond", "item", share(F.col("cnt")).alias("p"))
    extra = c.conds.agg(F.coalesce(F.sum("total_add"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("default_cnt"), F.lit(0.0)).alias("d")).first()
    back, back_default = freq_dist(Counts(c.cells.groupBy("item").agg(F.sum("cnt").alias("cnt")), extra["t"], extra["d"]))
    return CondDist(cells, conds.select("cond", share(F.col("default_cnt")).alias("default_p")), back, back_default)


# --- sampling ---


def _digest(*key: Column | str, seed: int = 0) -> Column:
    """52 bits of a digest of the seed and the key's parts."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("\0")) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("long")


def uniform01(*key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that the seed and the key fix."""
    return _digest(*key, seed=seed) / float(1 << 52)


def sample(dist: DataFrame, draws: DataFrame, key: str, seed: int = 0, cond: str | None = None) -> DataFrame:
    """draws with `item`, sampled from dist (item, p), or from dist (cond, item, p) by the draw's cond: the inverse of the
    cumulative probabilities, from the largest on, as a range join. The draw of a key is the same for the same seed."""
    w = Window.partitionBy(*([cond] if cond else [])).orderBy(F.desc("p"), "item")
    upto = F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = dist.where("p > 0").withColumn("__hi", upto).withColumn("__lo", F.col("__hi") - F.col("p"))
    d = d.withColumn("__all", F.max("__hi").over(Window.partitionBy(*([cond] if cond else []))))
    d = d.select(*([F.col(cond).alias("__cond")] if cond else []), "item", (F.col("__lo") / F.col("__all")).alias("__lo"), F.when(F.col("__hi") == F.col("__all"), 1.0).otherwise(F.col("__hi") / F.col("__all")).alias("__hi"))
    u = draws.withColumn("__u", uniform01(key, seed=seed))
    on = (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi"))
    if cond:
        on &= F.col(cond).eqNullSafe(F.col("__cond"))
    return u.join(d, on).drop("__u", "__lo", "__hi", "__cond")


def binomial(draws: DataFrame, key: str, first: str, second: str, p: float, seed: int = 0) -> DataFrame:
    return draws.withColumn("item", F.when(uniform01(key, seed=seed) < p, F.lit(first)).otherwise(F.lit(second)))


def dirichlet(pseudocounts: dict[str, float], n: int, seed: int = 0) -> list[dict[str, float]]:
    """n multinomials drawn from a Dirichlet distribution; small by nature, so drawn on the driver."""
    import numpy as np

    rng = np.random.default_rng(seed)
    labels = sorted(pseudocounts)
    return [dict(zip(labels, x.tolist(), strict=True)) for x in rng.dirichlet([pseudocounts[k] for k in labels], n)]


def merge_all(parts: list[CondCounts]) -> CondCounts:
    return reduce(CondCounts.merge, parts)
