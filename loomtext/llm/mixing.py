"""Operator 5, mixing sources to target weights.

Each row gets a hash-random key. Within a source, rows are sorted by key; because keys are uniform, the leading hex digits of
the key cut each source into range buckets of equal expected size, whose token sums are a small table. A prefix sum over the
buckets and one inside each bucket give each row's exact place in its source's token stream, with no global sort and no bucket
larger than its share of a source. A source gives the tokens [0, budget) of its stream, which is repeated in epochs if it is
shorter; the row at the cut gives exactly the tokens that are missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import between_stages, n_words
from .token_count import beginnings, counter

#: Relative weight of a source in the mixture; sources that aren't listed, null among them, have DEFAULT_WEIGHT each.
WEIGHTS = {"src0": 4.0}
DEFAULT_WEIGHT = 1.0
SEED = "mix-1"
#: Rows that a bucket has on average at most; the number of buckets follows from it, and no result depends on it.
BUCKET_ROWS = 100_000


def weight_of(source: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(source == name, F.lit(float(w))).otherwise(out)
    return out


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, default: float = DEFAULT_WEIGHT, total: int | None = None, seed: str = SEED, count: Callable[[Column], Column] = n_words) -> DataFrame:
    """Each chosen row of docs once per epoch in which it is used: __row (the row), epoch (from 0), start (tokens of its source
    before it, all epochs counted) and taken (its tokens that are used; fewer than it has only in the row at the cut).

    Tokens are what `count` counts in a text; by default words. The total (by default all tokens there are) is shared by weight among the sources that have tokens, each share rounded down,
    so a source gives exactly its budget. Null is a source of its own. Null and empty texts have no tokens; they come along where
    their place is before the cut. Ties of the key (repeated rows) are ordered by id and then a hash of the
    text; equal rows are interchangeable.
    An empty table, or one without tokens, gives no rows. The names of docs' columns can't clash, since they stay in __row.
    """
    weights = WEIGHTS if weights is None else weights
    digits = max(3, len(f"{docs.count() // BUCKET_ROWS:x}") + 1)
    bucket = F.substring("__key", 1, digits)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source"), count(F.col("text")).cast("long").alias("__n"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("__key"), F.xxhash64("text").alias("__tie"))
    rows = rows.withColumn("__bucket", bucket)
    sums = rows.select("__source", "__bucket", "__n").groupBy("__source", "__bucket").agg(F.sum("__n").alias("__sum"))
    sources = sums.groupBy("__source").agg(F.sum("__sum").alias("__have")).where("__have > 0").select(F.col("__source").alias("__s"), "__have", weight_of(F.col("__source"), {"=" + k: w for k, w in weights.items()}, default).alias("__w"))
    per = Window.partitionBy("__source")
    sums = sums.withColumns({"__before": F.sum("__sum").over(per.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__sum"), "__tokens": F.sum("__sum").over(per)})
    everything = sources.agg(F.sum("__w").alias("__all_w"), F.sum("__have").alias("__all_n"))
    budget = F.floor((F.lit(total).cast("long") if total is not None else F.col("__all_n")).cast("double") * F.col("__w") / F.col("__all_w")).cast("long")
    shares = sources.crossJoin(everything).select("__s", budget.alias("__budget"))
    offsets = sums.join(shares, F.col("__source") == F.col("__s")).select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__before", "__tokens", "__budget")
    own = Window.partitionBy("__source", "__bucket").orderBy("__key", "__id", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("__end", F.sum("__n").over(own))
    placed = placed.join(offsets, (F.col("__source") == F.col("__s")) & (F.col("__bucket") == F.col("__b"))).withColumn("__place", F.col("__before") + F.col("__end") - F.col("__n"))
    last = F.expr("(__budget - __place + __tokens - 1) div __tokens - 1")  # the last epoch in which the row begins before the cut
    each = placed.where("__place < __budget").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("epoch") * F.col("__tokens") + F.col("__place")
    return each.select("__row", "epoch", start.alias("start"), F.least(F.col("__n"), F.col("__budget") - start).alias("taken"), F.col("__n").alias("n_tokens"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs mixed to the target weights, in tokens of operator 8, which are counted once: a row for each use of a document. The text
    of the row at a source's cut ends with the last pre-token that is within the tokens taken, so a source may fall short of its
    budget by less than the tokens of one pre-token."""
    n = "__n_tokens_" + str(len(docs.columns))
    counted = between_stages(docs.withColumn(n, counter(spark)("text")))
    m = mix_sources(counted, count=lambda _: F.coalesce(F.col(f"`{n}`"), F.lit(0)))
    at_cut = F.col("taken") < F.col("n_tokens")
    part = beginnings(spark)(F.when(at_cut, F.col("__row.text")), F.when(at_cut, F.col("taken")))
    m = m.withColumn("__part", part)
    text = F.when(at_cut, F.col("__part")).otherwise(F.col("__row.text"))
    columns = [F.when(at_cut, F.length(text)).otherwise(F.col("__row.n_chars")).cast(t).alias(c) if c == "n_chars" else text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c, t in docs.dtypes]
    return m.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    m = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("__row.doc_id", "__row.source", "epoch", "start", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(source, chr(0)) AS s, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) AS n, md5('mix-1:' || doc_id::VARCHAR) AS k, text FROM documents),
h AS (SELECT s, sum(n)::BIGINT AS have, CASE WHEN s = 'src0' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY s HAVING sum(n) > 0),
b AS (SELECT s, have, floor((SELECT sum(have) FROM h)::DOUBLE * w / (SELECT sum(w) FROM h))::BIGINT AS budget FROM h),
p AS (SELECT d.doc_id, d.source, d.n, b.have, b.budget, sum(d.n) OVER (PARTITION BY d.s ORDER BY k, d.doc_id, d.text ROWS UNBOUNDED PRECEDING) - d.n AS place FROM d JOIN b ON d.s = b.s),
e AS (SELECT *, unnest(generate_series(0, (((budget - place + have - 1) // have) - 1)::BIGINT)) AS epoch FROM p WHERE place < budget)
SELECT doc_id, source, epoch::BIGINT AS epoch, (epoch * have + place)::BIGINT AS start, least(n, budget - epoch * have - place)::BIGINT AS taken FROM e
"""
