"""Keyed-collection algebra: grouping, counting, merging, sliding, splitting, strict zipping and budgets, as DataFrame plans.

Whatever depends on order takes an order column; ties end with the caller's unique columns. Array forms are marked so and work
inside one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- grouping and merging ---


def counts(df: DataFrame, *keys: str, out: str = "cnt") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def sum_by(df: DataFrame, keys: list[str], value: Column, out: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(out))


def group_by_key(df: DataFrame, key: str, value: str, order: list[str] | None = None, distinct: bool = False, out: str = "values") -> DataFrame:
    """Lists by key, in the given order; or sets, sorted."""
    if distinct:
        return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(out))
    if not order:
        return df.groupBy(key).agg(F.collect_list(value).alias(out))
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(key).agg(F.transform(listed, lambda x: x["__v"]).alias(out))


def ungroup(df: DataFrame, key: str, values: str, out: str = "value") -> DataFrame:
    return df.select(key, F.posexplode(values).alias("pos", out))


def merge_sum(tables: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Adds numbers by key over any number of tables."""
    return reduce(DataFrame.unionByName, [t.select(*keys, value) for t in tables]).groupBy(*keys).agg(F.sum(value).alias(value))


def merge_lists(tables: list[DataFrame], key: str, values: str) -> DataFrame:
    """Concatenates lists by key; within a key, tables come in the given order."""
    parts = [t.select(key, F.lit(i).alias("__i"), F.col(values).alias("__v")) for i, t in enumerate(tables)]
    ordered = F.array_sort(F.collect_list(F.struct("__i", "__v")))
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.flatten(F.transform(ordered, lambda x: x["__v"])).alias(values))


def average(df: DataFrame, keys: list[str], value: str, out: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def normalize(df: DataFrame, keys: list[str], value: str, out: str = "share") -> DataFrame:
    """value over its sum by key; null where the sum is 0. The sums are a partial aggregate that joins back."""
    if not keys:
        sums = df.agg(F.sum(value).alias("__sum"))
        return df.crossJoin(F.broadcast(sums)).withColumn(out, F.try_divide(F.col(value), F.col("__sum"))).drop("__sum")
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    return df.join(sums, keys).withColumn(out, F.try_divide(F.col(value), F.col("__sum"))).drop("__sum")


def count_compare(df: DataFrame, keys: list[str], condition: Column, n: int, out: str = "sign") -> DataFrame:
    """The sign of (rows that meet the condition) - n."""
    return df.groupBy(*keys).agg(F.signum((F.count_if(condition) - n).cast("double")).cast("int").alias(out))


# --- order within a key ---


def sliding_pairs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Each value with the next of its key."""
    after = F.lead(value).over(Window.partitionBy(*keys).orderBy(*order))
    last = F.lead(F.lit(1)).over(Window.partitionBy(*keys).orderBy(*order))
    return df.select(*keys, *order, F.col(value).alias("first"), after.alias("second"), last.alias("__more")).where("__more = 1").drop("__more")


def split_where(df: DataFrame, keys: list[str], order: list[str], delimiter: Column) -> DataFrame:
    """The rows that aren't delimiters, with `chunk`: how many delimiters of their key come before. A chunk number that no row
    has stands for an empty chunk; after the last row there are none."""
    before = F.sum(F.when(delimiter, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("chunk", before).where(~delimiter)


def drop_right_while(df: DataFrame, keys: list[str], order: list[str], condition: Column) -> DataFrame:
    """Rows of each key without the longest suffix that meets the condition."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn("__keep", F.max(F.when(~condition, 1).otherwise(0)).over(w)).where("__keep = 1").drop("__keep")


def zip_strict(left: DataFrame, right: DataFrame, keys: list[str], pos: str, check: bool = True) -> DataFrame:
    """Rows with equal keys and positions side by side; an error if either side has one that the other hasn't (or, with
    check=False, such rows with nulls)."""
    on = [*keys, pos]
    a, b = left.withColumn("__a", F.lit(True)), right.withColumn("__b", F.lit(True))
    both = a.join(b, on, "full_outer")
    if check:
        wrong = F.raise_error(F.lit("zip_strict: lengths differ")).cast("boolean")
        both = both.where(F.when(F.col("__a").isNull() | F.col("__b").isNull(), wrong).otherwise(F.lit(True)))
    return both.drop("__a", "__b")


def take_sub(df: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """The leading rows of each key whose sizes add up to at most the budget; it ends at the first overflow."""
    run = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", run).where(F.col("running") <= budget)


def split_at(df: DataFrame, keys: list[str], order: list[str], n: int, out: str = "first_part") -> DataFrame:
    """Marks the first n rows of each key."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= n)


def history(df: DataFrame, keys: list[str], iteration: str, length: int, lag: int = 0) -> DataFrame:
    """The newest `length` rows of each key, and of these every (lag + 1)-th."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(iteration)))
    return df.withColumn("__rank", rank).where(f"__rank <= {length} AND (__rank - 1) % {lag + 1} = 0").drop("__rank")


def _shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """A pseudo-random order that a seed fixes."""
    return df.orderBy(_shuffle_key(key, seed), key)


def shuffled_places(df: DataFrame, key: str, seed: int = 0, digits: int = 3) -> DataFrame:
    """df with place (from 1) in the order of `shuffled`. Rows are counted by the leading hexadecimal digits of their random key, and
    ranked within each such bucket, so no task sees all rows."""
    d = df.withColumn("__k", _shuffle_key(key, seed)).withColumn("__b", F.substring("__k", 1, digits))
    sizes = d.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__b").alias("__c"), (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    ranked = d.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__k", key)))
    return ranked.join(F.broadcast(before), F.col("__b") == F.col("__c")).withColumn("place", F.col("__r") + F.col("__before")).drop("__k", "__b", "__c", "__r", "__before")


def boundaries(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The rows of each sequence and a row before and after, with nulls and is_boundary = true."""
    ends = df.groupBy(*keys).agg((F.min(pos) - 1).alias("__lo"), (F.max(pos) + 1).alias("__hi"))
    ends = ends.select(*keys, F.explode(F.array("__lo", "__hi")).alias(pos))
    return df.withColumn("is_boundary", F.lit(False)).unionByName(ends.withColumn("is_boundary", F.lit(True)), allowMissingColumns=True)


# --- array forms ---


def to_tuple(a: Column, n: int) -> Column:
    """A struct of an array's n items; an error for any other length."""
    wrong = F.raise_error(F.concat(F.lit(f"to_tuple: {n} items are wanted, not "), F.size(a).cast("string")))
    guarded = F.when(F.size(a) == n, a).otherwise(F.array(wrong).cast("array<string>"))
    return F.struct(*[F.element_at(guarded, i + 1).alias(f"_{i + 1}") for i in range(n)])


def prepend(x: Column, a: Column) -> Column:
    return F.concat(F.array(x), a)


def append(a: Column, x: Column) -> Column:
    return F.concat(a, F.array(x))


def ended(a: Column) -> Column:
    """The array between two nulls."""
    return F.concat(F.array(F.lit(None)), a, F.array(F.lit(None)))


def unzip(pairs: Column) -> Column:
    """An array of structs (a, b) as a struct of arrays."""
    return F.struct(F.transform(pairs, lambda x: x["a"]).alias("a"), F.transform(pairs, lambda x: x["b"]).alias("b"))


def map_keys(m: Column, f: Callable[[Column], Column]) -> Column:
    """A map with its keys changed; an error if two become equal."""
    return F.transform_keys(m, lambda k, _: f(k))


def map_values(m: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform_values(m, lambda _, v: f(v))


def to_map(df: DataFrame, keys: list[str], name: str, value: str, out: str = "map") -> DataFrame:
    """The (name, value) rows of each key as a map."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias(out))


def map_to(a: Column, f: Callable[[Column], Column]) -> Column:
    """Each item with a function of it, as structs (_1, _2)."""
    return F.transform(a, lambda x: F.struct(x.alias("_1"), f(x).alias("_2")))


def map_to_value(a: Column, value: Column) -> Column:
    return F.transform(a, lambda x: F.struct(x.alias("_1"), value.alias("_2")))


def map_tuples(a: Column, names: list[str], f: Callable[..., Column]) -> Column:
    """A function of several arguments over an array of structs, whose fields of these names it takes."""
    return F.transform(a, lambda x: f(*[x[n] for n in names]))


def member(x: Column, values: list | None) -> Column:
    """Whether x is in a set; None is the set of everything."""
    return F.lit(True) if values is None else x.isin(*values)


def memoized(df: DataFrame, column: str, f: Callable[[Column], Column], out: str) -> DataFrame:
    """df with f of a column, evaluated once for each distinct value; for functions that cost more than a join."""
    known = df.select(F.col(column).alias("__m")).distinct().withColumn(out, f(F.col("__m")))
    return df.join(known, F.col(column).eqNullSafe(F.col("__m")), "left").drop("__m")


def accumulate(a: Column, start: float, step: Callable[[Column, Column], Column]) -> Column:
    """What a number becomes that an array's items change in turn."""
    return F.aggregate(a, F.lit(start), step)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once, though f uses it in lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def array_split(a: Column, is_delimiter: Callable[[Column], Column]) -> Column:
    """The chunks between delimiters: empty ones at the front and inside stay, those at the end don't."""

    def split(v: Column) -> Column:
        marked = F.transform(v, lambda x, i: F.when(is_delimiter(x), i + 1))
        cuts = F.concat(F.array(F.lit(0)), F.filter(marked, lambda i: i.isNotNull()), F.array(F.size(v) + 1))
        return _let(cuts, lambda c: F.zip_with(c, F.slice(c, F.lit(2), F.size(c) - 1), lambda i, j: F.when(j.isNotNull(), F.slice(v, i + 1, j - i - 1))))

    def trimmed(c: Column) -> Column:
        full = F.filter(F.transform(c, lambda x, i: F.when(F.size(x) > 0, i + 1)), lambda i: i.isNotNull())
        return F.slice(c, F.lit(1), F.coalesce(F.array_max(full), F.lit(0)))

    return F.when(a.isNotNull(), _let(_let(a, split), trimmed))


def array_drop_right_while(a: Column, condition: Callable[[Column], Column]) -> Column:
    keep = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))), lambda i: ~condition(F.get(a, i - 1)))
    return F.slice(a, F.lit(1), F.when(F.size(a) == 0, 0).otherwise(F.coalesce(F.array_max(keep), F.lit(0))))


def array_zip_strict(a: Column, b: Column) -> Column:
    wrong = F.raise_error(F.lit("zip_strict: lengths differ")).cast("boolean")
    return F.arrays_zip(F.when(F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(wrong), a).alias("a"), b.alias("b"))


def array_normalize(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), total))


def array_sliding(a: Column, n: int = 2) -> Column:
    """All runs of n neighbours; none if there are fewer."""
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n))).otherwise(F.array().cast("array<array<string>>"))


# --- ranges ---


def parse_range(s: Column, top: int | None = None) -> Column:
    """`1-3,5,8-` to an array of integers; an open end needs `top`. A part that isn't a range, or runs backwards, is an error."""
    parts = F.split(F.regexp_replace(s, r"\s+", ""), ",")

    def expand(p):
        lo, hi = F.regexp_extract(p, r"^(-?\d+)", 1), F.regexp_extract(p, r"^\d+-(\d+)$", 1)
        bad = F.raise_error(F.concat(F.lit("parse_range: "), p)).cast("array<int>")
        span = lambda b: F.when(lo.cast("int") <= b, F.sequence(lo.cast("int"), b)).otherwise(bad)
        out = F.when(p.rlike(r"^-?\d+$"), F.array(p.try_cast("int"))).when(p.rlike(r"^\d+-\d+$"), span(hi.try_cast("int")))
        if top is not None:
            out = out.when(p.rlike(r"^\d+-$"), span(F.lit(top)))
        return out.otherwise(bad)

    return F.flatten(F.transform(parts, expand))


def range_string(df: DataFrame, keys: list[str], value: str, out: str = "ranges") -> DataFrame:
    """Distinct integers of each key as compact ranges: gaps and islands."""
    d = df.select(*keys, F.col(value).cast("long").alias("__v")).distinct()
    island = F.col("__v") - F.row_number().over(Window.partitionBy(*keys).orderBy("__v"))
    runs = d.withColumn("__g", island).groupBy(*keys, "__g").agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    text = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo").cast("string")).otherwise(F.concat_ws("-", "__lo", "__hi"))
    listed = F.array_sort(F.collect_list(F.struct("__lo", text.alias("t"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias(out))
