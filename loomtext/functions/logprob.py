"""Log-space arithmetic as column expressions. A probability is held as its natural logarithm, zero as minus infinity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO, ONE = float("-inf"), 0.0


def to_log(x: Column) -> Column:
    """log(x), minus infinity for 0; null for null and for negative numbers."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(ZERO))


def from_log(a: Column) -> Column:
    return F.exp(a)


def log_add(a: Column, b: Column) -> Column:
    """log(e^a + e^b)."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(lo == ZERO, hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def log_sub(a: Column, b: Column) -> Column:
    """log(e^a - e^b); an error where that would be negative."""
    less = F.raise_error(F.lit("log_sub: the difference would be negative")).cast("double")
    return F.when(b == ZERO, a).when(a == b, F.lit(ZERO)).when(a < b, less).otherwise(a + F.log1p(-F.exp(b - a)))


def log_mul(a: Column, b: Column) -> Column:
    return a + b


def log_div(a: Column, b: Column) -> Column:
    return a - b


def log_pow(a: Column, n: Column | float) -> Column:
    return a * n


def approx(a: Column, b: Column, tolerance: float = 1e-8) -> Column:
    """Whether two logarithms differ by less than the tolerance; false for two zeros, as the difference isn't a number."""
    return F.coalesce(F.abs(a - b) < tolerance, F.lit(False)) & ~F.isnan(a - b)


# --- a logarithm and a plain number, on either side ---


def _both(a: Column | float, b: Column | float) -> tuple[Column, Column]:
    """Columns are logarithms, Python numbers are plain."""
    return tuple(x if isinstance(x, Column) else to_log(F.lit(float(x))) for x in (a, b))


def compare(a: Column | float, b: Column | float) -> Column:
    """-1, 0 or 1."""
    x, y = _both(a, b)
    return F.when(x == y, 0).otherwise(F.when(x < y, -1).otherwise(1))


def log_max(a: Column | float, b: Column | float) -> Column:
    return F.greatest(*_both(a, b))


def log_min(a: Column | float, b: Column | float) -> Column:
    return F.least(*_both(a, b))


def plus(a: Column | float, b: Column | float) -> Column:
    return log_add(*_both(a, b))


def minus(a: Column | float, b: Column | float) -> Column:
    return log_sub(*_both(a, b))


def times(a: Column | float, b: Column | float) -> Column:
    return log_mul(*_both(a, b))


def over(a: Column | float, b: Column | float) -> Column:
    return log_div(*_both(a, b))


def log_sum(df: DataFrame, keys: list[str], value: str, out: str = "log_sum") -> DataFrame:
    """log of the summed e^value of each key: a partial maximum, then a partial sum, so that skewed keys stay cheap."""
    top = df.groupBy(*keys).agg(F.max(value).alias("__top"))
    joined = df.select(*keys, F.col(value).alias("__x"))
    joined = joined.join(top, keys) if keys else joined.crossJoin(top)
    gap = F.when(F.col("__top") == ZERO, F.lit(0.0)).otherwise(F.exp(F.col("__x") - F.col("__top")))
    sums = joined.groupBy(*keys, "__top").agg(F.sum(gap).alias("__sum"))
    return sums.select(*keys, F.when(F.col("__top") == ZERO, F.lit(ZERO)).otherwise(F.col("__top") + F.log("__sum")).alias(out))
