"""Algebra of vectors held as arrays of numbers. Pairs of unequal length are cut to the shorter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cut(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(*_cut(a, b), lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(*_cut(a, b), lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(*_cut(a, b), lambda x, y: x * y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def divide(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: F.try_divide(x, by if isinstance(by, Column) else F.lit(by)))


def absolute(a: Column) -> Column:
    return F.transform(a, F.abs)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(*_cut(a, b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(squared_norm(a))


def with_intercept(a: Column) -> Column:
    return F.concat(a, F.array(F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null if either is all zeros."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(*_cut(a, b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(*_cut(a, b), lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, d: s + d * d))


DISTANCES = {"cosine": cosine, "manhattan": manhattan, "euclidean": euclidean}


def distance(name: str):
    if name not in DISTANCES:
        raise ValueError(f"no such distance: {name}")
    return DISTANCES[name]
