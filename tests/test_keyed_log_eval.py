"""Keyed algebra, log-space arithmetic, evaluation: small cases with exact values."""

import math

import pytest
from pyspark.sql import functions as F

from loomtext.functions import logprob as L
from loomtext.operators import evaluate, keyed

PAIRS = [(1, "a"), (2, "b"), (3, "c"), (2, "a"), (2, "b"), (3, "d")]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")


def test_group_and_ungroup(spark):
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "ord int, k int, v string")
    lists = keyed.group_by_key(d, "k", "v", ["ord"])
    assert {r.k: r["values"] for r in lists.collect()} == {1: ["a"], 2: ["b", "a", "b"], 3: ["c", "d"]}
    assert {r.k: r["values"] for r in keyed.group_by_key(d, "k", "v", distinct=True).collect()} == {1: ["a"], 2: ["a", "b"], 3: ["c", "d"]}
    assert sorted((r.k, r.value) for r in keyed.ungroup(lists, "k", "values").collect()) == sorted(PAIRS)
    both = keyed.merge_lists([lists, lists], "k", "values")
    assert {r.k: r["values"] for r in both.collect()}[3] == ["c", "d", "c", "d"]
    assert keyed.counts(d.limit(0), "k").count() == 0


SPLITS = [
    ([7, 2, 8, 9, 2, 2, 6], [[7], [8, 9], [], [6]]),
    ([2, 7, 2, 8, 9, 2, 2, 2, 6], [[], [7], [8, 9], [], [], [6]]),
    ([7, 2, 8, 9, 2, 2, 6, 2, 2, 2], [[7], [8, 9], [], [6]]),
    ([2, 2], []),
    ([], []),
]


@pytest.mark.parametrize(("given", "wanted"), SPLITS)
def test_array_split(spark, given, wanted):
    got = one(spark, keyed.array_split(ints(*given), lambda x: x == 2))
    assert [[int(x) for x in c] for c in got] == wanted


def test_split_where_numbers_chunks(spark):
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate([2, 1, 2, 2, 3, 4, 2])], "k int, ord int, v int")
    assert sorted((r.chunk, r.v) for r in keyed.split_where(d, ["k"], ["ord"], F.col("v") == 2).collect()) == [(1, 1), (3, 3), (3, 4)]


def test_array_forms(spark):
    assert one(spark, keyed.array_drop_right_while(ints(1, 2, 3, 4, 5), lambda x: x > 3)) == [1, 2, 3]
    assert one(spark, keyed.array_drop_right_while(ints(4, 5), lambda x: x > 3)) == [] == one(spark, keyed.array_drop_right_while(ints(), lambda x: x > 3))
    assert one(spark, keyed.array_normalize(ints(1, 2, 2, 5))) == pytest.approx([0.1, 0.2, 0.2, 0.5])
    assert one(spark, keyed.array_sliding(ints(1, 2, 3))) == [[1, 2], [2, 3]] and one(spark, keyed.array_sliding(ints(1))) == []
    assert one(spark, keyed.prepend(F.lit(0), ints(1))) == [0, 1] and one(spark, keyed.append(ints(1), F.lit(2))) == [1, 2]
    assert one(spark, keyed.ended(ints(1))) == [None, 1, None]
    assert tuple(one(spark, keyed.to_tuple(F.array(F.lit("a"), F.lit("b")), 2))) == ("a", "b")
    with pytest.raises(Exception, match="to_tuple"):
        one(spark, keyed.to_tuple(F.array(F.lit("a")), 2))
    with pytest.raises(Exception, match="lengths differ"):
        one(spark, keyed.array_zip_strict(ints(1, 2), ints(1)))


def test_strict_zip(spark):
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, l string"), spark.createDataFrame([(0, "p")], "pos int, r string")
    with pytest.raises(Exception, match="lengths differ"):
        keyed.zip_strict(a, b, [], "pos").collect()
    assert keyed.zip_strict(a, b, [], "pos", check=False).count() == 2 and keyed.zip_strict(a.where("pos = 0"), b, [], "pos").count() == 1


def test_budget_ends_at_first_overflow(spark):
    d = spark.createDataFrame([(0, 0, 3), (0, 1, 9), (0, 2, 1)], "k int, ord int, size int")
    assert [r.ord for r in keyed.take_sub(d, ["k"], ["ord"], "size", 5).collect()] == [0]


def test_boundaries_and_history(spark):
    d = spark.createDataFrame([(1, i, f"w{i}") for i in range(3)], "k int, pos int, sym string")
    assert sorted((r.pos, r.sym, r.is_boundary) for r in keyed.boundaries(d, ["k"], "pos").collect()) == [(-1, None, True), (0, "w0", False), (1, "w1", False), (2, "w2", False), (3, None, True)]
    assert sorted(r.pos for r in keyed.history(d, ["k"], "pos", 3, 1).collect()) == [0, 2]
    assert {r.pos for r in keyed.shuffled(d, "pos", 5).collect()} == {0, 1, 2}


def test_ranges(spark):
    assert one(spark, keyed.parse_range(F.lit("1-3,5, 8-"), 10)) == [1, 2, 3, 5, 8, 9, 10]
    for bad in ("x", "3-1", "5-"):
        with pytest.raises(Exception, match="parse_range"):
            one(spark, keyed.parse_range(F.lit(bad)))
    d = spark.createDataFrame([(x,) for x in (1, 2, 3, 5, 8, 9, 9)], "v int")
    assert keyed.range_string(d, [], "v").first().ranges == "1-3,5,8-9"



def test_log_numbers(spark):
    n = lambda x: L.to_log(F.lit(float(x)))
    ex = lambda c: one(spark, L.from_log(c))
    assert ex(L.log_add(n(3), n(2))) == pytest.approx(5) and ex(L.log_sub(n(5), n(3))) == pytest.approx(2)
    assert ex(L.log_mul(n(2), n(3))) == pytest.approx(6) and ex(L.log_div(n(6), n(3))) == pytest.approx(2) and ex(L.log_pow(n(2), 3)) == pytest.approx(8)
    assert ex(L.log_sub(n(5), n(1))) == pytest.approx(4)  # subtracting one isn't lost
    assert one(spark, n(0)) == -math.inf == one(spark, L.log_add(n(0), n(0))) == one(spark, L.log_sub(n(2), n(2)))
    assert one(spark, L.log_add(n(0), F.lit(-772.740105887932))) == pytest.approx(-772.740105887932) and one(spark, n(-1)) is None
    assert one(spark, L.approx(n(2), F.lit(math.log(2) + 1e-9))) and not one(spark, L.approx(n(2), n(3))) and not one(spark, L.approx(n(0), n(0)))
    with pytest.raises(Exception, match="negative"):
        one(spark, L.log_sub(n(1), n(2)))


def test_log_sum(spark):
    d = spark.createDataFrame([("a", -1000.0), ("a", -1000.0), ("b", -math.inf), ("c", 0.0), ("c", -math.inf)], "k string, x double")
    got = {r.k: r.log_sum for r in L.log_sum(d, ["k"], "x").collect()}
    assert got == {"a": pytest.approx(-1000 + math.log(2)), "b": -math.inf, "c": 0.0}


def test_confusion_and_measures(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")], "gold string, predicted string")
    m = evaluate.confusion(d).cache()
    assert m.count() == 9 and m.agg(F.sum("n")).first()[0] == 5
    got = {r.label: (r.precision, r.recall, r.f1) for r in evaluate.measures(m).collect()}
    assert got["a"] == pytest.approx((0.5, 0.5, 0.5)) and got["b"] == pytest.approx((2 / 3, 1, 0.8)) and got["c"] == (0, 0, 0)
    r = evaluate.report(m).first()
    assert r.accuracy == pytest.approx(0.6) and r.recall == pytest.approx(0.5)
    assert evaluate.printed(m).splitlines()[0].split() == ["a", "b", "c", "total"]
