"""Counts, smoothing, distributions, n-grams, tag dictionaries: hand-made cases with exact values."""

import math

import pytest
from pyspark.sql import functions as F

from loomtext.operators import counts as C
from loomtext.operators import ngram, tagdict


def counts(spark, cells, t=0.0, d=0.0):
    return C.Counts(spark.createDataFrame([(k, float(v)) for k, v in cells.items()], "item string, cnt double"), t, d)


def cond(spark, table):
    """{cond: (items, total_add, default)}"""
    cells = [(c, k, float(v)) for c, (items, _, _) in table.items() for k, v in items.items()]
    conds = [(c, float(t), float(d)) for c, (_, t, d) in table.items()]
    return C.CondCounts(spark.createDataFrame(cells, "cond string, item string, cnt double"), spark.createDataFrame(conds, "cond string, total_add double, default_cnt double"))


def probabilities(dist):
    p, d = dist
    return {r.item: r.p for r in p.collect()}, d.first().default_p


def look(spark, dist, *pairs):
    w = spark.createDataFrame(list(pairs), "cond string, item string")
    got = {(r.cond, r.item): r.p for r in dist.lookup(w).collect()}
    return [got[p] for p in pairs]


def test_freq_dist(spark):
    assert probabilities(C.freq_dist(counts(spark, {"a": 1.5, "b": 3.5})))[0] == pytest.approx({"a": 0.3, "b": 0.7})
    p, d = probabilities(C.freq_dist(counts(spark, {"a": 3, "b": 4}, 1, 2)))
    assert p == pytest.approx({"a": 0.375, "b": 0.5}) and d == 0.25


def test_nothing_counted(spark):
    empty = C.Counts(spark.createDataFrame([], "item string, cnt double"))
    assert probabilities(C.freq_dist(empty)) == ({}, 0.0)


def test_unseen_condition_backs_off_to_sums(spark):
    d = C.cond_dist(cond(spark, {"A": ({"a": 5, "b": 1}, 0, 0), "B": ({"a": 3, "b": 6}, 0, 0)}))
    assert look(spark, d, ("A", "a"), ("A", "z"), ("B", "b"), ("Z", "a"), ("Z", "b")) == pytest.approx([5 / 6, 0, 6 / 9, 8 / 15, 7 / 15])


def test_defaults_of_conditions(spark):
    d = C.cond_dist(cond(spark, {"A": ({"a": 3, "b": 4}, 1, 2), "B": ({"a": 4.4, "b": 4.6}, 1.5, 3)}))
    got = look(spark, d, ("A", "a"), ("A", "z"), ("B", "b"), ("B", "z"), ("Z", "a"), ("Z", "b"), ("Z", "z"))
    assert got == pytest.approx([3 / 8, 2 / 8, 4.6 / 10.5, 3 / 10.5, 7.4 / 18.5, 8.6 / 18.5, 5 / 18.5])


def test_constrain_and_add_lambda(spark):
    c = counts(spark, {"a": 5, "b": 3, "c": 6}, 2, 1)
    got = C.constrain(spark.createDataFrame([("a",), ("b",), ("d",)], "item string"))(c)
    assert {r.item: r.cnt for r in got.df.collect()} == {"a": 5, "b": 3, "c": 0, "d": 1} and (got.total_add, got.default_cnt) == (0, 0)
    p, d = probabilities(C.freq_dist(C.add_lambda(0.1)(c)))
    assert p == pytest.approx({"a": 5.1 / 16.4, "b": 3.1 / 16.4, "c": 6.1 / 16.4}) and d == pytest.approx(1.1 / 16.4)


def test_order_of_smoothers_matters(spark):
    c = counts(spark, {"a": 5, "b": 3})
    valid = spark.createDataFrame([("a",)], "item string")
    one = {r.item: r.cnt for r in C.add_lambda(1, C.constrain(valid))(c).df.collect()}
    other = {r.item: r.cnt for r in C.constrain(valid, C.add_lambda(1))(c).df.collect()}
    assert one == {"a": 6, "b": 1} and other == {"a": 6, "b": 0}


def test_drop_and_merge(spark):
    c = C.drop_items(spark.createDataFrame([("b",)], "item string"))(counts(spark, {"a": 1, "b": 2}))
    assert {r.item: r.cnt for r in c.merge(counts(spark, {"a": 2, "c": 1}, 1, 1)).df.collect()} == {"a": 3, "c": 1}
    with pytest.raises(ValueError):
        counts(spark, {"a": 1}, 1, 1).merge(counts(spark, {"a": 1}, 2, 1))


def test_eisner(spark):
    c = cond(spark, {"A": ({"a": 5, "b": 4, "c": 7, "x": 1, "y": 1, "z": 1}, 3, 2), "B": ({"a": 6, "c": 9, "x": 1, "y": 1}, 4, 3), "C": ({"a": 8}, 5, 1)})
    d = C.cond_dist(C.eisner(0.2, C.add_lambda(0.1))(c))
    got = look(spark, d, ("A", "a"), ("B", "b"), ("C", "a"), ("Z", "a"))
    share = 19.1 / 44.7
    assert got == pytest.approx([(5 + 0.6 * share) / 22.6, (3 + 0.4 * 4.1 / 44.7) / 27.4, 8 / 18, (19 + 1.0 * share) / 68])


def test_sparse_eisner_equals_filled(spark):
    data = spark.createDataFrame([("A", "a")] * 3 + [("A", "b"), ("B", "a"), ("B", "c")], "cond string, item string")
    c = C.CondCounts.of(data, "cond", "item")
    filled = C.cond_dist(C.eisner(1.5, C.add_lambda(1.0))(c))
    pairs = [(x, y) for x in "ABZ" for y in "abcz"]
    w = spark.createDataFrame(pairs, "cond string, item string")
    sparse = {(r.cond, r.item): r.p for r in C.sparse_eisner(c, w, 1.5).collect()}
    assert [sparse[p] for p in pairs] == pytest.approx(look(spark, filled, *pairs), abs=1e-9)


def test_sampling_follows_the_distribution(spark):
    p = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "item string, p double")
    n = {r.item: r["count"] for r in C.sample(p, spark.range(20_000), "id").groupBy("item").count().collect()}
    assert sum(n.values()) == 20_000
    assert [n[k] / 20_000 for k in "abc"] == pytest.approx([0.7, 0.2, 0.1], abs=0.015)
    assert all(abs(sum(d.values()) - 1) < 1e-9 for d in C.dirichlet({"x": 2, "y": 5}, 4))


WORDS = "that dog hates the cat".split() + ["."] * 8


@pytest.fixture(scope="module")
def letters(spark):
    rows = [(i, j, c) for i, w in enumerate(WORDS) for j, c in enumerate(w)]
    return spark.createDataFrame(rows, "seq_id int, pos int, sym string")


def p_of(spark, model, *wanted):
    rows = [((a, b), c) for a, b, c in wanted]
    w = spark.createDataFrame(rows, "cond struct<w2:string,w1:string>, item string")
    got = {(r.cond.w2, r.cond.w1, r.item): r.p for r in model.probability(w).collect()}
    return [got[k] for k in wanted]


def test_letter_trigrams(spark, letters):
    wanted = ((None, "t", "h"), (None, None, "t"), ("a", "t", None), ("z", "z", "a"), ("z", "z", "z"))
    assert p_of(spark, ngram.train(letters, 3), *wanted) == pytest.approx([2 / 2, 2 / 13, 2 / 3, 3 / 39, 0])
    assert p_of(spark, ngram.train(letters, 3, C.cond_add_lambda(1.0)), *wanted) == pytest.approx([3 / 14, 3 / 25, 3 / 15, 18 / 219, 15 / 219])


def test_sequence_probability(spark, letters):
    the = spark.createDataFrame([(0, i, c) for i, c in enumerate("the")], "seq_id int, pos int, sym string")
    assert ngram.train(letters, 3).score(the).first().logp == pytest.approx(math.log(2 / 13 * 1 * 1 / 2 * 1))
    assert ngram.train(letters, 3, C.cond_add_lambda(1.0)).score(the).first().logp == pytest.approx(math.log(3 / 25 * 3 / 14 * 2 / 14 * 2 / 13))


def test_generation_ends_and_uses_known_symbols(spark, letters):
    out = ngram.train(letters, 3).generate(20, seed=3)
    assert out == ngram.train(letters, 3).generate(20, seed=3)
    assert all(len(s) <= 100 and set(s) <= set("".join(WORDS)) for s in out)


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [("the", "D")] * 5 + [("dog", "N")] * 3 + [("walks", "V")] * 3 + [("walks", "N")]
    return spark.createDataFrame(rows, "sym string, tag string")


def weights(df):
    return {(r.sym, r.tag): r.weight for r in df.collect()}


def test_tag_dictionaries(spark, tagged):
    d = tagdict.weighted(tagged)
    assert weights(d.pairs)["walks", "V"] == 0.75
    assert {r.tag: r.weight for r in d.defaults.collect()} == pytest.approx({"D": 5 / 12, "N": 4 / 12, "V": 3 / 12})
    smooth = tagdict.weighted(tagged, C.cond_add_lambda(1.0))
    got = weights(smooth.pairs)
    assert [got["the", t] for t in "DNV"] == pytest.approx([6 / 9, 1 / 9, 1 / 9])
    assert {r.tag: r.weight for r in smooth.defaults.collect()} == pytest.approx({"D": 8 / 24, "N": 7 / 24, "V": 6 / 24})
    assert tagdict.top_pairs(tagged, 2).size() == 2
    assert weights(tagdict.top_symbols(tagged, 1).pairs).keys() == {("the", "D")}
    wanted = spark.createDataFrame([("the",), ("new",)], "sym string")
    few = tagdict.limit_defaults(tagdict.simple(tagged), 1)
    assert {(r.sym, r.tag) for r in few.lookup(wanted).collect()} == {("the", "D"), ("new", "N")}
    assert {r.known for r in few.contains(wanted).where("sym = 'new'").collect()} == {False}


def test_dictionary_from_lines(spark):
    lines = spark.createDataFrame([("the D",), ("walks V N",), ("walks N",), ("",)], "value string")
    d = tagdict.from_lines(lines, spark.createDataFrame([("D",), ("N",), ("V",)], "tag string"))
    assert set(weights(d.pairs)) == {("the", "D"), ("walks", "V"), ("walks", "N")}
    assert d.lifted().pairs.where(F.col("sym").isNull()).count() == 1 and d.without_default().defaults.count() == 0
