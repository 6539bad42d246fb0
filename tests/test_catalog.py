"""Every query with SQL gives the rows of its SQL; every other runs and keeps its schema."""

import pytest

from compare import assert_same, database
from loomtext import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, db, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.SQL[name], db)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_native_plans_have_no_python(spark):
    for name in ("token_counts", "relative_freq", "sliding_pairs", "eisner_cond", "nb_classify", "kmeans_assign", "twokenize"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_columns_are_pruned(spark):
    plan = catalog.QUERIES["stopword_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
