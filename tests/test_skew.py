"""Joins and lists under heavy keys."""

import pytest
from pyspark.sql import functions as F

from paidup.config import SkewSettings
from paidup.skew import hot_keys, lookup, short_lists

SMALL = SkewSettings(min_rows=500, salts=8)


@pytest.fixture()
def fact(spark):
    return spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).alias("k"))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_lookup_equals_plain_join(spark, fact, how):
    dim = spark.range(0, 500, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(
        spark.createDataFrame([(7, 70)], "k long, v long")
    )
    (hot,) = hot_keys(fact, ["k"], settings=SMALL)
    assert len(hot) == 1
    salted = lookup(fact, dim, ["k"], how, hot, ["id"], SMALL)
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, fact.join(dim, "k", how).collect()), key=str)


def test_salted_lookup_spreads_the_hot_key(spark, fact):
    dim = spark.createDataFrame([(7, 70)], "k long, v long")
    (hot,) = hot_keys(fact, ["k"], settings=SMALL)
    plan = lookup(fact, dim.hint("merge"), ["k"], "left", hot, ["id"], SMALL)
    assert "__salt" in plan._jdf.queryExecution().executedPlan().toString()


def test_no_hot_keys_in_an_empty_table(spark):
    assert hot_keys(spark.createDataFrame([], "a string, b long"), ["a"], ["a", "b"]) == [[], []]


def test_short_lists(spark, fact):
    rows = {r.k: r.entries for r in short_lists(fact, ["k"], "id", F.col("id"), 8).collect()}
    want = {}
    for r in fact.orderBy("id").collect():
        want.setdefault(r.k, []).append(r.id)
    assert rows == {k: ids[:8] for k, ids in want.items()}


def test_short_lists_cut_groups_before_the_shuffle(spark, fact):
    plan = short_lists(fact, ["k"], "id", F.col("id"), 15)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_clients_beyond_the_cap_have_no_items(spark):
    from paidup.config import MatchSettings
    from paidup.operators.amounts import client_profiles

    items = spark.range(400).select(
        F.when(F.col("id") < 380, "BIG").otherwise(F.concat(F.lit("C"), F.col("id") % 4)).alias("client_norm"),
        F.col("id").alias("item_ord"), F.col("id").cast("string").alias("document"), (F.col("id") * 100).alias("cents"),
    )
    rows = {r.client_norm: r for r in client_profiles(items, MatchSettings()).collect()}
    assert rows["BIG"].n_items == 16 and rows["BIG"].items is None
    assert [len(rows[f"C{i}"].items) for i in range(4)] == [5, 5, 5, 5]
