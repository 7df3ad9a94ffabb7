"""Exact ranks, medians and joins give the same answer with and without splitting hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators.ordering import average_ranks, exact_median, has_hot_keys, hash_order, hash_rank, order_statistic, running_totals, with_values


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds two thirds of the rows; values repeat."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        "id", F.pmod(F.xxhash64("id"), F.lit(500)).cast("double").alias("v")).cache()


def test_hot_keys_are_found(skewed):
    assert has_hot_keys(skewed, ["k"], 1000)
    assert not has_hot_keys(skewed, ["k"], 2500)


@pytest.mark.parametrize("at_most", [None, 17])
def test_hash_rank_does_not_depend_on_splitting(skewed, at_most):
    rank = lambda hot: sorted(map(tuple, hash_rank(
        skewed, ["k"], hash_order(5, "id"), "id", hot_rows=hot, at_most=at_most).collect()))
    assert rank(100) == rank(10**9)


def test_hash_rank_does_not_depend_on_partitioning(skewed):
    rank = lambda df: sorted(map(tuple, hash_rank(df, ["k"], hash_order(5, "id"), "id", hot_rows=100).collect()))
    assert rank(skewed.repartition(7)) == rank(skewed.coalesce(1))


def test_running_totals_and_ranks(skewed):
    v = skewed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    split = sorted(map(tuple, running_totals(v, ["k"], "v", ["n"], hot_rows=20).select("k", "v", "n_before", "n_total").collect()))
    plain = sorted(map(tuple, running_totals(v, ["k"], "v", ["n"]).select("k", "v", "n_before", "n_total").collect()))
    assert split == plain
    ranks = {(r["k"], r["v"]): r["r"] for r in average_ranks(v, ["k"], "v", "n", "r", hot_rows=20).collect()}
    pdf = skewed.toPandas()
    pdf["r"] = pdf.groupby("k")["v"].rank()
    assert all(ranks[row.k, row.v] == row.r for row in pdf.itertuples())


def test_medians(skewed):
    want = skewed.toPandas().groupby("k")["v"].median().to_dict()
    for hot in (50, 10**9):
        assert {r["k"]: r["median"] for r in exact_median(skewed, ["k"], "v", hot_rows=hot).collect()} == want
    upper = {r["k"]: r["m"] for r in order_statistic(skewed, ["k"], "v", lambda n: F.floor(n / 2) + 1, "m", hot_rows=50).collect()}
    pdf = skewed.toPandas()
    assert upper == {k: np.sort(g["v"])[len(g) // 2] for k, g in pdf.groupby("k")}


def test_lookup(skewed):
    table = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).where(F.col("k") != "k0")
    plain = sorted(map(str, skewed.join(table.select("k", "top"), "k", "left").select("k", "id", "top").collect()))
    got = with_values(skewed, table, ["k"], ["top"])
    assert sorted(map(str, got.select("k", "id", "top").collect())) == plain
