"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrafold.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v: neighbours are hung below the least node of each neighbourhood."""
    around = edges.select("u", "v")
    if large:
        around = around.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another node; root is the least node of its component.

    *edges* may hold repeated, reversed and looping pairs; nulls are left out. Neighbourhoods are aggregated and joined,
    never collected, so a node with very many neighbours is no bottleneck. The state is checkpointed after each round, and
    the rounds grow with the logarithm of the longest path.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"`{a}` is not null and `{b}` is not null and u > v")
    state = materialize(start.distinct())
    mark = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        state = materialize(_star(_star(state, large=True), large=False))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
