"""Connected components by alternating large-star and small-star contraction, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s")).first()
    return row["n"], row["s"] or 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """`edges(u, v)` of longs, in either direction -> `(node, root)`, root the smallest node reachable.

    Nodes without an edge aren't returned. Edges to itself or with a null end are ignored. No round makes
    more edges than it has, a hub's minimum is combined before the shuffle, and both sides of each join
    are fresh exchanges, which Spark can split where a hub's partition is large.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large")
        large = both.join(least.hint("merge"), "u").where("v > u and v <> m")
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        discard(e, least)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small-star")
        discard(large, least)
        held, state = state, _state(e)
        if held == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
