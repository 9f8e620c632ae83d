"""Fusing ranked lists, and restrictions that hold only where they leave something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["query_id", "doc_id", "chunk_id"]


def merge_hits(*lists: DataFrame) -> DataFrame:
    """All lists' hits, of a chunk the first list's; `merge_ord` is a hit's place. Lists have KEY, arm_rank and score."""
    out = None
    for i, hits in enumerate(lists):
        hits = hits.withColumn("arm_ord", F.lit(i))
        out = hits if out is None else out.unionByName(hits, allowMissingColumns=True)
    first = out.withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy("arm_ord", "arm_rank"))).where("r = 1").drop("r")
    return first.withColumn("merge_ord", F.row_number().over(Window.partitionBy("query_id").orderBy("arm_ord", "arm_rank")))


def rrf(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: KEY, and the sum of 1 / (k + rank) as score."""
    out = None
    for hits in lists:
        hits = hits.select(*KEY, "arm_rank")
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy(*KEY).agg(F.sum(1 / (k + F.col("arm_rank"))).alias("score"))


def union_pool(vector: DataFrame, other: DataFrame, weight: float = 1.0) -> DataFrame:
    """Both pools on the vector pool's scale: others' scores are mapped from 0..max to its min..max; of two scores the larger counts."""
    band = vector.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    top = Window.partitionBy("query_id")
    aux = other.select(*KEY, F.col("score").alias("s"), F.max("score").over(top).alias("m")).join(band, "query_id", "left")
    low, high = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(1.0))
    aux = aux.select(*KEY, (low + (high - low) * weight * F.col("s") / F.coalesce(F.nullif("m", F.lit(0.0)), F.lit(1.0))).alias("mapped"))
    both = vector.select(*KEY, "score").join(aux, KEY, "full")
    return both.select(*KEY, F.greatest("score", "mapped").alias("score"))


def restrict(hits: DataFrame, condition: Column, active: Column | bool = True) -> DataFrame:
    """A query's hits that meet `condition`, if any does (and `active`); else all of them."""
    active = F.lit(active) if isinstance(active, bool) else active
    good = F.coalesce(condition & active, F.lit(False))
    return hits.withColumn("good_", good).withColumn("any_", F.max("good_").over(Window.partitionBy("query_id"))).where("good_ or not any_").drop("good_", "any_")


def drop_synthetic(hits: DataFrame) -> DataFrame:
    fake = F.startswith("doc_id", F.lit("synth-")) | F.startswith(F.coalesce("publication_number", F.lit("")), F.lit("SYNTH-"))
    return hits.where(~fake)
