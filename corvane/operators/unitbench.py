"""Benches of retrieval: indexes of units by windows or beginnings, alternative embedders, strategies by fixtures, and their costs.

An embedder is a column function from text to an array of floats; a strategy a function from queries to ranked hits.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens
from . import arms, fusion, metrics
from .rows import map_rows, settled

# Prices of a curator's model, in dollars a million tokens.
INPUT_PRICE, OUTPUT_PRICE = 2.50, 10.00


def windows(units: DataFrame, keys: list[str], text: str = "source_text", budget: int = tokens.BUDGET) -> DataFrame:
    """keys, window (from 0), text and tokens: a unit's text in pieces that fit the budget."""
    types = ", ".join(f"{k} {units.schema[k].dataType.simpleString()}" for k in keys)

    def cut(u: dict) -> list[dict]:
        return [{k: u[k] for k in keys} | {"window": i, "text": w, "tokens": tokens.estimated(w)} for i, w in enumerate(tokens.windows(u[text], budget))]

    return map_rows(units.select(*keys, text), cut, f"{types}, window int, text string, tokens int")


def window_index(units: DataFrame, keys: list[str], embed: Callable[[Column], Column], text: str = "source_text", budget: int = tokens.BUDGET) -> tuple[DataFrame, DataFrame]:
    """(one vector for each window of a unit, the index's statistics)."""
    index = windows(units, keys, text, budget).withColumn("vector", embed(F.col("text")))
    return index, index_stats(units, index, text, budget)


def truncate_index(units: DataFrame, keys: list[str], embed: Callable[[Column], Column], text: str = "source_text", budget: int = tokens.BUDGET) -> tuple[DataFrame, DataFrame]:
    """(one vector a unit, of its first window, the index's statistics): what silent truncation would keep."""
    index = windows(units, keys, text, budget).where("window = 0").withColumn("vector", embed(F.col("text")))
    return index, index_stats(units, index, text, budget)


def index_stats(units: DataFrame, index: DataFrame, text: str, budget: int) -> DataFrame:
    """records, embed_tokens, units, over_budget_units."""
    over = units.agg(F.count(F.lit(1)).alias("units"), F.count_if(tokens.estimate(F.col(text)) > budget).alias("over_budget_units"))
    made = index.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("embed_tokens"))
    return made.crossJoin(over)  # one row each


def best_units(queries: DataFrame, records: DataFrame, limit: int, unit: str = "unit_key", record: str = "record_id") -> DataFrame:
    """query_id, unit, score and place: a query's units by their best record. queries: query_id, vector; records: record_id, unit_key, vector."""
    near = arms.nearest(queries, records.select(F.col(record).alias("id_"), F.col(unit).alias("group_"), F.col("vector").alias("embedding")), limit, group="group_", cosine=False)
    return near.select("query_id", F.col("group_").alias(unit), "score", F.col("arm_rank").alias("place"))


def unit_grades(fixtures: DataFrame, ranked: DataFrame) -> DataFrame:
    """fixture_id, passed, detail, hit, mrr, first_rank. fixtures: fixture_id, must, must_any, must_pub (arrays); ranked: fixture_id, place, unit_key, publication_number."""
    texts = "array<string>"
    held = F.array_sort(F.collect_list(F.struct("place", "unit_key")))
    top = ranked.groupBy("fixture_id").agg(held.alias("top"), F.collect_set("publication_number").alias("pubs"))
    f = fixtures.select("fixture_id", *[F.coalesce(c, F.array().cast(texts)).alias(c) for c in ("must", "must_any", "must_pub")]).join(top, "fixture_id", "left")
    empty = F.array().cast(top.schema["top"].dataType)
    f = f.withColumn("top", F.coalesce("top", empty)).withColumn("pubs", F.coalesce("pubs", F.array().cast(texts)))
    rank = lambda label: F.array_min(F.transform(F.filter("top", lambda t: t["unit_key"] == label), lambda t: t["place"]))
    own = F.transform("must", rank)
    some = F.array_min(F.transform("must_any", rank))
    missing = F.transform(F.filter("must", lambda x: rank(x).isNull()), lambda x: F.concat(F.lit("missing "), x))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    no_any = F.when((F.size("must_any") > 0) & some.isNull(), F.concat(F.lit("missing any of "), listed("must_any")))
    no_pub = F.when((F.size("must_pub") > 0) & ~F.arrays_overlap("must_pub", "pubs"), F.concat(F.lit("missing pub "), listed("must_pub")))
    f = f.withColumn("bad", F.concat(missing, F.array_compact(F.array(no_any, no_pub)))).withColumn("first_rank", F.array_min(F.array_compact(F.concat(own, F.array(some)))))
    labelled = (F.size("must") > 0) | (F.size("must_any") > 0)
    return f.select(
        "fixture_id", (F.size("bad") == 0).alias("passed"), F.when(F.size("bad") == 0, "ok").otherwise(F.array_join("bad", "; ")).alias("detail"),
        F.when(labelled, F.col("first_rank").isNotNull()).otherwise(F.size("bad") == 0).alias("hit"), (1.0 / F.col("first_rank")).alias("mrr"), "first_rank",
    )


def curator_cost(units: DataFrame, reps: DataFrame, by: list[str], input_price: float = INPUT_PRICE, output_price: float = OUTPUT_PRICE) -> DataFrame:
    """by, prompt_tokens, completion_tokens and dollars (4 digits) of one pass over units(by, title, source_text) that made reps(by, tokens)."""
    prompt = tokens.estimate(F.concat(F.lit("Unit title: "), F.coalesce("title", F.lit("None")), F.lit("\n\nUnit content:\n"), F.coalesce("source_text", F.lit(""))))
    asked = units.groupBy(*by).agg(F.sum(prompt).alias("prompt_tokens"))
    made = reps.groupBy(*by).agg(F.sum("tokens").alias("completion_tokens"))
    both = asked.join(made, by, "left").withColumn("completion_tokens", F.coalesce("completion_tokens", F.lit(0)).cast("long"))
    return both.withColumn("dollars", F.round(F.col("prompt_tokens") / 1e6 * input_price + F.col("completion_tokens") / 1e6 * output_price, 4))


def corpus_fingerprint(chunks: DataFrame) -> DataFrame:
    """fingerprint: 16 digits over all chunks' document, id and text, whatever their order.

    Each chunk has a SHA-256; the digests' eight words are added up over all chunks, in tasks and then among them, so
    that no task or row ever holds more than nine numbers. A changed, missing or repeated chunk changes the sums.
    """
    line = F.sha2(F.concat_ws("\x00", "doc_id", "chunk_id", F.coalesce("text", F.lit(""))), 256)
    words = [F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = chunks.select(line.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(w), F.lit(0)).cast("string").alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select(F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[f"w{i}" for i in range(8)]), 256), 1, 16).alias("fingerprint"))


def alternative_index(chunks: DataFrame, embed: Callable[[Column], Column], folder: str, fingerprint: str) -> tuple[DataFrame, bool]:
    """(chunks' vectors by another embedder, whether they were there): written once under the corpus's fingerprint in a shared folder."""
    spark, path = chunks.sparkSession, f"{folder}/{fingerprint}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    held = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    made = chunks.select("chunk_no", embed(F.col("text")).alias("embedding"))
    if not held:
        made.write.mode("overwrite").parquet(path)
    return spark.read.schema(made.schema).parquet(path), held


def alternative_hits(queries: DataFrame, chunks: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """The code arm's hits, then those of another embedder's vectors. queries: query_id, vector, codes; index: chunk_no, embedding."""
    near = arms.vector_fetch(queries.select("query_id", "vector"), chunks.drop("embedding").join(index, "chunk_no"), limit)
    return fusion.merge_hits(arms.code_fetch(queries.where(F.size("codes") > 0).select("query_id", "codes"), chunks), near)


def bakeoff(spark: SparkSession, strategies: dict[str, Callable[[], DataFrame]], targets: DataFrame, forbidden: DataFrame, k: int) -> DataFrame:
    """strategy, query_id, passed, detail, recall, mrr, ndcg and seconds (of the strategy, over all queries).

    A strategy gives hits (query_id, rank, keys). targets: query_id, target, label; forbidden: query_id, label.
    """
    out = None
    for name, run in strategies.items():
        began = time.perf_counter()
        hits = settled(run().select("query_id", "rank", "keys"))
        seconds = time.perf_counter() - began
        ranks = metrics.target_ranks(hits, targets, k)
        graded = metrics.graded_hits(hits, targets, forbidden)
        one = metrics.ranking_metrics(ranks, k).join(graded, "query_id").select(F.lit(name).alias("strategy"), "query_id", "passed", "detail", "recall", "mrr", "ndcg", F.lit(seconds).alias("seconds"))
        out = one if out is None else out.unionByName(one)
    return out


def scorecard(results: DataFrame) -> DataFrame:
    """strategy, passed, total, and mean recall, mrr and ndcg; the best first."""
    s = results.groupBy("strategy").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("passed"), F.desc("mrr"), "strategy")))  # one row a strategy
