"""Sinks: parsed chunks, dataset descriptions, run logs."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="corvane-")


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: this application's part of the folder that spark.checkpoint.dir names. Without one a local session has a folder that goes when the process ends; a cluster has none, which is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/corvane-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder().name


def parsed(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, one folder a document."""
    chunks.write.partitionBy("doc_id").mode("overwrite").json(path)


def chunks_table(chunks: DataFrame, path: str, buckets: int = 0, table: str | None = None) -> None:
    """Chunks as Parquet; with `buckets`, as a table bucketed by doc_id, so that later joins on it need no shuffle."""
    if buckets:
        if not table:
            raise ValueError("a bucketed table needs a name")
        chunks.write.bucketBy(buckets, "doc_id").sortBy("doc_id").mode("overwrite").option("path", path).saveAsTable(table)
    else:
        chunks.write.mode("overwrite").parquet(path)


def run_log(results: DataFrame, path: str) -> None:
    """Results of a run as JSON, stamped with their time."""
    results.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def dataset_description(docs: DataFrame, name: str) -> DataFrame:
    """One JSON-LD line a document, and one for the dataset that names how many there are: kind, json."""
    each = docs.select(F.lit("file").alias("kind"), F.to_json(F.struct(F.lit("FileObject").alias("@type"), F.col("doc_id").alias("@id"), F.col("publication_number").alias("name"), F.col("doc_type").alias("encodingFormat"))).alias("json"))
    whole = docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dataset").alias("kind"), F.to_json(F.struct(F.lit("Dataset").alias("@type"), F.lit(name).alias("name"), F.col("n").alias("size"))).alias("json"))
    return whole.unionByName(each)
