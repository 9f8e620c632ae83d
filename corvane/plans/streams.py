"""Plans over sources, sinks and streams. Streams read a folder's tables once, to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, writers
from ..streaming import sessions
from .base import MANUALS_SQL, manuals, sql
from .registry import plan, table


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's rows as a stream, whether it is one file or a folder of them (a pattern may match either)."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def drained(df: DataFrame, mode: str) -> DataFrame:
    """All that a stream puts out until its input ends: each batch is a folder's part, in complete mode the only one. Batches that are run again replace their part."""
    spark, path = df.sparkSession, f"{writers.shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={0 if mode == 'complete' else n}")

    spark.createDataFrame([], df.schema).write.parquet(f"{path}/out/batch=-1")
    query = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@plan("stream_session_windows", """SELECT user_id, count(*) AS n, min(ts) AS first_ts FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""")
def stream_session_windows(spark, folder):
    s = drained(sessions.session_activity(stream(spark, folder, "events"), "30 minutes", "365 days"), "complete")
    return s.select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("first_ts"))


@plan("stream_window_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_window_counts(spark, folder):
    s = drained(sessions.windowed_counts(stream(spark, folder, "events"), "1 hour", late="365 days"), "complete")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@plan("stream_trace_mining", "SELECT DISTINCT event_type, user_id FROM events")
def stream_trace_mining(spark, folder):
    return drained(sessions.new_traces(stream(spark, folder, "events"), ["event_type", "user_id"], "365 days"), "append").select("event_type", "user_id")


@plan("stream_board_fold", r"""SELECT conv_id, count(*) AS step, coalesce(min_by(said, turn), '') AS symptom FROM (SELECT conv_id, turn, trim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 160)) AS said FROM conversations WHERE role = 'user') GROUP BY 1""")
def stream_board_fold(spark, folder):
    """Turns come in one batch, so each conversation's last board is its only one."""
    b = drained(sessions.fold_boards(stream(spark, folder, "conversations"), ttl_ms=None), "update").where("step > 0")
    return b.groupBy("conv_id").agg(F.max(F.struct(F.col("step").cast("long").alias("step"), F.col("symptom_anchor").alias("symptom"))).alias("b")).select("conv_id", "b.*")


@plan("file_identity")
def file_identity(spark, folder):
    return readers.file_identities(spark, folder, "region*.parquet")


@plan("scan_parsed", """SELECT 'D' || source AS doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def scan_parsed(spark, folder):
    out = f"{writers.shared_folder(spark)}/parsed-{uuid.uuid4().hex}"
    d = table(spark, folder, "documents").select(F.concat(F.lit("D"), "source").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text")
    writers.parsed(d, out)
    back = spark.read.schema("chunk_id string, text string, doc_id string").json(out)
    return back.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


@plan("sink_run_log", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def sink_run_log(spark, folder):
    out = f"{writers.shared_folder(spark)}/log-{uuid.uuid4().hex}"
    writers.run_log(table(spark, folder, "events").select("event_id", "event_type"), out)
    back = spark.read.schema("event_id long, event_type string, logged_at timestamp").json(out)
    return back.where("logged_at is not null").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@plan("scan_manifest", sql("SELECT doc_id, publication_number FROM manuals", MANUALS_SQL))
def scan_manifest(spark, folder):
    """Manuals written as one JSON file each, and read as a manifest."""
    out = f"{writers.shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    manuals(spark).withColumn("d", F.col("doc_id")).write.partitionBy("d").json(out)
    return readers.manifest(spark, out).select("doc_id", "publication_number")


@plan("export_jsonld")
def export_jsonld(spark, folder):
    return writers.dataset_description(manuals(spark), "manuals")


@plan("fetch_traces", "SELECT 't' || event_id AS trace_id, event_type AS name, 'Why ' || user_id AS question FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 't' || event_id, event_type, 'Why ' || user_id FROM events WHERE event_id % 2 = 1")
def fetch_traces(spark, folder):
    e = table(spark, folder, "events")
    ask = F.concat(F.lit("Why "), "user_id")
    new = F.to_json(F.struct(F.concat(F.lit("t"), "event_id").alias("id"), F.col("event_type").alias("name"), F.struct(ask.alias("question")).alias("input")))
    old = F.to_json(F.struct(F.concat(F.lit("t"), "event_id").alias("traceId"), F.col("event_type").alias("name"), ask.alias("question")))
    return readers.trace_records(e.select(F.when(F.col("event_id") % 2 == 0, new).otherwise(old).alias("value"))).select("trace_id", "name", "question")
