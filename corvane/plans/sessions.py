"""Plans of sessions, boards and trace mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, sessions
from .base import sql
from .registry import plan, table

@plan("session_store", """SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM (
SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS new FROM events)""")
def session_store(spark, folder):
    return sessions.sessionize(table(spark, folder, "events"), 1800).select("user_id", "event_id", "session_no")


@plan("assist_store", """SELECT user_id, session_no, count(*) AS n FROM (SELECT user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM (
SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2 HAVING count(*) <= 40""")
def assist_store(spark, folder):
    s = sessions.sessionize(table(spark, folder, "events"), 3600)
    return s.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n")).where("n <= 40")


PACK_SQL = """WITH RECURSIVE items AS (SELECT conv_id, turn, length(text) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
walk AS (SELECT conv_id, turn, r, CAST(cost AS BIGINT) AS used, true AS picked FROM items WHERE r = 1
UNION ALL SELECT i.conv_id, i.turn, i.r, CASE WHEN w.used + i.cost <= 600 THEN w.used + i.cost ELSE w.used END, w.used + i.cost <= 600 FROM walk w JOIN items i ON i.conv_id = w.conv_id AND i.r = w.r + 1)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY r) AS index FROM walk WHERE picked"""


@plan("format_evidence", PACK_SQL)
def format_evidence(spark, folder):
    items = table(spark, folder, "conversations").select("conv_id", "turn", F.char_length("text").alias("cost"))
    return evidence.pack(items, "conv_id", "turn", "cost", 600)


@plan("evidence_for_judge", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations) WHERE upto <= 400")
def evidence_for_judge(spark, folder):
    items = table(spark, folder, "conversations").select("conv_id", "turn", F.char_length("text").alias("cost"))
    return evidence.prefix_within(items, "conv_id", "turn", "cost", 400).select("conv_id", "turn")


HITS_SQL = """hits AS (SELECT conv_id AS query_id, turn AS rank, 'D' || conv_id % 5 AS doc_id, 'k' || conv_id || '-' || turn AS chunk_id, CAST(turn % 2 + 1 AS INTEGER) AS page, CASE WHEN turn % 3 <> 0 THEN CASE turn % 2 WHEN 0 THEN 'Leak ' ELSE 'leak ' END || conv_id % 3 END AS problem, 1.0 / (turn + 1) AS score, text AS body, turn * 1.5 AS x0, conv_id % 7 * 1.0 AS y0, conv_id % 12 AS unit FROM conversations)"""


def problem_hits(spark, folder):
    n, t = F.col("conv_id"), F.col("turn")
    title = F.when(t % 3 != 0, F.concat(F.when(t % 2 == 0, "Leak ").otherwise("leak "), n % 3))
    return table(spark, folder, "conversations").select(
        n.alias("query_id"), t.alias("rank"), F.concat(F.lit("D"), n % 5).alias("doc_id"), F.concat(F.lit("k"), n, F.lit("-"), t).alias("chunk_id"), (t % 2 + 1).cast("int").alias("page"), title.alias("problem_title"), (1 / (t + 1)).alias("score"),
        F.col("text").alias("body"), (t * 1.5).alias("x0"), (n % 7).cast("double").alias("y0"), (t * 2.5).alias("x1"), (n % 7 + 3).cast("double").alias("y1"), (n % 12).alias("unit_id"), F.array(F.concat(F.lit("F"), t % 2, F.lit("E1"))).alias("error_codes"), t.alias("place"),
    )


@plan("coalesce_problem", sql(r"""SELECT query_id, doc_id, page, round(CAST(max(score) AS DOUBLE), 6) AS score, min(x0) AS x0, min_by(chunk_id, rank) AS chunk_id, string_agg(chunk_id, ',' ORDER BY rank) AS merged, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS place FROM hits GROUP BY query_id, doc_id, page, coalesce(lower(problem), chunk_id)""", HITS_SQL))
def coalesce_problem(spark, folder):
    c = evidence.coalesce_problems(problem_hits(spark, folder))
    return c.select("query_id", "doc_id", "page", F.round("score", 6).alias("score"), "x0", "chunk_id", F.array_join("coalesced_chunk_ids", ",").alias("merged"), F.col("place").cast("long").alias("place"))


@plan("collapse_units", sql("SELECT query_id, unit AS unit_id, min(rank) AS rank, round(CAST(max(score) AS DOUBLE), 6) AS score, string_agg(chunk_id, ',' ORDER BY rank) AS matched FROM hits WHERE unit % 2 = 0 GROUP BY 1, 2", HITS_SQL))
def collapse_units(spark, folder):
    hits = problem_hits(spark, folder)
    units = hits.where("unit_id % 2 = 0").groupBy("unit_id").agg(F.max("body").alias("source_text"))
    c = evidence.collapse_units(hits, units)
    return c.select("query_id", "unit_id", "rank", F.round("score", 6).alias("score"), F.array_join("matched_representations", ",").alias("matched"))


@plan("expand_siblings", sql("""SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pl, own, chunk_id) AS place FROM (SELECT query_id, doc_id, chunk_id, pl, own FROM (
SELECT g.query_id, h.doc_id, h.chunk_id, g.pl, row_number() OVER (PARTITION BY g.query_id, g.doc_id, g.page, g.problem ORDER BY regexp_matches(h.body, '(?i)see test\\s*#'), NOT regexp_matches(h.body, '(?i)first'), h.y0, h.chunk_id) AS own
FROM (SELECT query_id, doc_id, page, problem, min(rank) AS pl FROM hits WHERE problem IS NOT NULL AND rank <= 2 GROUP BY ALL) g JOIN hits h USING (doc_id, page, problem)
UNION ALL SELECT query_id, doc_id, chunk_id, rank, 0 FROM hits WHERE rank <= 2) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, chunk_id ORDER BY pl, own DESC) = 1)""", HITS_SQL))
def expand_siblings(spark, folder):
    h = problem_hits(spark, folder)
    e = evidence.expand_siblings(h.where("rank <= 2"), h.withColumn("kind", F.lit("table_row")).select("doc_id", "chunk_id", "page", "problem_title", "kind", "body", "y0"))
    return e.select("query_id", "chunk_id", F.col("place").cast("long").alias("place"))
