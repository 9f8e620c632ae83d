"""Plans of versioned storage, curation and run logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import layout, texts
from ..operators import corpus, versions
from ..sources import snapshots as snapshots_of
from ..sources.writers import shared_folder
from .base import CHUNKS_SQL, MANUALS_SQL, chunks, manuals, sql
from .inputs import HISTORY_SQL, history
from .registry import plan, table

HASH = r"sha256(trim(regexp_replace({x}, '[ \t\n\x0B\f\r]+', ' ', 'g')))"
#: Versions of manuals: three of each, of which one at most is active.
VERSIONS_SQL = """versions AS (SELECT doc_id, v AS version, CASE WHEN v = 3 AND (CAST(substr(doc_id, 2) AS INTEGER) % 4) = 3 THEN 'abandoned' WHEN v = 2 AND CAST(substr(doc_id, 2) AS INTEGER) % 2 = 0 THEN 'active' WHEN v = 1 THEN 'superseded' WHEN v = 3 THEN 'ready' ELSE 'draft' END AS status FROM manuals CROSS JOIN (SELECT unnest([1, 2, 3]) AS v))"""


def document_versions(spark):
    n, v = F.substring("doc_id", 2, 9).cast("int"), F.col("version")
    status = F.when((v == 3) & (n % 4 == 3), "abandoned").when((v == 2) & (n % 2 == 0), "active").when(v == 1, "superseded").when(v == 3, "ready").otherwise("draft")
    return manuals(spark).select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version")).withColumn("status", status)


@plan("scan_active", sql("SELECT 'S' || l_suppkey AS doc_id, l_linenumber AS version, count(*) AS n FROM lineitem JOIN history h ON h.doc_id = 'S' || l_suppkey AND h.version = l_linenumber WHERE h.status = 'active' GROUP BY 1, 2", HISTORY_SQL))
def scan_active(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("version"))
    return corpus.active_rows(rows, history(spark, folder)).groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n"))


@plan("doc_fingerprint", sql(f"SELECT doc_id, sha256(string_agg(chunk_id || ':' || {HASH.format(x='text')}, chr(10) ORDER BY chunk_id)) AS fingerprint FROM chunks GROUP BY 1", CHUNKS_SQL))
def doc_fingerprint(spark, folder):
    line = F.concat("chunk_id", F.lit(":"), texts.content_hash(F.col("text")))
    return chunks(spark, folder).groupBy("doc_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


@plan("chunkset_fingerprint", sql(f"SELECT doc_id, page, string_agg(chunk_id || ':' || {HASH.format(x='text')}, '|' ORDER BY chunk_id) AS fingerprint FROM chunks GROUP BY 1, 2", CHUNKS_SQL))
def chunkset_fingerprint(spark, folder):
    line = F.concat("chunk_id", F.lit(":"), texts.content_hash(F.col("text")))
    return chunks(spark, folder).groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list(line)), "|").alias("fingerprint"))


@plan("rows_missing_vector", sql("SELECT chunk_no FROM chunks LEFT JOIN embeddings ON vec_id = chunk_no WHERE embedding IS NULL AND (language IS NULL OR starts_with(language, 'en'))", CHUNKS_SQL))
def rows_missing_vector(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_no"))
    return corpus.rows_without_vector(chunks(spark, folder), e, "chunk_no").select("chunk_no")


@plan("is_index_language", sql("SELECT chunk_no, coalesce(starts_with(replace(lower(language), '_', '-'), 'en'), true) AS indexed FROM chunks", CHUNKS_SQL))
def is_index_language(spark, folder):
    return chunks(spark, folder).select("chunk_no", layout.is_index_language(F.col("language")).alias("indexed"))


@plan("distinct_models", "SELECT DISTINCT 'model-' || label AS model FROM embeddings")
def distinct_models(spark, folder):
    e = table(spark, folder, "embeddings").select("embedding", F.concat(F.lit("model-"), "label").alias("embedding_model"))
    return corpus.models(e).select(F.col("embedding_model").alias("model"))


OLD_SQL = """old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 1000000, sha256(text) FROM documents WHERE doc_id % 50 = 0),
fresh AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS h FROM documents)"""


def snapshots(spark, folder):
    d = table(spark, folder, "documents")
    n = F.col("doc_id")
    old = d.where(n % 2 == 0).select(n, F.sha2("text", 256).alias("h")).unionByName(d.where(n % 50 == 0).select((n + 1_000_000).alias("doc_id"), F.sha2("text", 256).alias("h")))
    return old, d.select(n, F.sha2(F.when(n % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))


@plan("ingest_incremental", sql("SELECT doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'gone' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS state FROM old o FULL JOIN fresh n USING (doc_id)", OLD_SQL))
def ingest_incremental(spark, folder):
    return versions.classify_changes(*snapshots(spark, folder), "doc_id", "h")


@plan("sink_chunks", sql("SELECT doc_id, n.h, CASE WHEN n.h = o.h THEN doc_id * 1.5 END IS NOT NULL AS keeps_vector FROM fresh n LEFT JOIN old o USING (doc_id)", OLD_SQL))
def sink_chunks(spark, folder):
    old, new = snapshots(spark, folder)
    out = versions.replace_chunks(old.withColumn("v", F.col("doc_id") * 1.5), new, ["doc_id"], "h", "v")
    return out.select("doc_id", "h", F.col("v").isNotNull().alias("keeps_vector"))


@plan("sink_documents", sql("SELECT doc_id, coalesce(n.h, o.h) AS h FROM old o FULL JOIN (SELECT * FROM fresh WHERE doc_id % 3 = 0) n USING (doc_id)", OLD_SQL))
def sink_documents(spark, folder):
    old, new = snapshots(spark, folder)
    return versions.upsert(old, new.where("doc_id % 3 = 0"), "doc_id")


PUBLISHED_SQL = """SELECT source, d.doc_id, sha256(CASE WHEN bad THEN text ELSE text || '!' END) AS h FROM documents d JOIN (SELECT source, bool_or(contains(text, '#')) AS bad FROM documents GROUP BY 1) b USING (source) WHERE NOT bad OR d.doc_id % 2 = 0"""


def published(spark, folder):
    """A table with versions: sources with half of their documents, then all of them, edited; sources with a document that has a mark are held back."""
    d = table(spark, folder, "documents").select("source", "doc_id", "text")
    held = snapshots_of.SnapshotTable(spark, f"{shared_folder(spark)}/published-{uuid.uuid4().hex}", "source", "source string, doc_id bigint, text string")
    held.replace(d.where("doc_id % 2 = 0"))
    problems = d.where(F.contains("text", F.lit("#"))).select("source", F.lit("mark").alias("reason"))
    return held, snapshots_of.publish_documents(held, d.withColumn("text", F.concat("text", F.lit("!"))), problems)


@plan("publish_documents", PUBLISHED_SQL)
def publish_documents(spark, folder):
    held, _ = published(spark, folder)
    return held.read().select("source", "doc_id", F.sha2("text", 256).alias("h"))


@plan("publish_report", "SELECT source, NOT bool_or(contains(text, '#')) AS committed, CASE WHEN bool_or(contains(text, '#')) THEN 'mark' END AS reason FROM documents GROUP BY 1")
def publish_report(spark, folder):
    return published(spark, folder)[1][1]


@plan("revert_published", "SELECT source, doc_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0")
def revert_published(spark, folder):
    held, _ = published(spark, folder)
    held.revert(1)
    return held.read().select("source", "doc_id", F.sha2("text", 256).alias("h"))


@plan("next_version", sql("SELECT doc_id, max(version) + 1 AS next_version FROM versions WHERE status <> 'abandoned' GROUP BY 1", MANUALS_SQL, VERSIONS_SQL))
def next_version(spark, folder):
    return versions.next_version(document_versions(spark).where("status <> 'abandoned'"))


#: Spans made of order lines: an order's lines as units over a window of pages.
SPANS_SQL = """raw AS (SELECT l_orderkey AS version, l_linenumber AS idx, CAST(l_partkey % 12 + 1 AS INTEGER) AS start_page, CAST(l_partkey % 12 + 1 + l_suppkey % 4 - CASE WHEN l_suppkey % 17 = 0 THEN 5 ELSE 0 END AS INTEGER) AS end_page, l_discount * 10 AS start_y, CASE WHEN l_suppkey % 29 = 0 THEN 1.5 ELSE l_tax * 12 END AS end_y FROM lineitem),
win AS (SELECT o_orderkey AS version, 1 AS first, 14 AS last FROM orders),
tried AS (SELECT r.version, idx, start_page, end_page, least(greatest(start_y, 0), 1) AS sy, least(greatest(end_y, 0), 1) AS ey, CASE WHEN least(start_y, end_y) < -0.05 OR greatest(start_y, end_y) > 1.05 THEN 'invalid_y' WHEN start_page < first OR end_page > last OR start_page < 1 THEN 'unknown_page' WHEN start_page > end_page OR (start_page = end_page AND least(greatest(start_y, 0), 1) > least(greatest(end_y, 0), 1)) THEN 'reversed_boundary' END AS code FROM raw r JOIN win USING (version)),
good AS (SELECT * FROM tried WHERE code IS NULL)"""


def order_spans(spark, folder):
    lines = table(spark, folder, "lineitem")
    p, s = F.col("l_partkey") % 12 + 1, F.col("l_suppkey")
    end = p + s % 4 - F.when(s % 17 == 0, 5).otherwise(0)
    spans = lines.select(F.col("l_orderkey").alias("version"), F.col("l_linenumber").alias("idx"), p.cast("int").alias("start_page"), end.cast("int").alias("end_page"), (F.col("l_discount") * 10).alias("start_y"), F.when(s % 29 == 0, 1.5).otherwise(F.col("l_tax") * 12).alias("end_y"))
    return spans, table(spark, folder, "orders").select(F.col("o_orderkey").alias("version"), F.lit(1).alias("first"), F.lit(14).alias("last"))


@plan("validate_spans", sql("""SELECT version, code, coalesce(idx, -1) AS idx, coalesce(detail, '') AS detail FROM (
SELECT version, code, idx, NULL AS detail FROM tried WHERE code IS NOT NULL
UNION ALL SELECT version, 'duplicate_unit', idx, NULL FROM (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY version, start_page, sy, end_page, ey ORDER BY idx) > 1)
UNION ALL SELECT version, 'overlapping_units', idx, NULL FROM (SELECT *, lag(end_page) OVER w AS bp, lag(ey) OVER w AS bey FROM good WINDOW w AS (PARTITION BY version ORDER BY start_page, sy, end_page, ey, idx)) WHERE start_page < bp OR (start_page = bp AND sy < bey)
UNION ALL SELECT version, 'coverage_gap', NULL, count(*) || ' pages' FROM (SELECT version, unnest(generate_series(1, 14)) AS page FROM (SELECT DISTINCT version FROM good)) p WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.version = p.version AND p.page BETWEEN g.start_page AND g.end_page) GROUP BY 1
UNION ALL SELECT version, 'no_units', NULL, NULL FROM win WHERE version NOT IN (SELECT version FROM raw))""", SPANS_SQL))
def validate_spans(spark, folder):
    return versions.validate_spans(*order_spans(spark, folder)).select("version", "code", F.coalesce("idx", F.lit(-1)).alias("idx"), F.coalesce("detail", F.lit("")).alias("detail"))


#: Spans in order that don't overlap: each order's first line on a page.
CLEAN_SQL = """clean AS (SELECT version, min(idx) AS idx, start_page, start_page AS end_page, 0.25 AS start_y, 0.75 AS end_y FROM raw WHERE start_page <= 12 GROUP BY version, start_page),
nxt AS (SELECT *, row_number() OVER w AS own, lead(start_page) OVER w AS nx FROM clean WINDOW w AS (PARTITION BY version ORDER BY start_page))"""


@plan("absorb_gaps", sql("""SELECT version, idx, CASE WHEN own = 1 THEN 1 ELSE start_page END AS start_page, coalesce(nx - 1, 14) AS end_page, CASE WHEN own = 1 AND start_page > 1 THEN 0.0 ELSE start_y END AS start_y, CASE WHEN coalesce(nx - 1, 14) > end_page THEN 1.0 ELSE end_y END AS end_y FROM nxt""", SPANS_SQL, CLEAN_SQL))
def absorb_gaps(spark, folder):
    spans, win = order_spans(spark, folder)
    clean = spans.where("start_page <= 12").groupBy("version", "start_page").agg(F.min("idx").alias("idx")).select("version", "idx", "start_page", F.col("start_page").alias("end_page"), F.lit(0.25).alias("start_y"), F.lit(0.75).alias("end_y"))
    return versions.absorb_gaps(clean, win)


EDITIONS_SQL = "editions AS (SELECT 'E' || p_partkey AS doc_id, 'P' || p_partkey % 97 AS publication_number, CASE p_partkey % 4 WHEN 0 THEN '20' || lpad(CAST(p_size % 30 AS VARCHAR), 2, '0') WHEN 1 THEN '20' || lpad(CAST(p_size % 30 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') ELSE '2031-05-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') END AS published, CASE p_partkey % 3 WHEN 0 THEN chr(CAST(65 + p_size % 26 AS INTEGER)) WHEN 1 THEN CAST(p_size AS VARCHAR) END AS revision FROM part)"
EDITION_KEY = "(CAST(split_part(published, '-', 1) AS INTEGER), coalesce(try_cast(split_part(published, '-', 2) AS INTEGER), 0), coalesce(try_cast(split_part(published, '-', 3) AS INTEGER), 0), CASE WHEN revision IS NULL THEN 0 WHEN regexp_matches(revision, '^[A-Za-z]+$') THEN 1 ELSE 2 END, upper(coalesce(revision, '')))"


def editions(spark, folder):
    k, n = F.col("p_partkey"), F.col("p_size")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    year = F.concat(F.lit("20"), two(n % 30))
    published = F.when(k % 4 == 0, year).when(k % 4 == 1, F.concat(year, F.lit("-"), two(n % 12 + 1))).otherwise(F.concat(F.lit("2031-05-"), two(n % 28 + 1)))
    revision = F.when(k % 3 == 0, F.char((65 + n % 26).cast("int"))).when(k % 3 == 1, n.cast("string"))
    return table(spark, folder, "part").select(F.concat(F.lit("E"), k).alias("doc_id"), F.concat(F.lit("P"), k % 97).alias("publication_number"), published.alias("published"), revision.alias("revision"))


@plan("newest_edition", sql(f"SELECT publication_number, doc_id AS newest FROM editions QUALIFY row_number() OVER (PARTITION BY publication_number ORDER BY {EDITION_KEY} DESC, doc_id DESC) = 1", EDITIONS_SQL))
def newest_edition(spark, folder):
    return versions.newest_editions(editions(spark, folder))


@plan("newer_revision_note", sql(f"SELECT doc_id, publication_number, newest FROM editions JOIN (SELECT publication_number, doc_id AS newest FROM editions QUALIFY row_number() OVER (PARTITION BY publication_number ORDER BY {EDITION_KEY} DESC, doc_id DESC) = 1) USING (publication_number) WHERE doc_id <> newest AND doc_id LIKE '%7'", EDITIONS_SQL))
def newer_revision_note(spark, folder):
    e = editions(spark, folder)
    return e.where("doc_id like '%7'").join(versions.newest_editions(e), "publication_number").where("doc_id <> newest").select("doc_id", "publication_number", "newest")


@plan("prune_run_logs", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) > 100 OR ts < TIMESTAMP '2024-01-08' AS dropped FROM events")
def prune_run_logs(spark, folder):
    logs = table(spark, folder, "events").select(F.col("event_id").alias("log_id"), F.col("event_type").alias("prefix"), F.col("ts").alias("at"))
    return versions.prune(logs, 100, F.lit("2024-01-08").cast("timestamp_ntz")).select(F.col("log_id").alias("event_id"), F.col("drop").alias("dropped"))


def since(spec, now):
    """The moment that 7d, 24h or 30m before now is; null for other forms."""
    n = F.nullif(F.regexp_extract(F.lower(F.trim(spec)), r"^([0-9]+)\s*[dhm]$", 1), F.lit("")).cast("int")
    unit = F.right(F.trim(spec), F.lit(1))
    return now - F.make_dt_interval(F.when(unit == "d", n).otherwise(0), F.when(unit == "h", n).otherwise(0), F.when(unit == "m", n).otherwise(0))
