"""The operators as registered queries, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, edit_counts, exact_dedup, filter_audit, langid, license_scan, quality, secrets, sharding, simhash, toxicity, whitening
from .common import table

#: Share of documents that importance resampling keeps where no label says otherwise.
QUALITY_FRACTION = 0.85
SHARDS = 16


def tokenizer_path() -> str:
    """The tokenizer file: CORVANE_TOKENIZER, or the public byte-level one."""
    if path := os.environ.get("CORVANE_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratios = quality.fit(docs, labels.where("quality = 1"))
    # as large a share is kept as labels call good
    good = labels.agg(F.avg("quality").alias("g")).first()["g"]
    return quality.resample(docs, ratios, QUALITY_FRACTION if good is None else float(good))


def sample_edits(text: str = "text"):
    """Three edits of each document, by its length: a replacement, an insertion and a deletion."""
    n = F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long")

    def edit(start, end, new: str):
        return F.struct(F.floor(start).alias("start"), F.floor(end).alias("end"), F.lit(new).alias("new"))

    return F.array(edit(n / 4, n / 4 + 7, " edited 42 words"), edit(n / 2, n / 2, "x\n\n  y"), edit(n * 3 / 4, n * 3 / 4 + 11, ""))


def op2_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", sample_edits().alias("edits"))
    return edit_counts.count_edits(docs, tokenizer_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(~langid.held_out()))
    out = langid.identify(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("dk")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False, decoded=False)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dimensions = [sharding.numeric_dimension(F.col("n_chars")), sharding.category_dimension(F.col("source")), sharding.category_dimension(F.col("lang"))]
    out = sharding.kd_shards(docs, dimensions, n_shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = ~toxicity.held_out()
    return toxicity.score(docs, toxicity.fit(docs.where(learn), labels.where(learn)))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality, op2_edit_counts, op3_simhash, op4_langid, op5_decontamination, op6_bpe, op7_sharding, op8_secrets, op9_toxicity, op10_exact_dedup, op11_whitening, op12_filter_audit, op13_license_scan]
    return {f.__name__: f for f in found}


#: Exact duplicates by a plain window over normalised texts.
OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size
  FROM n WINDOW w AS (PARTITION BY s ORDER BY cp DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, s AS text_sha256 FROM r
"""


#: Each order of the filters applied to all documents of each part.
OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1
), d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY x) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
  SELECT a.x || b.x || c.x || e.x || g.x AS filter_order FROM f a JOIN f b ON b.x <> a.x JOIN f c ON c.x NOT IN (a.x, b.x) JOIN f e ON e.x NOT IN (a.x, b.x, c.x) JOIN f g ON g.x NOT IN (a.x, b.x, c.x, e.x)
), s AS (SELECT filter_order, step, substr(filter_order, 1, step - 1) AS done, substr(filter_order, step, 1) AS own FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) k
), m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY 1, 2
), c AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT fail) AS kept, sum(n) FILTER (NOT gone AND fail) AS removed, sum(n) FILTER (gone AND fail) AS redundant,
    sum(n) FILTER (fails = own) AS unique_fails, sum(good) FILTER (NOT gone AND fail) AS good_lost, sum(toxic) FILTER (NOT gone AND fail) AS toxic_lost
  FROM (SELECT *, fails <> translate(fails, done, '') AS gone, contains(fails, own) AS fail FROM m, s) GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL, "op12_filter_audit": OP12_SQL}
