"""Plans of smaller operators: labels, tables, versions, boards and grades."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes, intent, layout, serials
from ..operators import chunking, corpus, golden, grading, metrics, tables, versions
from ..streaming import sessions as streaming
from . import helpers, pages, retrieval, storage
from . import metrics as metric_plans
from .base import ASKS_SQL, CHUNKS_SQL, EDGES_SQL, MANUALS_SQL, asks, chunks, edges, manuals, sql
from .registry import plan, table
from .texts import BIBLIOGRAPHIC, INSTALLATION, _quoted


def flag(name: str, pattern: str):
    @plan(name, sql(f"SELECT query_id, regexp_matches(ask, '{_quoted(pattern)}') AS flag FROM asks", ASKS_SQL))
    def run(spark, folder):
        return asks(spark).select("query_id", F.col("ask").rlike(pattern).alias("flag"))

    return run


flag("is_bibliographic", BIBLIOGRAPHIC)
flag("is_installation", INSTALLATION)
flag("is_acu_led", intent.LED)
flag("is_technician_depth", intent.TECHNICIAN)


@plan("engineering_digit", "SELECT p_partkey, coalesce(nullif(regexp_extract('M' || p_partkey, '([0-9])$', 1), ''), '') AS digit FROM part")
def engineering_digit(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.coalesce(serials.engineering_digit(F.concat(F.lit("m"), "p_partkey")), F.lit("")).alias("digit"))


@plan("is_superseded_doc", sql("SELECT doc_id, doc_id IN (SELECT doc_id FROM edges WHERE type = 'superseded_by') AS superseded FROM manuals", MANUALS_SQL, EDGES_SQL))
def is_superseded_doc(spark, folder):
    return corpus.kinds(manuals(spark), edges(spark)).select("doc_id", "superseded")


def metric(name: str, column: str, rounded: bool):
    value = f"round(CAST({column} AS DOUBLE), 6)" if rounded else column

    @plan(name, sql(f"SELECT query_id, {value} AS {column} FROM m", *metric_plans.RANKED, metric_plans.METRICS_SQL))
    def run(spark, folder):
        m = metrics.ranking_metrics(metric_plans.ranks(spark, folder), metric_plans.K)
        return m.select("query_id", (F.round(column, 6) if rounded else F.col(column)).alias(column))

    return run


metric("ir_hit", "hit", False)
metric("ir_recall", "recall", True)
metric("ir_mrr", "mrr", True)
metric("ir_ndcg", "ndcg", True)


@plan("high_precision_hit", sql("SELECT query_id, chunk_id, coalesce(m.score >= 0.999 OR list_has_any(error_codes, codes), false) AS precise FROM merged m JOIN (SELECT query_id, codes FROM asked) USING (query_id)", *retrieval.BASE, retrieval.MERGED_SQL))
def high_precision_hit(spark, folder):
    h = retrieval.merged(spark, folder).join(retrieval.queries(spark).select("query_id", "codes"), "query_id")
    return h.select("query_id", "chunk_id", F.coalesce((F.col("score") >= 0.999) | F.arrays_overlap("error_codes", "codes"), F.lit(False)).alias("precise"))


@plan("relevant_labels", sql("SELECT query_id, string_agg(DISTINCT label, ';' ORDER BY label) AS labels FROM targets GROUP BY 1", metric_plans.TARGETS_SQL))
def relevant_labels(spark, folder):
    """Queries without an explicit list: what must be cited, and what may."""
    t = metric_plans.targets(spark, folder)
    own = lambda name: F.collect_set(F.when(F.col("target") == name, F.col("label")))
    g = t.groupBy("query_id").agg(own("own").alias("must"), own("any").alias("some"))
    return g.select("query_id", F.array_join(grading.relevant_labels(F.lit(None).cast("array<string>"), F.col("must"), F.col("some")), ";").alias("labels"))


@plan("forbidden_labels", sql("SELECT query_id, string_agg(DISTINCT label, ';' ORDER BY label) AS labels FROM targets WHERE label LIKE '%Rev B' OR label LIKE 'D%' GROUP BY 1", metric_plans.TARGETS_SQL))
def forbidden_labels(spark, folder):
    g = metric_plans.targets(spark, folder).where("label like '%Rev B' or label like 'D%'").groupBy("query_id").agg(F.collect_list("label").alias("listed"))
    return g.select("query_id", F.array_join(grading.forbidden_labels(F.col("listed")), ";").alias("labels"))


@plan("synthetic_tests", sql("SELECT chunk_no, starts_with(CASE WHEN chunk_no % 5 = 0 THEN 'synth-' ELSE '' END || doc_id, 'synth-') AS fake FROM chunks", CHUNKS_SQL))
def synthetic_tests(spark, folder):
    named = F.concat(F.when(F.col("chunk_no") % 5 == 0, "synth-").otherwise(""), "doc_id")
    return chunks(spark, folder).select("chunk_no", corpus.is_synthetic(named, F.col("publication_number")).alias("fake"))


HEADERS_SQL = "h AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['Problem', 'Possible Cause', 'Checks'] WHEN 1 THEN ['Code', 'Remedy'] WHEN 2 THEN ['Symptom', 'Cause'] ELSE CAST([] AS VARCHAR[]) END AS headers, [p_name, '', CASE WHEN p_size % 5 = 0 THEN '(cid:3)' ELSE p_type END] AS cells FROM part)"


def headed(spark, folder):
    k = F.col("p_partkey") % 4
    heads = F.when(k == 0, F.array(F.lit("Problem"), F.lit("Possible Cause"), F.lit("Checks"))).when(k == 1, F.array(F.lit("Code"), F.lit("Remedy"))).when(k == 2, F.array(F.lit("Symptom"), F.lit("Cause"))).otherwise(F.array().cast("array<string>"))
    return table(spark, folder, "part").select("p_partkey", heads.alias("headers"), F.array("p_name", F.lit(""), F.when(F.col("p_size") % 5 == 0, "(cid:3)").otherwise(F.col("p_type"))).alias("cells"))


@plan("junk_table", sql(r"""SELECT p_partkey, n = 0 OR (s >= 8 AND n / s < 0.15) OR (c > 0 AND c >= greatest(1, n * 0.5)) OR (n <= 4 AND tiny) AS junk FROM (SELECT p_partkey, len(f) AS n, len(headers) + len(cells) AS s, len(list_filter(f, lambda x: regexp_matches(x, '(?i)\(cid:[0-9]+\)'))) AS c, len(list_filter(f, lambda x: length(trim(x)) > 8)) = 0 AS tiny FROM (SELECT *, list_filter(list_concat(headers, cells), lambda x: trim(x) <> '') AS f FROM h))""", HEADERS_SQL))
def junk_table(spark, folder):
    return headed(spark, folder).select("p_partkey", tables.is_junk(F.col("headers"), F.col("cells")).alias("junk"))


@plan("strip_nul", "SELECT doc_id, length(text) AS n FROM documents")
def strip_nul(spark, folder):
    dirty = F.concat(F.lit("\x00"), "text", F.lit("\x00"))
    return table(spark, folder, "documents").select("doc_id", F.char_length(layout.strip_nul(dirty)).cast("long").alias("n"))


@plan("count_pua", "SELECT doc_id, doc_id % 3 AS marks FROM documents")
def count_pua(spark, folder):
    x = F.concat("text", F.repeat(F.lit("\uf0d8"), (F.col("doc_id") % 3).cast("int")))
    return table(spark, folder, "documents").select("doc_id", layout.count_private(x).cast("long").alias("marks"))


@plan("split_list", "SELECT p_partkey, p_name || ';' || p_brand AS items FROM part")
def split_list(spark, folder):
    x = layout.map_private(F.concat(F.lit("\uf0d8 "), "p_name", F.lit(" \uf06e "), "p_brand"))
    items = F.filter(F.transform(F.split(x, "•"), lambda i: F.trim(i)), lambda i: i != "")
    return table(spark, folder, "part").select("p_partkey", F.array_join(items, ";").alias("items"))


@plan("quality_predicates", sql("SELECT chunk_no, regexp_matches(body, '[0-9]') AND length(regexp_replace(body, '[^A-Za-z]', '', 'g')) < 8 AS opaque FROM short", CHUNKS_SQL, pages.SHORT_SQL))
def quality_predicates(spark, folder):
    return chunks(spark, folder).select("chunk_no", chunking.is_opaque(F.col("text")).alias("opaque"))


@plan("page_blob", sql("SELECT doc_id, page, length(string_agg(text || chr(10), chr(10) ORDER BY chunk_no)) AS chars FROM chunks GROUP BY 1, 2", CHUNKS_SQL))
def page_blob(spark, folder):
    c = chunks(spark, folder).withColumns({"body": F.lit(None).cast("string"), "section_path": F.array().cast("array<string>")})
    return golden.page_facts(c, "chunk_no").select("doc_id", "page", F.char_length("blob").cast("long").alias("chars"))


@plan("sections", sql(f"SELECT doc_id, string_agg({pages.TRIMMED}, '>' ORDER BY pos) AS path FROM lines WHERE {pages.IS_HEADING} GROUP BY 1", pages.PAGES_SQL))
def sections(spark, folder):
    from ..operators import chunking

    heads = pages.lines(spark, folder).where(chunking.is_heading(F.col("line")))
    return heads.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("t")))), lambda r: r["t"]), ">").alias("path"))


OUTPUTS = "CASE event_id % 4 WHEN 0 THEN '{\"answer\": \"a\", \"abstained\": false}' WHEN 1 THEN 'ABSTAIN: no evidence' WHEN 2 THEN 'Plain prose [1].' ELSE '{\"abstained\": true}' END"


V = (MANUALS_SQL, storage.VERSIONS_SQL)


@plan("review_issues", sql("SELECT version, count(*) AS issues FROM tried WHERE code IS NOT NULL GROUP BY 1", storage.SPANS_SQL))
def review_issues(spark, folder):
    found = versions.validate_spans(*storage.order_spans(spark, folder)).where(F.col("code").isin("invalid_y", "unknown_page", "reversed_boundary"))
    return found.groupBy("version").agg(F.count(F.lit(1)).alias("issues"))


@plan("pair_in", sql(f"SELECT query_id, regexp_matches({helpers._NORM}, '\\b(stop|stops|stopped|stopping) (after|mid|halfway)\\b') AS found FROM said", helpers.SAID_SQL))
def pair_in(spark, folder):
    from ..operators import expansion

    return helpers.said(spark).select("query_id", expansion.normalised(F.col("ask")).rlike(r"\b(stop|stops|stopped|stopping) (after|mid|halfway)\b").alias("found"))


@plan("plan_code_hints", sql("SELECT query_id, 0 AS hints FROM asks", ASKS_SQL))
def plan_code_hints(spark, folder):
    return asks(spark).select("query_id", F.size(F.array().cast("array<string>")).alias("hints"))


@plan("provenance_block", sql("SELECT query_id, 'reported: ' || CASE WHEN len(codes) = 0 THEN '(none)' ELSE array_to_string(codes, ', ') END || '; planned: (none)' AS block FROM asked", ASKS_SQL, retrieval.ASKED_SQL))
def provenance_block(spark, folder):
    found = codes.error_codes(F.col("ask"))
    return asks(spark).select("query_id", F.format_string("reported: %s; planned: (none)", F.when(F.size(found) == 0, "(none)").otherwise(F.array_join(found, ", "))).alias("block"))


@plan("directive", sql("SELECT request_id, CASE action WHEN 'escalate' THEN 'escalate' WHEN 'warn' THEN 'warn' WHEN 'block' THEN 'none' ELSE CASE WHEN audience = 'technician' THEN 'technician' ELSE 'none' END END AS directive FROM assessed", pages.CASES_SQL, pages.ASSESS_SQL))
def directive(spark, folder):
    a = F.col("action")
    return pages.assessed(spark).select("request_id", F.when(a.isin("escalate", "warn"), a).when(a == "block", "none").when(F.col("audience") == "technician", "technician").otherwise("none").alias("directive"))


@plan("safety_fixture", sql("SELECT request_id, action = 'block' OR hazard IS NOT NULL OR bare AS stopped FROM hazards", pages.CASES_SQL, pages.ASSESS_SQL))
def safety_fixture(spark, folder):
    from ..operators import safety

    g = safety.gate(pages.assessed(spark))
    return g.select("request_id", ((F.col("action") == "block") | F.col("hazard").isNotNull() | (F.col("gate_rule") == "ungrounded-procedure")).alias("stopped"))


@plan("rerank_hits")
def rerank_hits(spark, folder):
    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        """A stand-in for a cross-encoder: shared words over the query's."""
        return pd.Series([len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.split()))) for q, t in zip(query, text)])

    h = retrieval.merged(spark, folder).join(asks(spark).select("query_id", "ask"), "query_id").withColumn("rerank", score("ask", F.substring("text", 1, 1500)))
    return h.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank"), "merge_ord"))).where("place <= 8").select("query_id", "chunk_id", "rerank", "place")


@plan("token_stream", r"SELECT conv_id, turn, CAST(ceil(length(text) / 24.0) AS BIGINT) AS pieces FROM conversations WHERE length(text) > 0")
def token_stream(spark, folder):
    pieces = streaming.pieces(F.col("text"))
    return table(spark, folder, "conversations").where(F.char_length("text") > 0).select("conv_id", "turn", F.size(pieces).cast("long").alias("pieces"))
