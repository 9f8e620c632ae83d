"""Plans of metrics, grades and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes, texts
from ..operators import arms, metrics
from .base import CHUNKS_SQL, chunks, sql, vectors
from .registry import plan, table
from .retrieval import _cos

K = 8
#: Ranked hits: the nearest chunks of every vector whose id is divisible by 20.
HITS_SQL = f"""hits AS (SELECT query_id, chunk_no, doc_id, publication_number, revision, rank FROM (
  SELECT q.vec_id AS query_id, c.chunk_no, c.doc_id, c.publication_number, c.revision, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cos('q.embedding', 'e.embedding')} DESC, c.chunk_no) AS rank FROM embeddings q CROSS JOIN chunks c JOIN embeddings e ON e.vec_id = c.chunk_no WHERE q.vec_id % 20 = 0) WHERE rank <= 12)"""
#: Each query's targets: one label of its own, and a group of two.
TARGETS_SQL = """targets AS (SELECT vec_id AS query_id, 'own' AS target, 'W1' || lpad(CAST(vec_id % 20 AS VARCHAR), 7, '0') || CASE WHEN vec_id % 3 = 0 THEN ' Rev ' || chr(CAST(65 + vec_id % 2 AS INTEGER)) ELSE '' END AS label FROM embeddings WHERE vec_id % 20 = 0
  UNION ALL SELECT vec_id, 'any', 'D' || lpad(CAST((vec_id + 3) % 20 AS VARCHAR), 4, '0') FROM embeddings WHERE vec_id % 20 = 0 UNION ALL SELECT vec_id, 'any', 'W1' || lpad(CAST((vec_id + 5) % 20 AS VARCHAR), 7, '0') || 'A' FROM embeddings WHERE vec_id % 20 = 0)"""
PUB = r"""CASE WHEN NOT (regexp_matches(trim({x}), '(?i)\bRev\.?\s*[A-Z]\b') OR regexp_matches(trim({x}), '(?i)-rev[a-z]\b')) AND regexp_matches(trim({x}), '\bW[0-9]{8}[A-Z]\b') THEN regexp_extract(trim({x}), '\b(W[0-9]{8})[A-Z]\b', 1) ELSE nullif(upper(regexp_extract(trim({x}), '(?i)\b(W[0-9]{8}|SYNTH-[A-Z0-9-]+)\b', 1)), '') END"""
REV = r"""coalesce(nullif(upper(regexp_extract(trim({x}), '(?i)\bRev\.?\s*([A-Z])\b', 1)), ''), nullif(upper(regexp_extract(trim({x}), '(?i)-rev([a-z])\b', 1)), ''), nullif(regexp_extract(trim({x}), '\bW[0-9]{8}([A-Z])\b', 1), ''))"""
KEYS_SQL = "keyed AS (SELECT *, unnest(list_filter([doc_id, publication_number, publication_number || ' Rev ' || revision], lambda x: x IS NOT NULL)) AS key FROM hits)"


def matched(key: str, needle: str) -> str:
    hp, hr, wp, wr = PUB.replace("{x}", key), REV.replace("{x}", key), PUB.replace("{x}", needle), REV.replace("{x}", needle)
    return f"coalesce(CASE WHEN ({wp}) IS NULL THEN starts_with(lower({key}), lower({needle})) WHEN ({hp}) IS NOT NULL THEN ({wp}) = ({hp}) AND (({wr}) IS NULL OR ({hr}) IS NOT DISTINCT FROM ({wr})) ELSE contains(lower({key}), lower({wp})) AND (({wr}) IS NULL OR ({hr}) IS NOT DISTINCT FROM ({wr})) END, false)"


RANKS_SQL = f"""found AS (SELECT t.query_id, t.target, min(k.rank) AS rank FROM targets t JOIN keyed k USING (query_id) WHERE k.rank <= {K} AND {matched('k.key', 't.label')} GROUP BY 1, 2),
ranks AS (SELECT query_id, target, rank FROM (SELECT DISTINCT query_id, target FROM targets) LEFT JOIN found USING (query_id, target))"""
RANKED = (CHUNKS_SQL, HITS_SQL, TARGETS_SQL, KEYS_SQL, RANKS_SQL)


def hits(spark, folder):
    v = vectors(spark, folder)
    q = v.where("chunk_no % 20 = 0").select(F.col("chunk_no").alias("query_id"), F.col("embedding").alias("vector"))
    h = arms.vector_fetch(q, chunks(spark, folder).join(v, "chunk_no"), 12).withColumnRenamed("arm_rank", "rank")
    return h.withColumn("keys", codes.cite_keys(F.col("doc_id"), F.col("publication_number"), F.col("revision")))


def targets(spark, folder):
    n = F.col("vec_id")
    v = table(spark, folder, "embeddings").where("vec_id % 20 = 0")
    pub = lambda i: F.concat(F.lit("W1"), F.lpad((i % 20).cast("string"), 7, "0"))
    own = v.select(n.alias("query_id"), F.lit("own").alias("target"), F.concat(pub(n), F.when(n % 3 == 0, F.concat(F.lit(" Rev "), F.char((65 + n % 2).cast("int")))).otherwise("")).alias("label"))
    doc = v.select(n.alias("query_id"), F.lit("any").alias("target"), F.concat(F.lit("D"), F.lpad(((n + 3) % 20).cast("string"), 4, "0")).alias("label"))
    glued = v.select(n.alias("query_id"), F.lit("any").alias("target"), F.concat(pub(n + 5), F.lit("A")).alias("label"))
    return own.unionByName(doc).unionByName(glued)


def ranks(spark, folder):
    return metrics.target_ranks(hits(spark, folder), targets(spark, folder), K)


@plan("cite_keys", sql("SELECT query_id, rank, string_agg(key, ';' ORDER BY length(key), key) AS keys FROM keyed GROUP BY 1, 2", CHUNKS_SQL, HITS_SQL, KEYS_SQL))
def cite_keys(spark, folder):
    return hits(spark, folder).select("query_id", F.col("rank").cast("long").alias("rank"), F.array_join(F.array_sort("keys", lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).otherwise(1)), ";").alias("keys"))


@plan("matches_citation", sql(f"SELECT query_id, target, label, rank, bool_or({matched('key', 'label')}) AS matches FROM targets JOIN keyed USING (query_id) GROUP BY 1, 2, 3, 4", *RANKED[:4]))
def matches_citation(spark, folder):
    h = hits(spark, folder).select("query_id", F.col("rank").cast("long").alias("rank"), F.explode("keys").alias("key"))
    return targets(spark, folder).join(h, "query_id").groupBy("query_id", "target", "label", "rank").agg(F.bool_or(codes.matches_citation(F.col("key"), F.col("label"))).alias("matches"))


@plan("ir_target_ranks", sql("SELECT query_id, target, coalesce(rank, -1) AS rank FROM ranks", *RANKED))
def ir_target_ranks(spark, folder):
    return ranks(spark, folder).select("query_id", "target", F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"))


METRICS_SQL = f"""m AS (SELECT query_id, count(rank) = count(*) AS hit, count(rank) / count(*) AS recall, coalesce(1.0 / min(rank), 0) AS mrr,
coalesce(sum(1 / log2(rank + 1)), 0) / list_sum(list_transform(generate_series(1, least(count(*), {K})), lambda i: 1 / log2(i + 1))) AS ndcg, count(rank) AS found, count(*) AS total FROM ranks GROUP BY 1)"""


@plan("ir_metrics", sql("SELECT query_id, hit, round(recall, 6) AS recall, round(CAST(mrr AS DOUBLE), 6) AS mrr, round(ndcg, 6) AS ndcg, found, total FROM m", *RANKED, METRICS_SQL))
def ir_metrics(spark, folder):
    m = metrics.ranking_metrics(ranks(spark, folder), K)
    return m.select("query_id", "hit", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"), "found", "total")


@plan("ir_precision", sql(f"""SELECT query_id, round(count(r.doc_id) / count(*), 6) AS precision FROM (SELECT DISTINCT query_id, doc_id FROM hits WHERE rank <= {K}) h LEFT JOIN (SELECT DISTINCT doc_id FROM chunks JOIN labels l ON l.doc_id = chunk_no WHERE quality = 0) r USING (doc_id) GROUP BY 1""".replace("JOIN labels l ON l.doc_id = chunk_no", "JOIN (SELECT doc_id AS no, quality FROM labels) l ON l.no = chunk_no"), CHUNKS_SQL, HITS_SQL))
def ir_precision(spark, folder):
    good = table(spark, folder, "labels").where("quality = 0").select(F.col("doc_id").alias("chunk_no"))
    rel = chunks(spark, folder).join(good, "chunk_no").select("doc_id").distinct()
    h = hits(spark, folder)
    rel = h.select("query_id").distinct().crossJoin(rel)
    return metrics.precision(h, rel, K).select("query_id", F.round("precision", 6).alias("precision"))


@plan("strategy_means", sql("SELECT query_id % 5 AS strategy, round(avg(recall), 6) AS recall, round(avg(CAST(mrr AS DOUBLE)), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) FILTER (hit) AS hits FROM m GROUP BY 1", *RANKED, METRICS_SQL))
def strategy_means(spark, folder):
    m = metrics.ranking_metrics(ranks(spark, folder), K).withColumn("strategy", F.col("query_id") % 5)
    return m.groupBy("strategy").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count_if("hit").alias("hits"))


@plan("latency_percentiles", "SELECT event_type, round(avg(value), 6) AS mean, list_sort(list(value))[len(list(value)) // 2 + 1] AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, folder):
    return metrics.latency(table(spark, folder, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@plan("grade_hits", sql(f"""SELECT query_id, CASE WHEN bad THEN 'must_not_cite' WHEN NOT own THEN 'must_cite' WHEN NOT some THEN 'must_cite_any' ELSE 'ok' END AS detail FROM (
SELECT q.query_id, coalesce(bool_or(key = 'D0007'), false) AS bad, coalesce(bool_or(target = 'own' AND {matched('key', 'label')}), false) AS own, coalesce(bool_or(target = 'any' AND {matched('key', 'label')}), false) AS some FROM targets q JOIN keyed k USING (query_id) GROUP BY 1)""".replace(" AS some", " AS met").replace("NOT some", "NOT met"), *RANKED[:4]))
def grade_hits(spark, folder):
    h = hits(spark, folder).select("query_id", F.explode("keys").alias("key"))
    met = codes.matches_citation(F.col("key"), F.col("label"))
    g = targets(spark, folder).join(h, "query_id").groupBy("query_id").agg(F.bool_or(F.col("key") == "D0007").alias("bad"), F.bool_or((F.col("target") == "own") & met).alias("own"), F.bool_or((F.col("target") == "any") & met).alias("any"))
    return g.select("query_id", F.when(F.col("bad"), "must_not_cite").when(~F.col("own"), "must_cite").when(~F.col("any"), "must_cite_any").otherwise("ok").alias("detail"))


STOP = repr(texts.STOP_WORDS)
TOKENS = f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({{x}}, '')), '[a-z0-9]{{{{3,}}}}', 0)), lambda w: NOT list_contains({STOP}, w))"
FOLDED = r"trim(regexp_replace(lower(coalesce({x}, '')), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
#: A user's turn as a claim, the next assistant turn as the block that it cites; every third has the claim in it.
CLAIMS_SQL = r"""claims AS (SELECT conv_id, turn, text AS claim, CASE WHEN nxt IS NOT NULL OR turn % 4 = 2 THEN turn + 1 END AS cited, nxt AS evidence FROM (
  SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w || CASE WHEN turn % 3 = 0 THEN ' ' || text ELSE '' END END AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""


def claims(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, folder, "conversations")
    nxt = F.when(F.lead("role").over(w) == "assistant", F.concat(F.lead("text").over(w), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), "text")).otherwise("")))
    c = c.withColumn("evidence", nxt).where("role = 'user'")
    return c.select("conv_id", "turn", F.col("text").alias("claim"), F.when(F.col("evidence").isNotNull() | (F.col("turn") % 4 == 2), F.col("turn") + 1).alias("cited"), "evidence")


GROUNDED_SQL = f"""g AS (SELECT *, {TOKENS.format(x='claim')} AS t, {TOKENS.format(x='evidence')} AS e, {FOLDED.format(x='claim')} AS fc, {FOLDED.format(x='evidence')} AS fe FROM claims),
graded AS (SELECT conv_id, turn, cited IS NOT NULL OR (regexp_matches(claim, '(?i)\\b(test|check|measure|replace|disconnect|remove|install|torque|vac|ohm|inspect|unplug|bypass|jumper)\\b') AND len(t) >= 4) AS checked,
 CASE WHEN cited IS NULL THEN 'uncited procedural claim' WHEN coalesce(evidence, '') = '' THEN 'no evidence block'
  WHEN fc = '' OR (length(fc) >= 12 AND contains(fe, fc)) OR len(t) = 0 OR CASE WHEN len(t) <= 3 THEN len(list_intersect(t, e)) = len(t) ELSE len(list_intersect(t, e)) / len(t) >= 0.6 END THEN 'ok'
  WHEN len(list_intersect(t, e)) = 0 OR (len(list_filter(t, lambda w: NOT list_contains({texts.GENERIC_WORDS!r}, w))) > 0 AND len(list_filter(list_intersect(t, e), lambda w: NOT list_contains({texts.GENERIC_WORDS!r}, w))) = 0) THEN 'no supporting tokens in cited block' ELSE 'weak lexical support' END AS reason FROM g)"""


@plan("groundedness", sql("SELECT conv_id, turn, checked, CASE WHEN checked THEN reason ELSE '-' END AS reason FROM graded", CLAIMS_SQL, GROUNDED_SQL))
def groundedness(spark, folder):
    return metrics.groundedness(claims(spark, folder)).select("conv_id", "turn", "checked", F.coalesce("reason", F.lit("-")).alias("reason"))


@plan("unsupported_rate", sql("SELECT conv_id, count(*) FILTER (checked) AS checked, round(coalesce(count(*) FILTER (checked AND reason <> 'ok') / nullif(count(*) FILTER (checked), 0), -1), 6) AS rate FROM graded GROUP BY 1", CLAIMS_SQL, GROUNDED_SQL))
def unsupported_rate(spark, folder):
    g = metrics.groundedness(claims(spark, folder))
    return g.groupBy("conv_id").agg(F.count_if("checked").alias("checked"), F.round(F.coalesce(metrics.rate(~F.col("supported"), F.col("checked")), F.lit(-1.0)), 6).alias("rate"))


@plan("claim_check_gate", sql("SELECT conv_id, turn, checked FROM graded", CLAIMS_SQL, GROUNDED_SQL))
def claim_check_gate(spark, folder):
    return metrics.groundedness(claims(spark, folder)).select("conv_id", "turn", "checked")


@plan("unsafe_recall", "SELECT round(count(*) FILTER (toxic = 1 AND quality = 0) / nullif(count(*) FILTER (toxic = 1), 0), 6) AS unsafe_recall, round(count(*) FILTER (toxic = 0 AND quality = 0) / nullif(count(*) FILTER (toxic = 0), 0), 6) AS false_escalation_rate FROM labels")
def unsafe_recall(spark, folder):
    flagged = F.col("quality") == 0
    return table(spark, folder, "labels").agg(F.round(metrics.rate(flagged, F.col("toxic") == 1), 6).alias("unsafe_recall"), F.round(metrics.rate(flagged, F.col("toxic") == 0), 6).alias("false_escalation_rate"))
