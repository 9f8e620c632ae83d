"""Plans of arms, fusion, applicability, boosts and top lists."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes, intent, serials
from ..operators import arms, fulltext, fusion, postings, ranking, vector_index
from ..sources.writers import shared_folder
from .base import ASKS_SQL, CHUNKS_SQL, EDGES_SQL, MANUALS_SQL, MODELS_SQL, RANGES_SQL, asks, chunks, edges, manuals, models, ranges, sql, vectors
from .registry import plan, table
from .texts import BIBLIOGRAPHIC, FOLD_SQL, INSTALLATION

COLS = "query_id, doc_id, chunk_id, chunk_no, text, page, kind, language, publication_number, revision, error_codes"
POOL, CODE_LIMIT = 20, 30


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


VEC_SQL = f"""vec AS (SELECT {COLS}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_no) AS arm_rank FROM (
  SELECT a.query_id, c.*, {_cos('q.embedding', 'e.embedding')} AS score FROM asks a JOIN embeddings q ON q.vec_id = a.query_id * 3 CROSS JOIN chunks c JOIN embeddings e ON e.vec_id = c.chunk_no) QUALIFY arm_rank <= {POOL})"""
CODES_OF = r"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '(?i)\bF\s*[0-9]\s*E\s*[0-9]\b', 0), lambda x: upper(regexp_replace(x, '\s+', '', 'g')))))"
ASKED_SQL = "asked AS (SELECT *, " + CODES_OF.replace("{x}", "ask") + r""" AS codes, list_sort(list_distinct(list_transform(regexp_extract_all(ask, '(?i)\bJ([0-9]{1,3})\b', 1), lambda x: 'J' || x))) AS connectors FROM asks)"""
CODE_SQL = f"""code AS (SELECT query_id, doc_id, chunk_id, chunk_no, text, page, kind, language, publication_number, revision, list_sort(list_distinct(list_concat(error_codes, codes))) AS error_codes, 1.0 AS score, arm_rank FROM (
  SELECT a.query_id, a.codes, c.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN kind = 'article' THEN 0 ELSE 1 END, len(error_codes), doc_id, chunk_no) AS arm_rank
  FROM asked a JOIN chunks c ON len(a.codes) > 0 AND (list_has_any(error_codes, a.codes) OR regexp_matches(text, '(?i)' || array_to_string(list_transform(a.codes, lambda k: 'F\\s*' || k[2] || '\\s*E\\s*' || k[4]), '|')))
  QUALIFY arm_rank <= {CODE_LIMIT}))"""


def queries(spark):
    a = F.col("ask")
    return asks(spark).withColumns({"codes": codes.error_codes(a), "connectors": codes.connector_ids(a), "revision": codes.requested_revision(a), "led": intent.is_led_query(a), "bibliographic": a.rlike(BIBLIOGRAPHIC), "installation": a.rlike(INSTALLATION)})


def vector_hits(spark, folder, limit=POOL):
    v = vectors(spark, folder)
    asked = asks(spark).join(v.withColumnRenamed("embedding", "vector"), F.col("chunk_no") == F.col("query_id") * 3).select("query_id", "vector")
    return arms.vector_fetch(asked, chunks(spark, folder).join(v, "chunk_no", "left"), limit)


def code_hits(spark, folder, limit=CODE_LIMIT):
    return arms.code_fetch(queries(spark).where(F.size("codes") > 0).select("query_id", "codes"), chunks(spark, folder), limit)


@plan("vector_fetch", sql("SELECT query_id, chunk_id, arm_rank, round(score, 6) AS score FROM vec", ASKS_SQL, CHUNKS_SQL, VEC_SQL))
def vector_fetch(spark, folder):
    return vector_hits(spark, folder).select("query_id", "chunk_id", F.col("arm_rank").cast("long").alias("arm_rank"), F.round("score", 6).alias("score"))


@plan("code_fetch", sql("SELECT query_id, chunk_id, arm_rank, array_to_string(error_codes, ',') AS error_codes FROM code", ASKS_SQL, CHUNKS_SQL, ASKED_SQL, CODE_SQL))
def code_fetch(spark, folder):
    return code_hits(spark, folder).select("query_id", "chunk_id", F.col("arm_rank").cast("long").alias("arm_rank"), F.array_join("error_codes", ",").alias("error_codes"))


CONNECTOR_SQL = r"""seeds AS (SELECT a.query_id, c.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN regexp_matches(text, '(?i)motor|stator|harness') THEN 0 ELSE 1 END, length(text) DESC, page, doc_id, chunk_no) AS r
  FROM asked a JOIN chunks c ON len(a.connectors) > 0 AND regexp_matches(text, '(?i)' || array_to_string(list_transform(a.connectors, lambda k: k || '([^0-9]|$)'), '|')) QUALIFY r <= 20),
beside AS (SELECT p.query_id, c.*, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, chunk_no) AS r FROM (SELECT DISTINCT query_id, doc_id, page FROM seeds) p JOIN chunks c USING (doc_id, page)
  WHERE kind IN ('heading', 'prose', 'procedure') AND length(text) >= 60 AND regexp_matches(text, '(?i)motor|stator|harness|acu') QUALIFY r <= 20),
both_arms AS (SELECT query_id, chunk_id, 1.0 AS score, 0 AS o, r FROM seeds UNION ALL SELECT query_id, chunk_id, 0.95, 1, r FROM beside),
once AS (SELECT * FROM both_arms QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY o, r) = 1)"""


@plan("connector_fetch", sql("SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY o, r) AS arm_rank FROM once QUALIFY arm_rank <= 20", ASKS_SQL, CHUNKS_SQL, ASKED_SQL, CONNECTOR_SQL))
def connector_fetch(spark, folder):
    asked = queries(spark).where(F.size("connectors") > 0).select("query_id", "connectors")
    return arms.connector_fetch(asked, chunks(spark, folder)).select("query_id", "chunk_id", "score", F.col("arm_rank").cast("long").alias("arm_rank"))


@plan("reference_fetch", sql(f"""SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN coalesce(language, 'en') = 'en' THEN 0 ELSE 1 END, CASE WHEN regexp_matches(text, '(?i)shipping|transport bolt|spacer') THEN 0 WHEN ins AND regexp_matches(text, '(?i)shipping|bolt|level|install') THEN 1 ELSE 2 END, page, chunk_id) AS arm_rank
FROM (SELECT DISTINCT v.query_id, e.target FROM vec v JOIN edges e USING (doc_id) WHERE e.type = 'references') t JOIN chunks c ON c.publication_number = t.target JOIN (SELECT query_id, regexp_matches(ask, '{INSTALLATION}') AS ins FROM asks) USING (query_id) QUALIFY arm_rank <= 8""", ASKS_SQL, CHUNKS_SQL, VEC_SQL, EDGES_SQL))
def reference_fetch(spark, folder):
    found = arms.reference_fetch(vector_hits(spark, folder), edges(spark), chunks(spark, folder), queries(spark).select("query_id", "installation"))
    return found.select("query_id", "chunk_id", F.col("arm_rank").cast("long").alias("arm_rank"))


@plan("manual_rev_fetch", sql(r"""SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN regexp_matches(text, '(?i)status LED') THEN 0 WHEN page = 44 THEN 1 WHEN regexp_matches(text, '(?i)TEST #1.*ACU Power Check') THEN 2 ELSE 4 END, page, chunk_id) AS arm_rank
FROM (SELECT query_id, upper(regexp_extract(ask, '(?i)\brevision\s+([A-Z])\b', 1)) AS rev FROM asks) q JOIN chunks c ON upper(c.revision) = q.rev JOIN manuals m ON m.publication_number = c.publication_number AND m.doc_type = 'service_manual' QUALIFY arm_rank <= 12""", ASKS_SQL, CHUNKS_SQL, MANUALS_SQL))
def manual_rev_fetch(spark, folder):
    asked = queries(spark).select("query_id", "revision", "led")
    able = asked.select("query_id").crossJoin(manuals(spark).where("doc_type = 'service_manual'").select("publication_number"))
    found = arms.manual_revision_fetch(asked, able, chunks(spark, folder))
    return found.select("query_id", "chunk_id", F.col("arm_rank").cast("long").alias("arm_rank"))


@plan("literal_fetch", sql("""SELECT query_id, chunk_id, n_literals, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS arm_rank FROM (
SELECT query_id, chunk_id, count(*) AS n_literals FROM (SELECT DISTINCT query_id, upper(x) AS x FROM (SELECT query_id, unnest(regexp_extract_all(ask || ' F3 c2 E5 password J3 TEST4', '[A-Za-z0-9]{2,}', 0)) AS x FROM asks) WHERE length(x) > 2 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')) l
JOIN chunks c ON contains(upper(c.text), l.x) WHERE (SELECT count(*) FROM chunks k WHERE contains(upper(k.text), l.x)) <= 40 GROUP BY 1, 2) QUALIFY arm_rank <= 40""", ASKS_SQL, CHUNKS_SQL))
def literal_fetch(spark, folder):
    asked = asks(spark).select("query_id", F.concat("ask", F.lit(" F3 c2 E5 password J3 TEST4")).alias("ask"))
    found = arms.literal_fetch(asked, chunks(spark, folder))
    return found.select("query_id", "chunk_id", "n_literals", F.col("arm_rank").cast("long").alias("arm_rank"))


def turn_asks(spark, folder):
    """Questions: what users said in conversations whose number divides by 20."""
    said = table(spark, folder, "conversations").where("conv_id % 20 = 0 AND role = 'user'")
    return said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("ask"))


def document_asks(spark, folder):
    """Questions: whole documents whose number divides by 20."""
    return table(spark, folder, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("ask"))


@plan("lexical_or")
def lexical_or(spark, folder):
    return fulltext.search(turn_asks(spark, folder), chunks(spark, folder), 20)


@plan("lexical_and")
def lexical_and(spark, folder):
    return fulltext.search(document_asks(spark, folder), chunks(spark, folder), 20, every=True)


@plan("postings_search")
def postings_search(spark, folder):
    """The same, from a store of postings that was made of the documents in two parts, of which the second replaces a third of the first."""
    held, n = chunks(spark, folder), F.col("chunk_no")
    store = postings.PostingsStore(spark, f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}")
    store.update(held.where(n % 4 != 3).withColumn("text", F.when(n % 4 == 0, F.lit("an earlier text")).otherwise(F.col("text"))))
    store.update(held.where(n % 4 % 3 == 0))
    return store.search(document_asks(spark, folder), 20, every=True)


def indexed(spark, folder):
    """An index of all embeddings, and its hits for those whose number divides by 20."""
    held = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id_"), "embedding")
    asked = held.where("id_ % 20 = 0").select(F.col("id_").alias("query_id"), F.col("embedding").alias("vector"))
    path = f"{shared_folder(spark)}/lists-{uuid.uuid4().hex}"
    book = vector_index.fit(held)
    vector_index.build(held, book, path)
    return held, asked, vector_index.search(asked, held, book, path, 8)


@plan("vector_index")
def vector_index_fetch(spark, folder):
    return indexed(spark, folder)[2].select("query_id", F.col("id_").alias("vec_id"), F.round("score", 9).alias("score"), "arm_rank")


@plan("vector_index_recall")
def vector_index_recall(spark, folder):
    """recall, against all rows, of the first eight hits."""
    held, asked, found = indexed(spark, folder)
    return vector_index.recall(found, arms.nearest(asked, held, 8))


MERGED_SQL = f"""listed AS (SELECT *, 0 AS arm_ord FROM code UNION ALL SELECT {COLS}, score, arm_rank, 1 FROM vec),
uniq AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, chunk_id ORDER BY arm_ord, arm_rank) = 1),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY arm_ord, arm_rank) AS merge_ord FROM uniq)"""
BASE = (ASKS_SQL, CHUNKS_SQL, ASKED_SQL, VEC_SQL, CODE_SQL)


def merged(spark, folder):
    return fusion.merge_hits(code_hits(spark, folder), vector_hits(spark, folder))


@plan("merge_hits", sql("SELECT query_id, chunk_id, merge_ord, round(CAST(score AS DOUBLE), 6) AS score FROM merged", *BASE, MERGED_SQL))
def merge_hits(spark, folder):
    return merged(spark, folder).select("query_id", "chunk_id", F.col("merge_ord").cast("long").alias("merge_ord"), F.round("score", 6).alias("score"))


@plan("rrf_fuse", sql("SELECT query_id, chunk_id, round(sum(1.0 / (60 + arm_rank)), 9) AS score FROM (SELECT query_id, chunk_id, arm_rank FROM code UNION ALL SELECT query_id, chunk_id, arm_rank FROM vec) GROUP BY 1, 2", *BASE))
def rrf_fuse(spark, folder):
    return fusion.rrf(code_hits(spark, folder), vector_hits(spark, folder)).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@plan("union_pool", sql("""SELECT query_id, chunk_id, round(max(s), 6) AS score FROM (SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS s FROM vec UNION ALL
SELECT c.query_id, c.chunk_id, coalesce(lo, 0) + (coalesce(hi, 1) - coalesce(lo, 0)) * (c.score / c.arm_rank) / max(c.score / c.arm_rank) OVER (PARTITION BY c.query_id) FROM code c LEFT JOIN (SELECT query_id, min(score) AS lo, max(score) AS hi FROM vec GROUP BY 1) b USING (query_id)) GROUP BY 1, 2""", *BASE))
def union_pool(spark, folder):
    other = code_hits(spark, folder).withColumn("score", F.col("score") / F.col("arm_rank"))
    return fusion.union_pool(vector_hits(spark, folder), other).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@plan("synthetic_exclude", sql("SELECT query_id, chunk_id FROM merged WHERE NOT starts_with(CASE WHEN chunk_no % 4 = 0 THEN 'synth-' ELSE '' END || doc_id, 'synth-') AND NOT starts_with(CASE WHEN chunk_no % 4 = 1 THEN 'SYNTH-1' ELSE publication_number END, 'SYNTH-')", *BASE, MERGED_SQL))
def synthetic_exclude(spark, folder):
    n = F.col("chunk_no")
    hits = merged(spark, folder).withColumn("doc_id", F.concat(F.when(n % 4 == 0, "synth-").otherwise(""), "doc_id")).withColumn("publication_number", F.when(n % 4 == 1, "SYNTH-1").otherwise(F.col("publication_number")))
    return fusion.drop_synthetic(hits).select("query_id", "chunk_id")


@plan("named_pub_restrict", sql(r"""SELECT query_id, chunk_id FROM (SELECT m.query_id, chunk_id, g, bool_or(g) OVER (PARTITION BY m.query_id) AS met FROM (SELECT m.*, NOT regexp_matches(ask, '(?i)\bpart\s*(number|#|no\.?)\b') AND list_contains(list_transform(regexp_extract_all(ask, '(?i)\b(W[0-9]{8})\b', 1), lambda x: upper(x)), publication_number) AS g FROM merged m JOIN asks USING (query_id)) m) WHERE g OR NOT met""", *BASE, MERGED_SQL))
def named_pub_restrict(spark, folder):
    hits = merged(spark, folder).join(asks(spark), "query_id")
    return fusion.restrict(hits, F.array_contains(codes.queried_publications(F.col("ask")), F.upper("publication_number"))).select("query_id", "chunk_id")


@plan("bibliographic_restrict", sql(rf"""SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, g, bool_or(g) OVER (PARTITION BY query_id) AS met FROM (SELECT m.query_id, m.chunk_id, coalesce(regexp_matches(ask, '{BIBLIOGRAPHIC}') AND d.doc_type = 'service_manual' AND m.revision = nullif(upper(regexp_extract(ask, '(?i)\brevision\s+([A-Z])\b', 1)), ''), false) AS g FROM merged m JOIN asks USING (query_id) JOIN manuals d USING (doc_id))) WHERE g OR NOT met""", *BASE, MERGED_SQL, MANUALS_SQL))
def bibliographic_restrict(spark, folder):
    hits = merged(spark, folder).join(queries(spark).select("query_id", F.col("revision").alias("wanted"), "bibliographic"), "query_id").join(manuals(spark).select("doc_id", "doc_type"), "doc_id")
    return fusion.restrict(hits, (F.col("doc_type") == "service_manual") & (F.col("revision") == F.col("wanted")), F.col("bibliographic")).select("query_id", "chunk_id")


NEEDED_SQL = f"""(regexp_matches(ask, '{BIBLIOGRAPHIC}') OR regexp_matches(ask, '{intent.TECHNICIAN.replace("'", "''")}') OR regexp_matches(ask, '(?i)\\bF\\s*[0-9]\\s*E\\s*[0-9]\\b') OR regexp_matches(ask, '(?i)\\bJ[0-9]{{1,3}}\\b') OR regexp_matches(ask, '{intent.PART_OR_TEST}'))"""
OWNERS_SQL = "(" + ", ".join(f"'{x}'" for x in ranking.OWNER_TYPES) + ")"


@plan("owner_restrict", sql(f"""SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, g, bool_or(g) OVER (PARTITION BY query_id) AS met FROM (SELECT m.query_id, m.chunk_id, coalesce(lower(audience) = 'owner', false) AND NOT {NEEDED_SQL} AND d.doc_type IN {OWNERS_SQL} AS g FROM merged m JOIN asks USING (query_id) JOIN manuals d USING (doc_id))) WHERE g OR NOT met""", *BASE, MERGED_SQL, MANUALS_SQL))
def owner_restrict(spark, folder):
    hits = merged(spark, folder).join(queries(spark).select("query_id", "ask", "audience", "bibliographic"), "query_id").join(manuals(spark).select("doc_id", "doc_type"), "doc_id")
    active = (F.lower(F.coalesce("audience", F.lit(""))) == "owner") & ~intent.needs_service_literature(F.col("ask"), F.col("bibliographic"))
    return fusion.restrict(hits, F.col("doc_type").isin(*ranking.OWNER_TYPES), active).select("query_id", "chunk_id")


@plan("arm_shortcircuit", sql(rf"""SELECT query_id, regexp_matches(ask, '{BIBLIOGRAPHIC}') AND regexp_matches(ask, '(?i)\brevision\s+[A-Z]\b') AND regexp_matches(ask, '{intent.LED}') AS skips FROM asks""", ASKS_SQL))
def arm_shortcircuit(spark, folder):
    return queries(spark).select("query_id", (F.col("bibliographic") & F.col("revision").isNotNull() & F.col("led")).alias("skips"))


def parse_sql(column: str, name: str) -> str:
    """Columns <name>_div, _code, _week, _seq of a serial, in SQL."""
    x = f"upper(replace(trim({column}), ' ', ''))"
    p1, p2 = r"'^([A-Z])([0-9A-Z])([0-9]{2})([0-9X]{1,6})$'", r"'^([A-Z]{2})([0-9A-Z])([0-9]{2})([0-9X]{1,6})$'"
    one, two = (f"coalesce(try_cast(regexp_extract({x}, {p}, 3) AS INTEGER) BETWEEN 1 AND 53, false)" for p in (p1, p2))
    return ", ".join(f"CASE WHEN {one} THEN regexp_extract({x}, {p1}, {i}) WHEN {two} THEN regexp_extract({x}, {p2}, {i}) END AS {name}_{part}" for i, part in enumerate(("div", "code", "week", "seq"), 1))


def key_sql(name: str, filler: str) -> str:
    years = f"generate_series(1990 + strpos('{serials.YEAR_CODES}', {name}_code) - 1, 2049, 30)"
    return f"(coalesce(list_min(list_filter({years}, lambda y: y >= yr)), list_max({years})), CAST({name}_week AS INTEGER), CAST(replace({name}_seq, 'X', '{filler}') AS INTEGER))"


APPLIES_SQL = f"""matched AS (SELECT DISTINCT query_id, doc_id FROM asks JOIN models ON CASE WHEN pattern LIKE '%*' THEN starts_with(model, rtrim(pattern, '*')) ELSE model = pattern END),
rng AS (SELECT a.query_id, r.doc_id, r.scope, a.serial, coalesce(a.introduced, CAST(substr(d.published, 1, 4) AS INTEGER)) AS yr, {parse_sql('a.serial', 's')}, {parse_sql('r.first', 'f')}, {parse_sql('r.last', 'l')}
  FROM asks a JOIN matched USING (query_id) JOIN ranges r ON r.doc_id = matched.doc_id JOIN manuals d ON d.doc_id = r.doc_id
  WHERE r.model IS NULL OR CASE WHEN r.model LIKE '%*' THEN starts_with(a.model, rtrim(r.model, '*')) ELSE a.model = r.model END),
seen AS (SELECT query_id, doc_id, bool_and(scope = 'all') AS every, bool_or(scope = 'all' OR coalesce(s_div = f_div AND {key_sql('s', '0')} >= {key_sql('f', '0')} AND {key_sql('s', '0')} <= {key_sql('l', '9')}, false)) AS inside,
  max(serial) IS NOT NULL AS has_serial, max(yr) IS NOT NULL AS dated, max(s_div) IS NOT NULL AS readable FROM rng GROUP BY 1, 2),
applies AS (SELECT query_id, doc_id, CASE WHEN m.doc_id IS NULL THEN 'model not listed' WHEN inside IS NULL THEN 'no serial restriction' WHEN every THEN 'all serial numbers' WHEN NOT has_serial THEN 'serial number missing' WHEN NOT dated THEN 'year code ambiguous'
  WHEN NOT readable THEN 'serial malformed' WHEN inside THEN 'serial in a range' ELSE 'serial outside every range' END AS reason
  FROM (SELECT query_id, manuals.doc_id FROM asks CROSS JOIN manuals) LEFT JOIN matched m USING (query_id, doc_id) LEFT JOIN seen USING (query_id, doc_id))"""
APPLIES = (MANUALS_SQL, MODELS_SQL, RANGES_SQL, APPLIES_SQL)
GOOD = "('no serial restriction', 'all serial numbers', 'serial in a range')"


def applies(spark):
    return ranking.document_applies(asks(spark), models(spark), ranges(spark), manuals(spark))


@plan("document_applies", sql(f"SELECT query_id, doc_id, reason IN {GOOD} AS applies, reason FROM applies", ASKS_SQL, *APPLIES))
def document_applies(spark, folder):
    return applies(spark)


@plan("corpus_supports", sql(f"SELECT query_id, count(*) FILTER (reason IN {GOOD}) AS n_documents, count(*) FILTER (reason IN {GOOD}) > 0 AS supported FROM applies GROUP BY 1", ASKS_SQL, *APPLIES))
def corpus_supports(spark, folder):
    return applies(spark).groupBy("query_id").agg(F.count_if("applies").alias("n_documents"), (F.count_if("applies") > 0).alias("supported"))


@plan("apply_filter", sql(f"SELECT query_id, chunk_id FROM merged JOIN applies USING (query_id, doc_id) WHERE reason IN {GOOD}", *BASE, MERGED_SQL, *APPLIES))
def apply_filter(spark, folder):
    return ranking.apply_filter(merged(spark, folder), applies(spark)).select("query_id", "chunk_id")


def joined(spark, folder, applied=True):
    """Hits with their query's and document's columns, as boosts want them."""
    e = edges(spark)
    kinds = e.groupBy("doc_id").agg(F.bool_or(F.col("type").isin("corrects", "supersedes", "overrides")).alias("corrects"), F.bool_or(F.col("type") == "superseded_by").alias("superseded"))
    hits = merged(spark, folder)
    docs = manuals(spark).select("doc_id", "doc_type", "tier").join(kinds, "doc_id", "left").fillna(False, ["corrects", "superseded"])
    cited = hits.select("query_id", "doc_id").distinct().join(manuals(spark).where("doc_type = 'knowledge_article'"), "doc_id").join(e.where("type = 'references'"), "doc_id").select("query_id", F.col("target").alias("publication_number")).distinct().withColumn("is_target", F.lit(True))
    if applied:
        hits = ranking.apply_filter(hits, applies(spark))
    hits = hits.join(docs, "doc_id", "left").join(queries(spark).select("query_id", "ask", "audience", "bibliographic", "installation").withColumn("mid_cycle", F.lit(False)), "query_id")
    return hits.join(cited, ["query_id", "publication_number"], "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def _r(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


BOOST_SQL = f"""kinds AS (SELECT doc_id, bool_or(type IN ('corrects', 'supersedes', 'overrides')) AS corrects, bool_or(type = 'superseded_by') AS superseded FROM edges GROUP BY 1),
cited AS (SELECT DISTINCT query_id, target FROM merged JOIN manuals d USING (doc_id) JOIN edges e USING (doc_id) WHERE d.doc_type = 'knowledge_article' AND e.type = 'references'),
facts AS (SELECT m.query_id, m.chunk_id, m.doc_id, m.merge_ord, m.score, m.text, m.kind, m.error_codes AS own, m.publication_number AS pub, m.revision, d.doc_type, d.tier, coalesce(k.corrects, false) AS corrects, coalesce(k.superseded, false) AS superseded, t.target IS NOT NULL AS is_target,
  regexp_matches(ask, {_r(BIBLIOGRAPHIC)}) AS bib, regexp_matches(ask, {_r(INSTALLATION)}) AS ins, regexp_matches(ask, {_r(intent.TECHNICIAN)}) AS tech, regexp_matches(ask, {_r(intent.LED)}) AS led, coalesce(lower(audience) = 'owner', false) AS own_audience,
  regexp_matches({FOLD_SQL}, {_r(intent.UNLOCK)}) AS u, regexp_matches({FOLD_SQL}, {_r(intent.LOCK)}) AS l, codes AS asked, nullif(upper(regexp_extract(ask, '(?i)\\brevision\\s+([A-Z])\\b', 1)), '') AS rev,
  CASE WHEN regexp_matches(ask, '(?i)\\bpart\\s*(number|#|no\\.?)\\b') THEN [] ELSE list_transform(regexp_extract_all(ask, '(?i)\\b(W[0-9]{{8}})\\b', 1), lambda x: upper(x)) END AS named,
  regexp_matches(m.text, {_r(ranking.UNLOCK_EVIDENCE)}) AS good, regexp_matches(m.text, {_r(ranking.WRONG_EVIDENCE)}) AS wrong
  FROM merged m JOIN asked a USING (query_id) LEFT JOIN manuals d USING (doc_id) LEFT JOIN kinds k USING (doc_id) LEFT JOIN cited t ON t.query_id = m.query_id AND t.target = m.publication_number),
more AS (SELECT *, u AND NOT l AS unlock, l AND NOT u AS lock, len(asked) > 0 AND list_has_any(own, asked) AS met, doc_type = 'knowledge_article' AS article, doc_type IN ('technical_service_pointer', 'service_pointer') AS pointer FROM facts),
boosted AS (SELECT *, CASE WHEN NOT bib THEN CASE WHEN corrects OR tier IN ('service_pointer', 'technical_service_pointer') OR pointer THEN 0.05 ELSE 0 END + CASE WHEN corrects THEN 0.08 ELSE 0 END - CASE WHEN superseded THEN 0.25 ELSE 0 END ELSE 0 END
  + CASE WHEN bib AND doc_type = 'service_manual' THEN 0.15 + CASE WHEN revision = rev THEN 0.25 ELSE 0 END WHEN bib AND pointer THEN -0.12 - CASE WHEN rev IS NOT NULL THEN 0.18 ELSE 0 END ELSE 0 END
  + CASE WHEN ins AND doc_type = 'installation_instructions' THEN 0.12 ELSE 0 END + CASE WHEN tier IN ('service_literature', 'service_pointer', 'technical_service_pointer') THEN 0.02 ELSE 0 END
  + CASE WHEN tech AND doc_type IN ('tech_sheet', 'service_manual') THEN 0.30 WHEN tech AND article THEN -0.45 ELSE 0 END
  + CASE WHEN own_audience AND doc_type IN {OWNERS_SQL} THEN 0.12 ELSE 0 END + CASE WHEN own_audience AND unlock AND doc_type IN ('owners_manual', 'knowledge_article') THEN 0.10 ELSE 0 END
  + CASE WHEN len(named) = 0 THEN 0 WHEN list_contains(named, pub) THEN 0.45 ELSE -0.35 END
  + CASE WHEN is_target THEN 0.25 + CASE WHEN ins AND len(asked) > 0 THEN 0.35 + CASE WHEN doc_type = 'installation_instructions' THEN 0.15 ELSE 0 END ELSE 0 END ELSE 0 END
  + CASE WHEN led THEN CASE WHEN regexp_matches(text, '(?i)drum light') THEN -0.20 ELSE 0 END + CASE WHEN regexp_matches(text, {_r(ranking.LED_EVIDENCE)}) THEN 0.30 ELSE 0 END + CASE WHEN regexp_matches(text, {_r(ranking.POWER_EVIDENCE)}) THEN 0.15 ELSE 0 END ELSE 0 END
  + CASE WHEN unlock AND good THEN 0.28 WHEN unlock AND wrong THEN -0.22 WHEN lock AND wrong THEN 0.12 ELSE 0 END
  + CASE WHEN NOT met THEN 0 WHEN (ins OR tech) AND article THEN 0.05 ELSE 0.15 + CASE WHEN list_has_all(asked, own) OR len(list_distinct(own)) <= 2 THEN 0.25 ELSE 0 END + CASE WHEN kind = 'article' THEN 0.10 ELSE 0 END + CASE WHEN article THEN 0.20 ELSE 0 END END AS boost FROM more),
applied AS (SELECT b.*, b.score + b.boost AS final_score FROM boosted b JOIN applies USING (query_id, doc_id) WHERE reason IN {GOOD})"""
RANKED = (*BASE, MERGED_SQL, EDGES_SQL, *APPLIES, BOOST_SQL)


@plan("boost_score", sql("SELECT query_id, chunk_id, round(CAST(boost AS DOUBLE), 6) AS boost, round(CAST(final_score AS DOUBLE), 6) AS final_score FROM applied", *RANKED))
def boost_score(spark, folder):
    return ranking.boosted(joined(spark, folder)).select("query_id", "chunk_id", F.round("boost", 6).alias("boost"), F.round("final_score", 6).alias("final_score"))


@plan("rank_sort", sql("SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, merge_ord) AS place FROM applied", *RANKED))
def rank_sort(spark, folder):
    hits = ranking.boosted(joined(spark, folder)).withColumn("final_score", F.round("final_score", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "merge_ord")
    return hits.select("query_id", "chunk_id", F.row_number().over(order).cast("long").alias("place"))


DIVERSE_SQL = """own AS (SELECT *, round(final_score, 9) AS f, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(final_score, 9) DESC, merge_ord) AS k, min(doc_id) OVER (PARTITION BY query_id) = max(doc_id) OVER (PARTITION BY query_id) AS alone FROM applied),
diverse AS (SELECT query_id, chunk_id, doc_id, f, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, merge_ord) AS place FROM own WHERE alone OR k <= 2 QUALIFY place <= 8)"""


def top(spark, folder, limit=8):
    return ranking.diverse_top(ranking.boosted(joined(spark, folder)).withColumn("final_score", F.round("final_score", 9)), limit)


@plan("diverse_top", sql("SELECT query_id, chunk_id, place, round(CAST(f AS DOUBLE), 6) AS final_score FROM diverse", *RANKED, DIVERSE_SQL))
def diverse_top(spark, folder):
    return top(spark, folder).select("query_id", "chunk_id", F.col("rank").cast("long").alias("place"), F.round("final_score", 6).alias("final_score"))


@plan("final_topk", sql("SELECT query_id, chunk_id, place FROM diverse WHERE place <= 3", *RANKED, DIVERSE_SQL))
def final_topk(spark, folder):
    return top(spark, folder).where("rank <= 3").select("query_id", "chunk_id", F.col("rank").cast("long").alias("place"))


@plan("rank_audit", sql("""SELECT query_id, chunk_id, CASE WHEN before >= 8 THEN 'top_k' WHEN fits THEN 'kept' ELSE 'max_per_doc' END AS disposition FROM (
SELECT query_id, chunk_id, alone OR k <= 2 AS fits, coalesce(sum(CASE WHEN alone OR k <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY f DESC, merge_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM own)""", *RANKED, DIVERSE_SQL))
def rank_audit(spark, folder):
    hits = ranking.boosted(joined(spark, folder)).withColumn("final_score", F.round("final_score", 9))
    return ranking.dispositions(hits, 8).select("query_id", "chunk_id", "disposition")


@plan("apply_only", sql(f"SELECT m.query_id, chunk_id, row_number() OVER (PARTITION BY m.query_id ORDER BY m.score DESC, merge_ord) AS place FROM merged m JOIN applies USING (query_id, doc_id) WHERE reason IN {GOOD} QUALIFY place <= 8", *BASE, MERGED_SQL, *APPLIES))
def apply_only(spark, folder):
    hits = ranking.apply_filter(merged(spark, folder), applies(spark))
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "merge_ord")).cast("long")).where("place <= 8").select("query_id", "chunk_id", "place")


@plan("reference_targets", sql("SELECT DISTINCT query_id, target FROM vec JOIN manuals d USING (doc_id) JOIN edges e USING (doc_id) WHERE d.doc_type = 'knowledge_article' AND e.type = 'references'", ASKS_SQL, CHUNKS_SQL, VEC_SQL, MANUALS_SQL, EDGES_SQL))
def reference_targets(spark, folder):
    hits = vector_hits(spark, folder).select("query_id", "doc_id").distinct()
    return hits.join(manuals(spark).where("doc_type = 'knowledge_article'"), "doc_id").join(edges(spark).where("type = 'references'"), "doc_id").select("query_id", "target").distinct()


@plan("weak_evidence", sql(r"""SELECT query_id, round(CAST(max(f) AS DOUBLE), 6) AS best, max(f) < 0.6 AND NOT bool_or(f >= 0.999 OR list_has_any(own, asked)) AS weak FROM own JOIN diverse USING (query_id, chunk_id) GROUP BY 1""".replace("own JOIN diverse USING (query_id, chunk_id)", "(SELECT o.* FROM own o JOIN diverse d USING (query_id, chunk_id))"), *RANKED, DIVERSE_SQL))
def weak_evidence(spark, folder):
    precise = (F.col("final_score") >= 0.999) | F.arrays_overlap("error_codes", codes.error_codes(F.col("ask")))
    t = top(spark, folder).groupBy("query_id").agg(F.max("final_score").alias("m"), F.bool_or(precise).alias("p"))
    return t.select("query_id", F.round("m", 6).alias("best"), ((F.col("m") < 0.6) & ~F.col("p")).alias("weak"))
