"""Plans of query planning, policies, parsing, intake and smaller helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codes, intent, parsing, texts
from ..operators import corpus, evidence, expansion, policy, ranking
from ..operators.rows import map_rows
from .base import ASKS_SQL, CHUNKS_SQL, EDGES_SQL, MANUALS_SQL, asks, chunks, edges, manuals, sql, values_sql
from .registry import plan, table
from .texts import FOLD_SQL

SAID = [
    (1, "The door got locked and it won't open"), (2, "door is locked shut"), (3, "door will not latch, door not lock"), (4, "it stops halfway through the wash"), (5, "shuts down with no error code"), (6, "F5E2 the door lock problem"), (7, "Something is wrong with the door lock"),
    (8, "door won't lock and it won't open"), (9, "washer is loud"), (10, ""), (11, "stopped mid cycle, door’s locked"),
]
SAID_SQL = values_sql("said", "query_id, ask", SAID)
_NORM = "trim(regexp_replace(lower(regexp_replace(translate(ask, '‘’`´', ''''''''''), '''', '', 'g')), '\\s+', ' ', 'g'))"


def family_sql(x: str, family: str) -> str:
    """Whether a text has a phrase of a family, in SQL."""
    return f"regexp_matches({_NORM.replace('ask', x)}, '{expansion.family_pattern(family)}')"


_FAM = {f[0]: f"regexp_matches({_NORM}, '{expansion.family_pattern(f[0])}')" for f in expansion.FAMILIES}
_ADD = {f[0]: f[4].replace("'", "''") for f in expansion.FAMILIES}
POLAR_SQL = f"""folded AS (SELECT *, regexp_matches(q, '{intent.UNLOCK}') AS u0, regexp_matches(q, '{intent.LOCK}') AS l0 FROM (SELECT *, {FOLD_SQL} AS q FROM said)),
polar AS (SELECT query_id, ask, mid, CASE WHEN u AND NOT l THEN 'unlock' WHEN l AND NOT u THEN 'lock' END AS polarity FROM (SELECT query_id, ask, {_FAM['mid_cycle_stop']} AS mid, (u0 AND NOT l0) OR {_FAM['door_unlock']} AS u, (l0 AND NOT u0) OR {_FAM['door_lock']} AS l FROM folded)),
planned AS (SELECT *, CASE WHEN regexp_matches(ask, '{expansion.DOOR_TOPIC}') OR polarity IS NOT NULL THEN 'door_lock' ELSE 'general' END AS topic,
  trim(array_to_string(list_filter([trim(ask), CASE polarity WHEN 'unlock' THEN '{_ADD['door_unlock']}' WHEN 'lock' THEN '{_ADD['door_lock']}' END, CASE WHEN mid THEN '{_ADD['mid_cycle_stop']}' END], lambda x: x IS NOT NULL), ' ')) AS embed_query, regexp_matches(ask, '(?i)\\bF\\s*[0-9]\\s*E\\s*[0-9]\\b') AS coded FROM polar)"""


def said(spark):
    return spark.createDataFrame(SAID, "query_id int, ask string")


@plan("door_lock_polarity", sql("SELECT query_id, coalesce(polarity, '') AS polarity FROM polar", SAID_SQL, POLAR_SQL))
def door_lock_polarity(spark, folder):
    return said(spark).select("query_id", F.coalesce(expansion.polarity(F.col("ask")), F.lit("")).alias("polarity"))


@plan("is_mid_cycle", sql("SELECT query_id, mid FROM polar", SAID_SQL, POLAR_SQL))
def is_mid_cycle(spark, folder):
    return said(spark).select("query_id", expansion.matches_family(F.col("ask"), "mid_cycle_stop").alias("mid"))


@plan("expand_query", sql("SELECT query_id, embed_query FROM planned", SAID_SQL, POLAR_SQL))
def expand_query(spark, folder):
    return said(spark).select("query_id", expansion.expanded(F.col("ask")).alias("embed_query"))


@plan("extract_intent", sql("SELECT query_id, topic, topic = 'door_lock' AND polarity IS NULL AND NOT coded AS ambiguous FROM planned", SAID_SQL, POLAR_SQL))
def extract_intent(spark, folder):
    return expansion.with_plan(said(spark)).select("query_id", "topic", "ambiguous")


@plan("plan_retrieval", sql("SELECT query_id, embed_query, 'vector,code,connector,xref' || CASE WHEN polarity IS NULL THEN '' ELSE ',polarity_expand' END AS hops FROM planned", SAID_SQL, POLAR_SQL))
def plan_retrieval(spark, folder):
    return expansion.with_plan(said(spark)).select("query_id", "embed_query", F.array_join("hops", ",").alias("hops"))


@plan("phrase_in", sql("SELECT query_id, regexp_matches(" + _NORM + ", '\\b(door is locked)\\b') AS found FROM said", SAID_SQL))
def phrase_in(spark, folder):
    return said(spark).select("query_id", expansion.normalised(F.col("ask")).rlike(r"\b(door is locked)\b").alias("found"))


FIT_SQL = """pool AS (SELECT doc_id % 40 AS query_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS rank, CASE doc_id % 13 WHEN 0 THEN 'The door won''t lock here' WHEN 1 THEN 'Door will not unlock' WHEN 2 THEN 'Ensure that door is completely closed' WHEN 3 THEN 'door not closed' ELSE 'x' END AS text FROM documents)"""


@plan("check_evidence_fit", sql(f"SELECT query_id, query_id % 2 = 1 OR NOT (count(*) FILTER (regexp_matches(text, '{ranking.WRONG_EVIDENCE.replace(chr(39), chr(39) * 2)}') AND NOT regexp_matches(text, '{ranking.UNLOCK_EVIDENCE.replace(chr(39), chr(39) * 2)}')) >= 2 AND count(*) FILTER (regexp_matches(text, '{ranking.UNLOCK_EVIDENCE.replace(chr(39), chr(39) * 2)}')) = 0) AS fits FROM pool WHERE rank <= 5 GROUP BY 1", FIT_SQL))
def check_evidence_fit(spark, folder):
    n = F.col("doc_id")
    text = F.when(n % 13 == 0, "The door won't lock here").when(n % 13 == 1, "Door will not unlock").when(n % 13 == 2, "Ensure that door is completely closed").when(n % 13 == 3, "door not closed").otherwise("x")
    hits = table(spark, folder, "documents").select((n % 40).alias("query_id"), n, text.alias("text"), F.when(n % 40 % 2 == 0, "unlock").alias("polarity"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return expansion.evidence_fits(hits, ranking.UNLOCK_EVIDENCE, ranking.WRONG_EVIDENCE)


DOMAINS = {"door": ("enum", ["STUCK_LOCKED", "WILL_NOT_LOCK", "UNKNOWN"]), "lockTest": ("bool", [True, False]), "unlockTest": ("bool", [True, False]), "reading": ("int", [-1, 0, 5, 12, 99]), "quoted": ("int", [-1, 0, 5, 12, 99])}
RULES = {
    "stuck-not-lock": "(=> (= door STUCK_LOCKED) (not lockTest))", "stuck-unlock": "(=> (= door STUCK_LOCKED) unlockTest)", "open-not-unlock": "(=> (= door WILL_NOT_LOCK) (not unlockTest))",
    "open-lock": "(=> (= door WILL_NOT_LOCK) lockTest)", "non-negative": "(>= reading 0)", "quote": "(= quoted reading)",
}
#: Cases: what events say of a door and a reading, and what is claimed of them. Premises and claims are missing for some.
EVENT_CASES = """SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'STUCK_LOCKED' WHEN 1 THEN 'WILL_NOT_LOCK' WHEN 2 THEN 'unknown' END AS door, CASE event_id % 5 WHEN 0 THEN 12 WHEN 1 THEN {k} WHEN 2 THEN CASE WHEN user_id % 6 = 5 THEN -1 END END AS reading,
  CASE WHEN event_id % 3 = 0 THEN 'true' END AS lock_test, CASE WHEN event_id % 7 < 4 THEN CASE WHEN event_id % 2 = 0 THEN 'TRUE' ELSE 'false' END END AS unlock_test, CASE event_id % 11 WHEN 0 THEN 12 WHEN 1 THEN {k} WHEN 2 THEN -3 WHEN 3 THEN 5 END AS quoted FROM events"""
CASES_SQL = "ec AS (" + EVENT_CASES.replace("{k}", "CAST(json_extract_string(props, '$.k') AS INTEGER)") + ")"
VERDICT_SQL = """said AS (SELECT *, CASE WHEN lock_test IS NOT NULL THEN CASE door WHEN 'STUCK_LOCKED' THEN 'invalid' WHEN 'WILL_NOT_LOCK' THEN 'valid' ELSE 'satisfiable' END END AS a,
  CASE WHEN quoted IS NOT NULL THEN CASE WHEN reading IS NOT NULL THEN CASE WHEN quoted = reading THEN 'valid' ELSE 'invalid' END WHEN quoted < 0 THEN 'invalid' ELSE 'satisfiable' END END AS b,
  CASE WHEN unlock_test IS NOT NULL THEN CASE WHEN door NOT IN ('STUCK_LOCKED', 'WILL_NOT_LOCK') OR door IS NULL THEN 'satisfiable' WHEN (door = 'STUCK_LOCKED') = (unlock_test = 'TRUE') THEN 'valid' ELSE 'invalid' END END AS c FROM ec),
verdicts AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 'no_translations' WHEN reading < 0 THEN 'impossible' ELSE list_min(list_filter([a, b, c], lambda x: x IS NOT NULL)) END AS outcome FROM said),
told AS (SELECT event_id, outcome, CASE outcome WHEN 'no_translations' THEN '' WHEN 'satisfiable' THEN '' WHEN 'impossible' THEN 'non-negative' ELSE array_to_string(list_filter([
  CASE WHEN a = outcome THEN CASE door WHEN 'STUCK_LOCKED' THEN 'stuck-not-lock' ELSE 'open-lock' END END, CASE WHEN b = outcome AND reading IS NULL THEN 'non-negative' END, CASE WHEN b = outcome THEN 'quote' END, CASE WHEN c = outcome THEN CASE door WHEN 'STUCK_LOCKED' THEN 'stuck-unlock' ELSE 'open-not-unlock' END END], lambda x: x IS NOT NULL), ',') END AS rules FROM verdicts)"""
POLICY = policy.Policy({n: (k, None if k == "int" else v) for n, (k, v) in DOMAINS.items()}, RULES)


def event_cases(spark, folder):
    """case_id, role, name and value of `EVENT_CASES`."""
    table(spark, folder, "events").createOrReplaceTempView("events_of_cases")
    held = spark.sql(EVENT_CASES.replace("{k}", "CAST(get_json_object(props, '$.k') AS INT)").replace("FROM events", "FROM events_of_cases"))
    named = [("premise", "door", "door"), ("premise", "reading", "reading"), ("claim", "lockTest", "lock_test"), ("claim", "quoted", "quoted"), ("claim", "unlockTest", "unlock_test")]
    each = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for r, n, c in named])
    return held.select(F.col("event_id").alias("case_id"), F.inline(each))


@plan("check_policy", sql("SELECT event_id AS case_id, outcome, rules, rules AS minimal FROM told", CASES_SQL, VERDICT_SQL))
def check_policy(spark, folder):
    found = policy.findings(event_cases(spark, folder), POLICY)
    return found.select("case_id", "outcome", F.array_join("rules", ",").alias("rules"), F.array_join("minimal", ",").alias("minimal"))


@plan("policy_bench", sql("SELECT outcome, count(*) AS n FROM verdicts GROUP BY 1", CASES_SQL, VERDICT_SQL))
def policy_bench(spark, folder):
    return check_policy(spark, folder).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@plan("undecided_claims", sql("SELECT door, reading, count(DISTINCT a) > 1 AS lock_open, count(DISTINCT b) > 1 AS unlock_open FROM (SELECT e.door, e.reading, a, b FROM (SELECT DISTINCT door, reading FROM ec WHERE door IS NOT NULL AND reading >= 0) e, (SELECT unnest([true, false]) AS a), (SELECT unnest([true, false]) AS b) WHERE NOT (e.door = 'STUCK_LOCKED' AND (a OR NOT b)) AND NOT (e.door = 'WILL_NOT_LOCK' AND (b OR NOT a))) GROUP BY 1, 2", CASES_SQL))
def undecided_claims(spark, folder):
    """For each door and reading that events tell: whether the tests are open then."""
    held = event_cases(spark, folder).where("role = 'premise' AND value IS NOT NULL").groupBy("case_id").pivot("name", ["door", "reading"]).agg(F.first("value")).where("door IS NOT NULL AND CAST(reading AS INT) >= 0")
    seen = held.select("door", "reading").distinct()

    def told(r):
        found = POLICY.undecided(["door", "reading"], f"(and (= door {r['door'] if r['door'] != 'unknown' else 'UNKNOWN'}) (= reading {r['reading']}))")
        return [{"door": r["door"], "reading": int(r["reading"]), "lock_open": "lockTest" in found, "unlock_open": "unlockTest" in found}]

    return map_rows(seen, told, "door string, reading int, lock_open boolean, unlock_open boolean")


VALUES = "CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '-' || p_size WHEN 2 THEN p_size || '.0' WHEN 3 THEN ' ' || p_size || ' ' WHEN 4 THEN 'true' WHEN 5 THEN p_size || '.5' ELSE '0' END"


@plan("coerce_index", rf"SELECT p_partkey, coalesce(CASE WHEN i > 0 THEN i END, -1) AS idx FROM (SELECT p_partkey, CASE WHEN regexp_full_match(trim(x), '[0-9]+(\.0+)?') THEN CAST(regexp_replace(trim(x), '\.0+$', '') AS INTEGER) END AS i FROM (SELECT p_partkey, {VALUES} AS x FROM part))")
def coerce_index(spark, folder):
    k, n = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    x = F.when(k == 0, n).when(k == 1, F.concat(F.lit("-"), n)).when(k == 2, F.concat(n, F.lit(".0"))).when(k == 3, F.concat(F.lit(" "), n, F.lit(" "))).when(k == 4, "true").when(k == 5, F.concat(n, F.lit(".5"))).otherwise("0")
    return table(spark, folder, "part").select("p_partkey", F.coalesce(parsing.positive_index(x), F.lit(-1)).alias("idx"))


JUDGED = "CASE event_id % 6 WHEN 0 THEN 'Sure: {\"verdict\": \"PASS\", \"reason\": \"r\"} end' WHEN 1 THEN '```json\n{\"verdict\": \"fail\"}\n```' WHEN 2 THEN '{\"passed\": true}' WHEN 3 THEN 'no json here' WHEN 4 THEN '{\"verdict\": \"abstain\"}' ELSE '{\"verdict\": \"maybe\"}' END"
VERDICTS = "CASE event_id % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'pass' WHEN 3 THEN 'invalid' WHEN 4 THEN 'abstain' ELSE 'invalid' END"


def judged(spark, folder):
    return table(spark, folder, "events").select("event_id", F.expr(JUDGED.replace("\n", "\\n")).alias("said"))


@plan("judge_parse", f"SELECT event_id, {VERDICTS} AS verdict FROM events")
def judge_parse(spark, folder):
    return judged(spark, folder).select("event_id", parsing.verdict(F.col("said")).alias("verdict"))


@plan("judge_combine", f"SELECT event_id, event_id % 5 <> 0 AND {VERDICTS} IN ('pass', 'abstain') AS passed FROM events")
def judge_combine(spark, folder):
    return judged(spark, folder).select("event_id", parsing.combined_verdict(F.col("event_id") % 5 != 0, parsing.verdict(F.col("said"))).alias("passed"))


@plan("parse_vector", "SELECT vec_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def parse_vector(spark, folder):
    text = F.to_json("embedding")
    return table(spark, folder, "embeddings").select("vec_id", parsing.vector(text).alias("v")).select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.get("v", F.lit(0)), 5).alias("first"))


@plan("scan_html_article", sql(r"""SELECT page_id, array_to_string(CASE WHEN len(lead) > 0 THEN lead ELSE [] END, ',') AS codes, CASE WHEN len(lead) > 0 THEN 'Error codes: ' || array_to_string(lead, ', ') || chr(10) || chr(10) || t ELSE t END AS text FROM (SELECT page_id, t, list_distinct(['F' || page_id % 10 || 'E1']) AS lead FROM (
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM pages))"""))
def scan_html_article(spark, folder):
    p = table(spark, folder, "pages").select("page_id", texts.html_to_text(F.col("html")).alias("t"), F.concat(F.lit("kb-f"), F.col("page_id") % 10, F.lit("e1-x")).alias("slug"))
    return article(p, "page_id", "slug", "t").select("page_id", F.array_join("codes", ",").alias("codes"), "text")


def article(pages, key: str, slug: str, text: str):
    """One article chunk a page: codes of the slug, then of the first 1,200 characters, else of all; named in a first line."""
    from_slug = F.transform(F.regexp_extract_all(F.col(slug), F.lit("(?i)(f[0-9]e[0-9])"), F.lit(1)), lambda x: F.upper(x))
    lead = F.array_distinct(F.concat(from_slug, codes.error_codes(F.substring(text, 1, 1200))))
    found = F.when(F.size(lead) > 0, lead).otherwise(codes.error_codes(F.col(text)))
    p = pages.select(key, F.col(text).alias("body"), found.alias("codes"))
    return p.select(key, "codes", F.when(F.size("codes") > 0, F.concat(F.lit("Error codes: "), F.array_join("codes", ", "), F.lit("\n\n"), "body")).otherwise(F.col("body")).alias("text"))


@plan("page_range_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE turn BETWEEN 1 AND 3 GROUP BY 1")
def page_range_text(spark, folder):
    """Turns 1 to 3 of every conversation, as pages of a document."""
    return corpus.page_range_text(table(spark, folder, "conversations"), "conv_id", "turn", "text", 1, 3)


@plan("outline_parts", "SELECT c_custkey, part, part * 20 + 1 AS first, least((part + 1) * 20, 30 + c_custkey % 70) AS last FROM (SELECT c_custkey, unnest(generate_series(0, (30 + c_custkey % 70 - 1) // 20)) AS part FROM customer)")
def outline_parts(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.inline(corpus.parts(30 + F.col("c_custkey") % 70, 20)))




@plan("is_correcting_doc", sql("SELECT m.doc_id, coalesce(bool_or(e.type IN ('corrects', 'supersedes', 'overrides')), false) OR m.tier = 'technical_service_pointer' OR m.doc_type = 'technical_service_pointer' AS correcting, coalesce(bool_or(e.type = 'superseded_by'), false) AS superseded FROM manuals m LEFT JOIN edges e USING (doc_id) GROUP BY m.doc_id, m.tier, m.doc_type", MANUALS_SQL, EDGES_SQL))
def is_correcting_doc(spark, folder):
    return corpus.kinds(manuals(spark), edges(spark))


@plan("attach_layout", sql("SELECT query_id, c.chunk_id, coalesce(h.hit, 0) AS hit FROM (SELECT query_id, 'c' || lpad(CAST(query_id * 11 AS VARCHAR), 8, '0') AS chunk_id FROM asks) c LEFT JOIN (SELECT chunk_id, 1 AS hit FROM chunks WHERE page > 3) h USING (chunk_id)", ASKS_SQL, CHUNKS_SQL))
def attach_layout(spark, folder):
    hits = asks(spark).select("query_id", F.concat(F.lit("c"), F.lpad((F.col("query_id") * 11).cast("string"), 8, "0")).alias("chunk_id"))
    layouts = chunks(spark, folder).where("page > 3").select("chunk_id", F.lit(1).alias("hit"))
    return evidence.with_layout(hits, layouts).select("query_id", "chunk_id", F.coalesce("hit", F.lit(0)).alias("hit"))


@plan("sibling_fetch", sql("SELECT a.chunk_no, b.chunk_no AS sibling FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND a.chunk_no // 100 = b.chunk_no // 100 WHERE a.kind = 'table_row' AND b.kind = 'table_row'", CHUNKS_SQL))
def sibling_fetch(spark, folder):
    from ..operators import arms

    c = chunks(spark, folder).withColumn("problem_title", F.lit("p")).withColumn("page", F.floor(F.col("chunk_no") / 100))
    hits = c.where("kind = 'table_row'").select(F.col("chunk_no").alias("query_id"), "doc_id", "page", "problem_title")
    return arms.sibling_fetch(hits, c).select(F.col("query_id").alias("chunk_no"), F.col("chunk_no").alias("sibling"))
