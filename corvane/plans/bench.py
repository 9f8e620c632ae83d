"""Plans of unit indexes and their grades, bake-offs, traces, intake, policy release and whole searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import arms, corpus, intake, release, search, traces, unitbench
from ..operators.rows import settled
from ..sources.writers import shared_folder
from . import retrieval
from .base import CHUNKS_SQL, EDGES_SQL, MANUALS_SQL, chunks, edges, manuals, models, ranges, sql, values_sql, vectors
from .curation import outputs
from .inputs import UNITS_SQL, units
from .registry import plan, table


def _length_vector(text):
    """A stand-in for an embedder: a vector of a text's length and words."""
    return F.array(F.char_length(text).cast("double"), F.size(F.split(text, " ")).cast("double"))


@plan("window_text")
def window_text(spark, folder):
    return unitbench.windows(units(spark, folder), ["version", "unit_key"], budget=64).select("unit_key", "window", "text", "tokens")


@plan("unit_window_index")
def unit_window_index(spark, folder):
    index, stats = unitbench.window_index(units(spark, folder), ["unit_key"], _length_vector, budget=64)
    return stats.select("records", "embed_tokens", "units", "over_budget_units")


@plan("unit_truncate_index", sql("SELECT count(*) FILTER (trim(source_text) <> '') AS records, count(*) AS units FROM units", UNITS_SQL))
def unit_truncate_index(spark, folder):
    _, stats = unitbench.truncate_index(units(spark, folder), ["unit_key"], _length_vector, budget=64)
    return stats.select("records", "units")


@plan("token_budget")
def token_budget(spark, folder):
    x = F.col("text")
    return table(spark, folder, "documents").select("doc_id", tokens.estimate(x).alias("tokens"), tokens.fits(x, 128).alias("fits"))


def _queries(spark, folder):
    """Every vector whose id is divisible by 20."""
    return vectors(spark, folder).where("chunk_no % 20 = 0").select(F.col("chunk_no").alias("query_id"), F.col("embedding").alias("vector"))


@plan("dense_numpy_fetch", sql(f"""SELECT query_id, chunk_no, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_no, row_number() OVER (PARTITION BY q.vec_id ORDER BY {retrieval._cos('q.embedding', 'e.embedding')} DESC, e.vec_id) AS rank FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 8"""))
def dense_numpy_fetch(spark, folder):
    v = vectors(spark, folder).withColumns({"doc_id": F.lit("D"), "text": F.lit("")})
    return arms.vector_fetch(_queries(spark, folder), v, 8).select("query_id", "chunk_no", F.col("arm_rank").cast("long").alias("rank"))


DOT = "list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@plan("unit_vector_search", f"SELECT query_id, unit, round(score, 6) AS score FROM (SELECT query_id, unit, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit) AS place FROM (SELECT q.vec_id AS query_id, e.vec_id % 50 AS unit, max({DOT}) AS score FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)) WHERE place <= 5")
def unit_vector_search(spark, folder):
    records = vectors(spark, folder).select(F.col("chunk_no").alias("record_id"), (F.col("chunk_no") % 50).alias("unit_key"), F.col("embedding").alias("vector"))
    return unitbench.best_units(_queries(spark, folder), records, 5).select("query_id", F.col("unit_key").alias("unit"), F.round("score", 6).alias("score"))


@plan("unit_grade", sql("SELECT o_orderkey AS fixture_id, coalesce(max(CASE WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN 1 ELSE 0 END), 0) = 1 AS passed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"))
def unit_grade(spark, folder):
    """Orders as fixtures that want their first line, of a publication named by its flag, among their lines."""
    none = F.array().cast("array<string>")
    f = table(spark, folder, "orders").select(F.col("o_orderkey").alias("fixture_id"), F.array(F.lit("u1")).alias("must"), none.alias("must_any"), F.array(F.lit("N")).alias("must_pub"))
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    ranked = table(spark, folder, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("fixture_id"), line.alias("place"), F.concat(F.lit("u"), "l_linenumber").alias("unit_key"), F.col("l_returnflag").alias("publication_number"))
    return unitbench.unit_grades(f, ranked).select("fixture_id", "passed")


@plan("unit_cost")
def unit_cost(spark, folder):
    r = units(spark, folder).select("version", tokens.estimate(F.col("title")).alias("tokens"))
    return unitbench.curator_cost(units(spark, folder), r, ["version"]).select("version", "prompt_tokens", "completion_tokens", "dollars")


@plan("scale_notices", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 1 THEN 1 ELSE 0 END + CASE WHEN s_suppkey > 50 THEN 1 ELSE 0 END AS notices FROM supplier")
def scale_notices(spark, folder):
    n = corpus.scale_notices((F.col("s_suppkey") % 4).cast("string").cast("int"), F.col("s_suppkey"))
    return table(spark, folder, "supplier").select("s_suppkey", F.size(n).cast("long").alias("notices"))


@plan("audience_record", "SELECT event_id, event_type AS audience, false AS verified, event_type = 'technician' OR (event_id % 4 = 0 AND event_id % 3 = 0) AS attested FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'tech' ELSE 'own' END ELSE event_type END AS event_type FROM events)")
def audience_record(spark, folder):
    n = F.col("event_id")
    who = F.when(n % 4 == 0, F.when(n % 3 == 0, "tech").otherwise("own")).otherwise(F.col("event_type"))
    r = corpus.audience_record(F.when(who == "tech", "technician").otherwise(who), F.lit(True))
    return table(spark, folder, "events").select("event_id", who.alias("audience"), r["audience_verified"].alias("verified"), r["technician_attested"].alias("attested"))


MADE_SQL = "made AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'doc-' ELSE 'synth-' END || s_suppkey AS doc_id, CASE WHEN s_suppkey % 4 = 0 THEN 'W' ELSE 'SYNTH-' END || s_suppkey AS publication_number, CASE WHEN s_suppkey % 5 = 0 THEN 'manual' ELSE 'synthetic_eval' END AS role FROM supplier)"


@plan("synthetic_ingest", sql("SELECT doc_id, CASE WHEN s_suppkey % 3 = 0 THEN 'doc_id must be synthetic' WHEN s_suppkey % 4 = 0 THEN 'publication must be synthetic' ELSE 'role must be synthetic_eval' END AS reason FROM made WHERE s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 OR s_suppkey % 5 = 0", MADE_SQL))
def synthetic_ingest(spark, folder):
    n = F.col("s_suppkey")
    made = table(spark, folder, "supplier").select(
        F.concat(F.when(n % 3 == 0, "doc-").otherwise("synth-"), n).alias("doc_id"), F.concat(F.when(n % 4 == 0, "W").otherwise("SYNTH-"), n).alias("publication_number"), F.when(n % 5 == 0, "manual").otherwise("synthetic_eval").alias("role"),
    )
    return corpus.with_synthetic(made.limit(0), made)[1]


# Bake-offs


def _corpus(spark, folder):
    return search.Corpus(chunks(spark, folder), vectors(spark, folder), manuals(spark), edges(spark), models(spark), ranges(spark))


def _asked(spark, folder):
    v = vectors(spark, folder)
    q = retrieval.queries(spark).drop("codes", "connectors", "revision", "led", "bibliographic", "installation")
    q = q.join(v.withColumnRenamed("embedding", "vector"), F.col("chunk_no") == F.col("query_id") * 3, "left").drop("chunk_no")
    return settled(search.understood(q, retrieval.BIBLIOGRAPHIC, retrieval.INSTALLATION))


R = retrieval
#: The whole search: all arms' hits as `merged`, then what `BOOST_SQL` makes of them, restricted, diversified and restricted again.
POOL_SQL = rf"""wants AS (SELECT *, regexp_matches(ask, {R._r(R.BIBLIOGRAPHIC)}) AS bib0, nullif(upper(regexp_extract(ask, '(?i)\brevision\s+([A-Z])\b', 1)), '') AS rev0, regexp_matches(ask, {R._r(R.intent.LED)}) AS led0, regexp_matches(ask, {R._r(R.INSTALLATION)}) AS ins0 FROM asked),
revised AS (SELECT q.query_id, {', '.join('c.' + x for x in R.COLS.split(', ')[1:])}, 0.88 AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN regexp_matches(text, '(?i)status LED') THEN 0 WHEN page = 44 THEN 1 WHEN regexp_matches(text, '(?i)TEST #1.*ACU Power Check') THEN 2 ELSE 4 END, page, chunk_id) AS arm_rank
  FROM wants q JOIN chunks c ON upper(c.revision) = q.rev0 JOIN manuals m ON m.publication_number = c.publication_number AND m.doc_type = 'service_manual' JOIN applies a ON a.query_id = q.query_id AND a.doc_id = m.doc_id AND a.reason IN {R.GOOD} WHERE bib0 QUALIFY arm_rank <= CASE WHEN led0 THEN 8 ELSE 12 END),
rest AS (SELECT query_id FROM wants WHERE NOT (bib0 AND rev0 IS NOT NULL AND led0 AND query_id IN (SELECT query_id FROM revised))),
wires AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY o, r) AS arm_rank FROM once QUALIFY arm_rank <= 20),
refs AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN coalesce(language, 'en') = 'en' THEN 0 ELSE 1 END, CASE WHEN regexp_matches(text, '(?i)shipping|transport bolt|spacer') THEN 0 WHEN ins0 AND regexp_matches(text, '(?i)shipping|bolt|level|install') THEN 1 ELSE 2 END, page, chunk_id) AS arm_rank
  FROM (SELECT DISTINCT v.query_id, e.target FROM code v JOIN edges e USING (doc_id) WHERE e.type = 'references') t JOIN chunks c ON c.publication_number = t.target JOIN wants USING (query_id) QUALIFY arm_rank <= 3),
listed AS (SELECT *, 0 AS arm_ord FROM revised UNION ALL SELECT {R.COLS}, score, arm_rank, 1 FROM code WHERE query_id IN (FROM rest) UNION ALL SELECT {R.COLS}, score, arm_rank, 2 FROM wires JOIN chunks USING (chunk_id) WHERE query_id IN (FROM rest)
  UNION ALL SELECT {R.COLS}, 0.85, arm_rank, 3 FROM refs JOIN chunks USING (chunk_id) WHERE query_id IN (FROM rest) UNION ALL SELECT {R.COLS}, score, arm_rank, 4 FROM vec WHERE query_id IN (FROM rest)),
uniq AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, chunk_id ORDER BY arm_ord, arm_rank) = 1),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY arm_ord, arm_rank) AS merge_ord FROM uniq),
fits AS (SELECT o.*, coalesce(w.bib0 AND d.doc_type = 'service_manual' AND upper(o.revision) = w.rev0, false) AS g FROM ordered o JOIN wants w USING (query_id) LEFT JOIN manuals d USING (doc_id)),
merged AS (SELECT * EXCLUDE (g) FROM fits QUALIFY g OR NOT bool_or(g) OVER (PARTITION BY query_id))"""
SEARCH_SQL = f"""named_ AS (SELECT *, round(final_score, 9) AS f FROM applied QUALIFY coalesce(list_contains(named, upper(pub)), false) OR NOT bool_or(coalesce(list_contains(named, upper(pub)), false)) OVER (PARTITION BY query_id)),
counted AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY f DESC, merge_ord) AS k, min(doc_id) OVER (PARTITION BY query_id) = max(doc_id) OVER (PARTITION BY query_id) AS alone FROM named_),
owned AS (SELECT c.*, coalesce(own_audience AND NOT {R.NEEDED_SQL} AND doc_type IN {R.OWNERS_SQL}, false) AS g FROM counted c JOIN asks USING (query_id) WHERE alone OR k <= 2),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, merge_ord) AS rank FROM (SELECT * FROM owned QUALIFY g OR NOT bool_or(g) OVER (PARTITION BY query_id)) QUALIFY rank <= 8)"""


@plan("strategy_run", sql("SELECT query_id, chunk_id, doc_id, rank, round(CAST(f AS DOUBLE), 6) AS final_score FROM found", *R.BASE, *R.APPLIES, EDGES_SQL, R.CONNECTOR_SQL, POOL_SQL, R.BOOST_SQL, SEARCH_SQL))
def strategy_run(spark, folder):
    hits = search.production(_asked(spark, folder), _corpus(spark, folder), 8, retrieval.POOL)
    return hits.select("query_id", "chunk_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("final_score", 6).alias("final_score"))


@plan("ab_strategy")
def ab_strategy(spark, folder):
    """Three of the strategies over the same queries."""
    q, c, out = _asked(spark, folder), _corpus(spark, folder), None
    for name in ("vector_raw", "vector_apply", "vector_apply_boost"):
        one = search.STRATEGIES[name](q, c, 8, retrieval.POOL).select(F.lit(name).alias("strategy"), "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


@plan("run_bakeoff")
def run_bakeoff(spark, folder):
    q, c = _asked(spark, folder), _corpus(spark, folder)

    def hits(name):
        found = search.STRATEGIES[name](q, c, 8, retrieval.POOL)
        return found.select("query_id", "rank", F.array(F.lower("doc_id"), F.lower("publication_number")).alias("keys"))

    t = q.select("query_id", F.lit(0).alias("target"), F.concat(F.lit("d00"), F.lpad((F.col("query_id") % 20).cast("string"), 2, "0")).alias("label"))
    bad = q.where("query_id % 2 = 0").select("query_id", F.lit("d0001").alias("label"))
    b = unitbench.bakeoff(spark, {n: (lambda n=n: hits(n)) for n in ("vector_raw", "vector_apply")}, t, bad, 8)
    return b.select("strategy", "query_id", "passed", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


# Traces

#: What traces record, by number: question, answer, whether there are citations, abstained, and the failures that it shows.
SAID = [
    ("How do I enter diagnostic mode?", 'Turn the cycle selector to "Off", then start service diagnostic mode.', 1, False, "invented_diag_entry"),
    ("My washer door lock is odd", "ABSTAIN: is there an error code?", 0, True, "clarify_as_abstain"),
    ("The door won't unlock", "Ensure that door is completely closed.", 1, False, "wrong_polarity"),
    ("Washer is dripping", "Please follow these steps to dry it.", 0, False, "empty_cites_procedure"),
    ("It makes noise", "Your display shows F5 E2 so replace it.", 1, False, "plan_code_as_fact"),
    ("How much does it weigh?", "It weighs 100 kg [1].", 1, False, ""),
]
SAID_SQL = values_sql("said", "n, question, answer, cites, abstained, code", [(i, *r) for i, r in enumerate(SAID)])


def _traces(spark, folder):
    e = table(spark, folder, "events").select("event_id", (F.col("event_id") % len(SAID)).cast("int").alias("n"))
    pick = lambda j: F.element_at(F.array(*[F.lit(r[j]) for r in SAID]), F.col("n") + 1)
    asked = F.concat(pick(0), F.lit(" "), F.col("event_id") % 40)
    return e.select(
        F.concat(F.lit("t"), "event_id").alias("trace_id"), F.col("event_id").alias("ord"), "n", asked.alias("question"), pick(1).alias("answer"),
        F.when(pick(2) == 1, F.array(F.lit("D1"))).otherwise(F.array().cast("array<string>")).alias("citations"), pick(3).alias("abstained"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("sha"), F.col("event_id") % 2)).alias("git_sha"),
    )


@plan("mine_classify", sql(f"SELECT 't' || event_id AS trace_id, code FROM (SELECT event_id, event_id % {len(SAID)} AS n FROM events) JOIN said USING (n)", SAID_SQL))
def mine_classify(spark, folder):
    found = traces.failure_codes(F.col("question"), F.col("answer"), F.col("citations"), F.col("abstained"))
    return _traces(spark, folder).select("trace_id", F.array_join(found, ",").alias("code"))


@plan("failure_rules")
def failure_rules(spark, folder):
    t = _traces(spark, folder)
    code = F.get(traces.failure_codes(F.col("question"), F.col("answer"), F.col("citations"), F.col("abstained")), F.lit(0))
    return t.select("trace_id", F.to_json(traces.rules_for(code, F.col("question"))).alias("rules"))


@plan("filter_traces", "SELECT 't' || event_id AS trace_id FROM events WHERE event_id % 3 > 0 AND event_id % 2 = 1")
def filter_traces(spark, folder):
    return traces.stamped(_traces(spark, folder), "sha1").select("trace_id")


@plan("covered_questions", r"SELECT DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS question FROM benchmark WHERE item_id % 4 <> 0")
def covered_questions(spark, folder):
    n = F.col("item_id")
    b = table(spark, folder, "benchmark").select(F.when(n % 4 == 0, "draft").otherwise("ready").alias("status"), F.col("text").alias("question"), F.lit(None).cast("array<string>").alias("turns"))
    return traces.covered_questions(b)


def _mined(spark, folder):
    held = spark.createDataFrame([("washer is dripping 3",), ("it makes noise 4",)], "question string")
    return traces.mined(_traces(spark, folder), held)


@plan("mine_run", sql(f"""SELECT 't' || event_id AS trace_id, CASE WHEN code = '' THEN 'skipped' WHEN r > 1 THEN 'skipped' WHEN q IN ('washer is dripping 3', 'it makes noise 4') THEN 'covered' ELSE 'actionable' END AS outcome
  FROM (SELECT *, row_number() OVER (PARTITION BY code, q ORDER BY event_id) AS r FROM (SELECT event_id, code, lower(question) || ' ' || event_id % 40 AS q FROM (SELECT event_id, event_id % {len(SAID)} AS n FROM events) JOIN said USING (n)))""", SAID_SQL))
def mine_run(spark, folder):
    return _mined(spark, folder).select("trace_id", "outcome")


@plan("mine_report")
def mine_report(spark, folder):
    return traces.report(_mined(spark, folder)).select("place.s", "place.o", "line")


@plan("truncate_trace", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN length(text) ELSE 100 + length('... [' || length(text) || ' chars total]') END AS size FROM documents")
def truncate_trace(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.to_json(F.struct("text")).alias("value"))
    cut = traces.truncate_json(d, ["doc_id"], most=120)
    return cut.select("doc_id", F.char_length(F.get_json_object("value", "$.text")).cast("long").alias("size"))


@plan("trace_normalise", sql("SELECT 't' || event_id AS trace_id, event_id % 2 = 0 AS asked FROM events"))
def trace_normalise(spark, folder):
    n = F.col("event_id")
    value = F.to_json(F.struct(F.concat(F.lit("t"), n).alias("id"), F.lit("ask").alias("name"), F.col("ts").cast("string").alias("timestamp"), F.when(n % 2 == 0, F.struct(F.lit("why").alias("question"))).alias("input"), F.lit("because").alias("output")))
    t = traces.normalised(table(spark, folder, "events").select(value.alias("value")), "value")
    return t.select("trace_id", (F.coalesce("question", F.lit("")) != "").alias("asked"))


# Intake


def _downloads(spark, folder):
    """A downloaded file for each document: named with a publication, with one in its text, or a saved page."""
    n = F.col("doc_id")
    number = F.concat(F.lit("W1"), F.lpad((n % 20).cast("string"), 7, "0"))
    name = F.when(n % 4 == 0, F.concat(number, F.lit("-rev-b.pdf"))).when(n % 4 == 1, F.concat(F.lit("scan-"), n, F.lit(".pdf"))).when(n % 4 == 2, F.concat(number, F.lit("A_manual.pdf"))).otherwise(F.concat(F.lit("page-"), n, F.lit(".html")))
    sample = F.when(n % 4 == 1, F.concat(F.lit("Part "), number, F.lit(" and text "), "text")).otherwise(F.col("text"))
    page = F.concat(F.lit("Content-Location: https://help.example.org/a/topic-"), F.lpad((n % 20).cast("string"), 2, "0"), F.lit("/\r\n"), "text")
    return table(spark, folder, "documents").select(F.concat_ws("/", F.lit("in"), n, name).alias("file"), "doc_id", sample.alias("sample"), F.when(n % 4 == 3, page).alias("content"))


def _manifest(spark, folder):
    m, i = manuals(spark), F.substring("doc_id", 2, 4).cast("int")
    return m.select("doc_id", "publication_number", F.when(i % 3 == 0, "A").when(i % 3 == 1, "B").alias("revision"), F.col("publication_number").alias("citation"), (F.col("doc_type") != "knowledge_article").alias("is_pdf"),
                    F.concat(F.lit("https://help.example.org/a/topic-"), F.lpad(i.cast("string"), 2, "0")).alias("source_url"), F.concat(F.lit("Topic number "), i, F.lit(" (washers)")).alias("title"))


@plan("intake_signals", "SELECT doc_id, doc_id % 4 = 3 AS archive, CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'W1' || lpad(CAST(doc_id % 20 AS VARCHAR), 7, '0') END AS numbers, CASE doc_id % 4 WHEN 0 THEN 'B' WHEN 2 THEN 'A' ELSE '' END AS revision FROM documents")
def intake_signals(spark, folder):
    s = intake.signals(_downloads(spark, folder))
    return s.select("doc_id", "archive", F.array_join("numbers", ",").alias("numbers"), F.coalesce("revision", F.lit("")).alias("revision"))


@plan("web_archive_match", sql("SELECT d.doc_id, coalesce(m.doc_id, '-') AS found FROM documents d LEFT JOIN manuals m ON m.doc_id = 'D' || lpad(CAST(d.doc_id % 20 AS VARCHAR), 4, '0') AND m.doc_type = 'knowledge_article' WHERE d.doc_id % 4 = 3", MANUALS_SQL))
def web_archive_match(spark, folder):
    s = intake.signals(_downloads(spark, folder)).where("archive")
    m = intake.archive_matches(s, _manifest(spark, folder).where("not is_pdf"))
    return m.join(s.select("file", F.col("doc_id").alias("n")), "file").select(F.col("n").alias("doc_id"), F.coalesce(m["doc_id"], F.lit("-")).alias("found"))


@plan("by_citation", sql("SELECT d.doc_id AS n, e.doc_id FROM documents d JOIN (SELECT DISTINCT doc_id, target FROM edges WHERE type IN ('corrects', 'supersedes', 'references')) e ON e.target = 'W1' || lpad(CAST(d.doc_id % 20 AS VARCHAR), 7, '0') JOIN manuals m ON m.publication_number = e.target", MANUALS_SQL, EDGES_SQL))
def by_citation(spark, folder):
    """Files that name two publications, of which one refers to the other."""
    d = table(spark, folder, "documents").select(F.col("doc_id").alias("file"), F.concat(F.lit("W1"), F.lpad((F.col("doc_id") % 20).cast("string"), 7, "0")).alias("publication_number"))
    aims = edges(spark).where(F.col("type").isin(*intake.OUTBOUND)).select(F.col("target").alias("publication_number"), F.col("doc_id").alias("by")).distinct()
    two = d.join(aims, "publication_number")
    m = manuals(spark).select("doc_id", "publication_number")
    cited = two.select("file", "publication_number").join(m, "publication_number").select("file", "doc_id", "publication_number")
    citing = two.select("file", F.col("by").alias("doc_id")).join(m, "doc_id").select("file", "doc_id", "publication_number")
    return intake.by_citation(cited.unionByName(citing).distinct(), edges(spark)).select(F.col("file").alias("n"), "doc_id")


@plan("intake_plan")
def intake_plan(spark, folder):
    d = _downloads(spark, folder)
    return intake.plan(d.select("file", "sample", "content"), _manifest(spark, folder), edges(spark))


# Policy release

VARIABLES = [
    {"name": "door_open", "role": "fact", "type": "bool"}, {"name": "code", "role": "fact", "type": "enum", "values": ["none", "f5e2", "unknown"]},
    {"name": "advises_bypass", "role": "claim", "type": "bool", "requires": "door_open"}, {"name": "says_safe", "role": "claim", "type": "bool"},
]
#: Payloads of translators, by number, and what is read: premises, claims, reason.
PAYLOADS = [
    ('{"premises": [{"name": "door_open", "value": "yes"}], "claims": [{"name": "advises_bypass", "value": "true", "text": "bypass it"}], "untranslated": [], "ambiguous": []}', None),
    ('```json\n{"premises": [], "claims": [{"name": "advises_bypass", "value": "true", "text": "bypass it [2]"}]}\n```', None), ('{"premises": [], "ambiguous": true}', None), ("[]", None),
    ('{"premises": [{"name": "code", "value": "f9"}], "claims": []}', None), ('{"premises": [{"name": "colour", "value": "red"}]}', None), ('{"premises": [], "claims": [{"name": "says_safe", "value": "false", "text": "it is safe"}], "ambiguous": ["advises_bypass", "code"]}', None),
]


def _formal(spark, folder):
    return release.formalizations(outputs(spark, folder, PAYLOADS), ["event_id"], VARIABLES)


def _line(c):
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


@plan("formalization_parse")
def formalization_parse(spark, folder):
    return _formal(spark, folder).select("event_id", "ambiguous", "reason", F.array_join("untranslated", "|").alias("untranslated"))


@plan("read_assignments")
def read_assignments(spark, folder):
    return _formal(spark, folder).select("event_id", _line(F.col("premises")).alias("premises"), _line(F.col("claims")).alias("claims"))


@plan("agree", sql(f"SELECT user_id, CASE WHEN n = 0 THEN false ELSE true END AS ambiguous FROM (SELECT user_id, count(*) FILTER (event_id % {len(PAYLOADS)} > 1 OR k <> f) AS n FROM (SELECT user_id, event_id, event_id % {len(PAYLOADS)} AS k, first_value(event_id % {len(PAYLOADS)}) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events) GROUP BY 1)"))
def agree(spark, folder):
    e = table(spark, folder, "events").select("event_id", "user_id")
    f = _formal(spark, folder).join(e, "event_id")
    return release.agreed(f, ["user_id"], "event_id").select("user_id", "ambiguous")


ASKS = {"door_open": "Is the door open?", "code": "Which code is shown?"}
UNKNOWN = {"code": "unknown"}
OUTCOMES = ("valid", "satisfiable", "invalid", "impossible", "too_complex", "no_translations")


def _cases(spark, folder):
    n = F.col("event_id")
    e = table(spark, folder, "events")
    outcome = F.element_at(F.array(*map(F.lit, OUTCOMES)), (n % 6 + 1).cast("int"))
    model = F.create_map(F.lit("door_open"), F.when(n % 2 == 0, "true").otherwise("false"), F.lit("code"), F.lit("none"))
    return e.select(
        "event_id", F.concat(F.lit("Answer "), n).alias("answer"), (n % 11 == 0).alias("ambiguous"), F.when(n % 22 == 0, "model_ambiguous:code").otherwise("translators_disagreed").alias("reason"), outcome.alias("outcome"),
        F.array(F.lit("R1")).alias("rule_ids"), F.when(n % 5 == 0, F.create_map(F.lit("code"), F.lit("unknown"))).otherwise(F.create_map().cast("map<string,string>")).alias("premises"), model.alias("model"),
        F.create_map(F.lit("door_open"), F.lit("true"), F.lit("code"), F.lit("none")).alias("counterexample"), F.when(n % 7 == 0, F.array(F.lit("Unplug it [2]"))).otherwise(F.array().cast("array<string>")).alias("untranslated"),
        F.when(n % 3 == 2, "Second draft").alias("rewritten"), F.when(n % 4 == 0, "valid").when(n % 4 == 1, "impossible").otherwise("invalid").alias("second_outcome"), F.array(F.lit("R2")).alias("second_rule_ids"), F.lit(False).alias("second_abstained"),
    )


@plan("policy_release", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'ask' WHEN event_id % 6 IN (0, 5) THEN 'release' WHEN event_id % 6 = 1 THEN 'ask' WHEN event_id % 6 = 2 AND event_id % 3 = 2 AND event_id % 4 = 0 THEN 'rewrite' ELSE 'withhold' END AS action FROM events")
def policy_release(spark, folder):
    return release.released(_cases(spark, folder), ASKS, UNKNOWN).select("event_id", "action")


@plan("clarify_choice", f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{release.ONE_MORE} {ASKS['code']}' WHEN event_id % 2 = 1 THEN '{release.ONE_MORE} {ASKS['door_open']}' ELSE '{release.ONE_MORE}' END AS said FROM events")
def clarify_choice(spark, folder):
    c = F.col
    return _cases(spark, folder).select("event_id", release.choice(c("premises"), c("model"), c("counterexample"), UNKNOWN, ASKS).alias("said"))


@plan("ab_index_build", sql("SELECT chunk_no, length(text) AS size FROM chunks", CHUNKS_SQL))
def ab_index_build(spark, folder):
    """Vectors of another embedder, written once under the corpus's fingerprint; the second build finds them."""
    c = chunks(spark, folder)
    fingerprint = unitbench.corpus_fingerprint(c).first()[0]
    where = f"{shared_folder(spark)}/index"
    unitbench.alternative_index(c, _length_vector, where, fingerprint)
    index, held = unitbench.alternative_index(c, _length_vector, where, fingerprint)
    return index.where(F.lit(held)).select("chunk_no", F.col("embedding")[0].cast("long").alias("size"))
