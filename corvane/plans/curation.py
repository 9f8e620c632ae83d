"""Plans of versions, their units under review, representations and the trail of proposals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import curation, review
from .base import sql, values_sql
from .inputs import HISTORY_SQL, UNITS_SQL, history, history_docs, reps, units
from .registry import plan, table

#: A version's state after a step, by the shape of its document's history and the version.
SHAPE = "(['A', 'B', 'C', 'D', 'E', 'F', 'G'])[CAST(s_suppkey % 7 + 1 AS INTEGER)]"


def _status(v):
    return v.select("doc_id", F.col("version").cast("long").alias("version"), "status")


def _wanted(spark, folder, *statuses):
    return history(spark, folder).where(F.col("status").isin(*statuses)).select("doc_id", "version")


@plan("ensure_structured_active", sql(f"SELECT 'S' || s_suppkey AS doc_id, CASE {SHAPE} WHEN 'B' THEN 'reuse 1' WHEN 'C' THEN 'reactivate 1' WHEN 'D' THEN 'create 2' WHEN 'E' THEN 'reuse 1' WHEN 'G' THEN 'create 1' ELSE 'refuse' END AS done FROM supplier"))
def ensure_structured_active(spark, folder):
    _, done = curation.structured_active(history(spark, folder), history_docs(spark, folder))
    return done.select("doc_id", F.concat_ws(" ", "action", "version").alias("done"))


@plan("create_version", sql("SELECT doc_id, CAST(version AS BIGINT) AS version, status FROM history UNION ALL SELECT 'S' || s_suppkey, coalesce(n, 0) + 1, 'candidate' FROM supplier LEFT JOIN (SELECT doc_id, max(version) AS n FROM history GROUP BY 1) ON doc_id = 'S' || s_suppkey", HISTORY_SQL))
def create_version(spark, folder):
    docs = history_docs(spark, folder).withColumn("forked_from", F.lit(None).cast("int"))
    return _status(curation.created(history(spark, folder), docs, curation.SEMANTIC, curation.CANDIDATE))


@plan("create_candidate", sql(f"SELECT 'S' || s_suppkey AS doc_id, CASE WHEN {SHAPE} IN ('B', 'D', 'E') THEN 'refused' WHEN s_suppkey % 5 = 0 THEN 'rejected' ELSE 'proposed' END AS outcome FROM supplier"))
def create_candidate(spark, folder):
    bad = table(spark, folder, "supplier").where("s_suppkey % 5 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("doc_id"), F.lit("overlap").alias("code"))
    return curation.proposed(history(spark, folder), history_docs(spark, folder), bad)[1].select("doc_id", "outcome")


@plan("propose_semantic_version", sql(f"SELECT 'S' || s_suppkey AS doc_id, CASE {SHAPE} WHEN 'A' THEN 3 WHEN 'C' THEN 3 WHEN 'F' THEN 4 WHEN 'G' THEN 1 ELSE 0 END AS version, CASE {SHAPE} WHEN 'B' THEN 'version 2 is already an open candidate' WHEN 'D' THEN 'version 1 is already an open candidate' WHEN 'E' THEN 'version 2 is already an open candidate' ELSE '' END AS detail FROM supplier"))
def propose_semantic_version(spark, folder):
    none = history_docs(spark, folder).where("doc_id is null").select("doc_id", F.lit("x").alias("code"))
    done = curation.proposed(history(spark, folder), history_docs(spark, folder), none)[1]
    return done.select("doc_id", F.coalesce("version", F.lit(0)).alias("version"), "detail")


def _move(name, status):
    body = f"SELECT doc_id, CAST(version AS BIGINT) AS version, CASE WHEN status IN ('candidate', 'ready', 'superseded') THEN '{status}' ELSE status END AS status FROM history"

    @plan(name, sql(body, HISTORY_SQL))
    def build(spark, folder):
        return _status(curation.moved(history(spark, folder), _wanted(spark, folder, "candidate", "ready", "superseded", "active"), status)[0])


_move("set_status", curation.CANDIDATE)
_move("mark_ready", curation.READY)
_move("abandon", curation.ABANDONED)


@plan("activate", sql("SELECT doc_id, CAST(version AS BIGINT) AS version, CASE WHEN status = 'ready' THEN 'active' WHEN status = 'active' AND doc_id IN (SELECT doc_id FROM history WHERE status = 'ready') THEN 'superseded' ELSE status END AS status FROM history", HISTORY_SQL))
def activate(spark, folder):
    return _status(curation.activated(history(spark, folder), _wanted(spark, folder, "ready", "candidate"))[0])


@plan("revert_to", sql("SELECT h.doc_id, CAST(h.version AS BIGINT) AS version, CASE WHEN h.version = t AND status = 'superseded' THEN 'active' WHEN status = 'active' AND t IS NOT NULL THEN 'superseded' ELSE status END AS status FROM history h LEFT JOIN (SELECT doc_id, max(version) AS t FROM history WHERE status = 'superseded' GROUP BY 1) w USING (doc_id)", HISTORY_SQL))
def revert_to(spark, folder):
    return _status(curation.reverted(history(spark, folder), _wanted(spark, folder, "superseded"))[0])


@plan("version_summary", sql("SELECT doc_id, count(*) AS n, coalesce(max(CASE WHEN status = 'active' THEN version END), -1) AS active, coalesce(max(CASE WHEN strategy = 'semantic_llm' THEN version END), -1) AS latest_semantic FROM history GROUP BY 1", HISTORY_SQL))
def version_summary(spark, folder):
    s = curation.summary(history(spark, folder))
    return s.select("doc_id", F.size("history").cast("long").alias("n"), F.coalesce("active", F.lit(-1)).alias("active"), F.coalesce("latest_semantic", F.lit(-1)).alias("latest_semantic"))


@plan("ingestion_status", sql("SELECT 'S' || s_suppkey AS doc_id, CASE WHEN latest IS NULL THEN 'not ingested' WHEN active IS NULL THEN 'inactive' ELSE 'active' END AS state, coalesce(chunks, 0) AS chunks FROM supplier LEFT JOIN (SELECT doc_id, max(version) AS latest, max(CASE WHEN status = 'active' THEN version END) AS active FROM history GROUP BY 1) h ON h.doc_id = 'S' || s_suppkey LEFT JOIN (SELECT 'S' || ps_suppkey AS doc_id, v, count(*) AS chunks FROM (SELECT l_suppkey AS ps_suppkey, l_linenumber AS v FROM lineitem) GROUP BY 1, 2) c ON c.doc_id = 'S' || s_suppkey AND c.v = active", HISTORY_SQL))
def ingestion_status(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("version"), (F.col("l_returnflag") == "A").alias("embedded"))
    return curation.ingestion_status(history_docs(spark, folder), history(spark, folder), rows).select("doc_id", "state", "chunks")


@plan("all_units_approved", sql("SELECT version, bool_and(review_status = 'approved') AS approved FROM units GROUP BY 1", UNITS_SQL))
def all_units_approved(spark, folder):
    return curation.all_approved(units(spark, folder), ["version"])


@plan("load_units", sql("SELECT version, unit_key, title FROM units WHERE version IN (SELECT version FROM units GROUP BY 1 HAVING bool_and(review_status = 'approved'))", UNITS_SQL))
def load_units(spark, folder):
    u = units(spark, folder)
    return u.join(curation.all_approved(u, ["version"]).where("approved"), "version", "left_semi").select("version", "unit_key", "title")


@plan("fork", sql(f"SELECT 'S' || s_suppkey AS doc_id, CASE {SHAPE} WHEN 'A' THEN '' WHEN 'F' THEN '' WHEN 'C' THEN 'no active semantic version to revise' WHEN 'G' THEN 'no active semantic version to revise' WHEN 'D' THEN 'version 1 is already open' ELSE 'version 2 is already open' END AS refused, CASE {SHAPE} WHEN 'A' THEN 2 WHEN 'F' THEN 2 ELSE 0 END AS clones FROM supplier"))
def fork(spark, folder):
    h = history(spark, folder).where("strategy = 'semantic_llm'")
    own = h.select("doc_id", "version", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("unit_key"))
    _, after, refused = curation.forked(history(spark, folder), own, history_docs(spark, folder))
    before = h.groupBy("doc_id").agg((F.count(F.lit(1)) * 2).alias("n0"))
    now = after.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n1"))
    d = history_docs(spark, folder).select("doc_id").join(refused, "doc_id", "left").join(now, "doc_id", "left").join(before, "doc_id", "left")
    return d.select("doc_id", F.coalesce("reason", F.lit("")).alias("refused"), F.coalesce(F.col("n1") - F.col("n0"), F.lit(0)).alias("clones"))


# Representations


@plan("units_with_reps", sql("SELECT version, unit_key, count(rep_kind) AS n, coalesce(bool_or(unit_content_hash <> content_hash), false) AS stale FROM units LEFT JOIN reps USING (version, unit_key) GROUP BY 1, 2", UNITS_SQL))
def units_with_reps(spark, folder):
    u = curation.units_with_reps(units(spark, folder), reps(spark, folder), ["version"])
    return u.select("version", "unit_key", F.size("representations").cast("long").alias("n"), "stale")


@plan("index_reps", sql("SELECT r.version, r.unit_key, rep_kind, r.text FROM reps r JOIN units u USING (version, unit_key) WHERE unit_content_hash = content_hash AND version IN (SELECT version FROM units GROUP BY 1 HAVING bool_and(review_status = 'approved'))", UNITS_SQL))
def index_reps(spark, folder):
    u = units(spark, folder)
    good = u.join(curation.all_approved(u, ["version"]).where("approved"), "version", "left_semi").select("version", "unit_key", F.col("content_hash").alias("unit_content_hash"))
    return reps(spark, folder).join(good, ["version", "unit_key", "unit_content_hash"]).select("version", "unit_key", "rep_kind", "text")


def _held(spark, folder):
    """Representations as they are held, with a vector of their length where there is one."""
    r = reps(spark, folder)
    own = curation.rep_hash(F.col("text"), curation.rep_id(F.col("unit_key"), F.col("rep_kind")))
    return r.select("version", "unit_key", "rep_kind", own.alias("content_hash"), "text", F.when(F.col("embedded"), F.array(F.char_length("text").cast("double"))).alias("embedding"))


def _fresh(spark, folder):
    """New ones for every third unit: the overview as it was, others facts, no questions."""
    r = reps(spark, folder).where("pmod(crc32(cast(unit_key as binary)), 3) = 0 and rep_kind <> 'questions'")
    return r.select("version", "unit_key", "rep_kind", F.when(F.col("rep_kind") == "overview", F.col("text")).otherwise(F.concat(F.lit("new "), "text")).alias("text"), F.endswith("unit_key", F.lit("9")).alias("over_limit"))


@plan("write_representations")
def write_representations(spark, folder):
    after, _ = curation.written(_held(spark, folder), _fresh(spark, folder), ["version"])
    return after.select("version", "unit_key", "rep_kind", "text", F.col("embedding").isNotNull().alias("embedded"))


@plan("embed_missing_reps", sql("SELECT version, unit_key, rep_kind, length(text) AS size FROM reps", UNITS_SQL))
def embed_missing_reps(spark, folder):
    r = curation.with_vectors(_held(spark, folder), ["version", "unit_key", "rep_kind"], lambda t: F.array(F.char_length(t).cast("double")))
    return r.select("version", "unit_key", "rep_kind", F.col("embedding")[0].cast("long").alias("size"))


def _model(prompt: str, tighten: bool) -> str:
    """A stand-in for a model: an overview and facts, shorter when asked."""
    import json

    body = prompt.split("Unit content:\n", 1)[1]
    return json.dumps({"overview": body[:80], "facts": [body[: 400 if tighten else 40_000]], "questions": ["What is it?", ""]})


@plan("generate_representations", sql("SELECT version, unit_key, rep_kind, CASE rep_kind WHEN 'overview' THEN trim(substr(source_text, 1, 80), ' ' || chr(9) || chr(10) || chr(13)) WHEN 'questions' THEN 'What is it?' END AS text FROM units CROSS JOIN (SELECT unnest(['overview', 'questions']) AS rep_kind) WHERE rep_kind = 'questions' OR trim(substr(source_text, 1, 80), ' ' || chr(9) || chr(10) || chr(13)) <> ''", UNITS_SQL))
def generate_representations(spark, folder):
    none = F.array().cast("array<string>")
    u = units(spark, folder).withColumn("prompt", curation.unit_prompt(F.col("title"), F.col("unit_type"), none, F.lit(None).cast("string"), F.col("source_text"), F.lit(False)))
    g = curation.generated(u, ["version", "unit_key"], _model)
    return g.where("rep_kind <> 'facts'").select("version", "unit_key", "rep_kind", "text")


@plan("regenerate_reps", sql("SELECT version, unit_key FROM (SELECT version, unit_key, coalesce(bool_or(unit_content_hash <> content_hash), false) AS stale, count(rep_kind) AS n FROM units LEFT JOIN reps USING (version, unit_key) GROUP BY 1, 2) WHERE stale OR n = 0", UNITS_SQL))
def regenerate_reps(spark, folder):
    u = curation.units_with_reps(units(spark, folder), reps(spark, folder), ["version"]).where("stale or size(representations) = 0")
    none = F.array().cast("array<string>")
    p = u.withColumn("prompt", curation.unit_prompt(F.col("title"), F.col("unit_type"), none, F.lit(None).cast("string"), F.col("source_text"), F.lit(False)))
    return curation.generated(p, ["version", "unit_key"], _model).select("version", "unit_key").distinct()


#: Outputs that representations are read from, by number, and what is found.
OUTPUTS = [
    ('```json\n{"overview": " A valve ", "facts": ["12 VAC", "", 3], "questions": []}\n```', "overview=A valve;facts=12 VAC/3"), ('{"overview": ""}', "no usable representations"), ("", "nothing returned"), ("[1]", "not an object"), ("{", "not JSON"),
    ('{"facts": "none", "questions": ["Why?"]}', "questions=Why?"),
]


def outputs(spark, folder, rows):
    e = table(spark, folder, "events").select("event_id", (F.col("event_id") % len(rows)).cast("int").alias("n"))
    return e.withColumn("raw", F.element_at(F.array(*[F.lit(r[0]) for r in rows]), F.col("n") + 1))


@plan("reps_parse", sql(f"SELECT event_id, found FROM (SELECT event_id, event_id % {len(OUTPUTS)} AS n FROM events) JOIN read USING (n)", values_sql("read", "n, found", [(i, f) for i, (_, f) in enumerate(OUTPUTS)])))
def reps_parse(spark, folder):
    p = curation.parsed_representations(outputs(spark, folder, OUTPUTS), ["event_id"])
    line = F.coalesce("error", F.concat_ws("=", "rep_kind", F.replace("text", F.lit("\n"), F.lit("/"))))
    g = p.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("place", F.lit(0)).alias("p"), line.alias("x")))).alias("x"))
    return g.select("event_id", F.array_join(F.transform("x", lambda s: s["x"]), ";").alias("found"))


PROPOSALS = [
    ('{"units": [{"start_page": 1, "end_page": 2, "title": "Intro", "unit_type": "overview"}, {"start_page": 3, "end_page": 3, "title": "Valve", "unit_type": "procedure"}]}', "1-2 Intro;3-3 Valve"),
    ("{}", "error"), ("nothing", "error"),
]


@plan("proposal_parse")
def proposal_parse(spark, folder):
    p = curation.parsed_proposals(outputs(spark, folder, PROPOSALS), ["event_id"])
    return p.select("event_id", "at", "start_page", "end_page", "title", "unit_type", "review_flag", F.col("error").isNotNull().alias("wrong"))


@plan("assist_parse")
def assist_parse(spark, folder):
    return curation.parsed_suggestions(outputs(spark, folder, OUTPUTS), ["event_id"]).select("event_id", "overview", F.array_join("facts", "/").alias("facts"), F.col("error").isNotNull().alias("wrong"))


def _proposals(spark, folder):
    """Proposals of every conversation's version: its turns."""
    c = table(spark, folder, "conversations")
    return c.select(F.col("conv_id").alias("version"), F.col("turn").alias("proposal_id"), F.floor(F.col("turn") / 3).alias("made_at"), F.col("role").alias("model"), F.col("text").alias("raw_output"), F.lit("ok").alias("validation"))


@plan("training_trail", "SELECT conv_id AS version, turn AS proposal_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 3, turn) AS attempt FROM conversations")
def training_trail(spark, folder):
    return curation.attempts(_proposals(spark, folder), ["version"]).select("version", "proposal_id", F.col("attempt").cast("long").alias("attempt"))


@plan("training_export", "SELECT conv_id AS version, count(*) AS proposals, count(*) AS units, sum(length(text)) AS size FROM conversations GROUP BY 1")
def training_export(spark, folder):
    u = table(spark, folder, "conversations").select(F.col("conv_id").alias("version"), F.col("turn").alias("ordinal"), F.col("turn").cast("string").alias("unit_key"), F.col("role").alias("title"), F.col("text").alias("source_text"), F.lit("approved").alias("review_status"))
    e = curation.training_export(_proposals(spark, folder), u, ["version"])
    r = F.from_json("record", "proposals array<struct<raw_output:string>>, units array<struct<source_text:string>>")
    size = F.aggregate(r["units"], F.lit(0).cast("long"), lambda a, x: a + F.char_length(x["source_text"]))
    return e.select("version", F.size(r["proposals"]).cast("long").alias("proposals"), F.size(r["units"]).cast("long").alias("units"), size.alias("size"))


# Units under edits: an order is a version, its lines the units, each of one page.


def _boards(spark, folder, *todo):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    v = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("version")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    none = F.array().cast("array<string>")

    def unit(x, i):
        n = i + 1
        return F.struct(
            F.concat(F.lit("u"), n).alias("unit_key"), n.alias("ordinal"), F.concat(F.lit("Line "), n).alias("title"), F.lit("other").alias("unit_type"), n.alias("page_start"), n.alias("page_end"), F.lit(0.0).alias("start_y"), F.lit(1.0).alias("end_y"), none.alias("section_path"), x["l_returnflag"].alias("source_text"), none.alias("source_span"), F.lit("").alias("content_hash"),
            F.lit(review.PROPOSED).alias("review_status"), F.lit(review.BY_MODEL).alias("origin"), F.lit(False).alias("needs_ocr"), none.alias("edits"),
        )

    pages = F.transform("lines", lambda x, i: F.struct((i + 1).alias("page"), x["l_returnflag"].alias("text")))
    v = v.select("version", F.transform("lines", unit).alias("units"), pages.alias("pages"))
    names = [f.split(":") for f in review.EDIT[len("struct<") : -1].split(",")]
    edits = F.array(*[F.struct(*[F.lit(e.get(n)).cast(t).alias(n) for n, t in names]) for e in todo])
    return v.withColumn("todo", edits.cast(f"array<{review.EDIT}>"))


def _edited(spark, folder, *todo):
    out = review.edit_units(_boards(spark, folder, *todo))
    spans = F.transform("units", lambda u: F.concat(u["unit_key"], F.lit(":"), u["page_start"], F.lit("-"), u["page_end"]))
    return out.select("version", F.array_join(spans, " ").alias("spans"), F.size("removed").cast("long").alias("removed"), F.size("errors").cast("long").alias("errors"))


NUMBERED_SQL = "numbered AS (SELECT l_orderkey AS version, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS n FROM lineitem)"
LINES_SQL = f"""{NUMBERED_SQL},
named AS (SELECT version, n, 'u' || n || ':' || n || '-' || n AS x FROM numbered),
lines AS (SELECT version, count(*) AS n, string_agg(x, ' ' ORDER BY n) FILTER (n > 1) AS rest, string_agg(x, ' ' ORDER BY n) FILTER (n > 2) AS rest2 FROM named GROUP BY 1)"""


@plan("remove_unit", sql("SELECT version, coalesce(rest, '') AS spans, 1 AS removed, 1 AS errors FROM lines", LINES_SQL))
def remove_unit(spark, folder):
    return _edited(spark, folder, {"action": "remove", "unit_key": "u1"}, {"action": "remove", "unit_key": "u1"})


@plan("merge_units", sql("SELECT version, concat_ws(' ', CASE WHEN n > 1 THEN 'u1:1-2' ELSE 'u1:1-1' END, rest2) AS spans, CASE WHEN n > 1 THEN 1 ELSE 0 END AS removed, CASE WHEN n > 1 THEN 0 ELSE 1 END AS errors FROM lines", LINES_SQL))
def merge_units(spark, folder):
    return _edited(spark, folder, {"action": "merge", "unit_key": "u1", "other_key": "u2"})


@plan("split_unit", sql("SELECT version, concat_ws(' ', 'u1:1-1 002-second-half-b:1-1', rest) AS spans, 0 AS removed, 1 AS errors FROM lines", LINES_SQL))
def split_unit(spark, folder):
    return _edited(spark, folder, {"action": "split", "unit_key": "u1", "at_page": 1, "at_y": 0.5, "title": "Second half"}, {"action": "split", "unit_key": "u1", "at_page": 9, "at_y": 0.5})


@plan("add_unit", sql("SELECT version, concat_ws(' ', 'u1:1-1', rest, lpad(CAST(n + 2 AS VARCHAR), 3, '0') || '-a-new-one:1-1') AS spans, 0 AS removed, 0 AS errors FROM lines", LINES_SQL))
def add_unit(spark, folder):
    return _edited(spark, folder, {"action": "add", "start_page": 1, "end_page": 1, "start_y": 0.2, "end_y": 0.4, "title": "A new one", "unit_type": "procedure"})


@plan("move_boundary", sql("SELECT version, concat_ws(' ', 'u1:1-2', rest) AS spans, 0 AS removed, 0 AS errors FROM lines", LINES_SQL))
def move_boundary(spark, folder):
    return _edited(spark, folder, {"action": "move_boundary", "unit_key": "u1", "end_page": 2})


@plan("resize_push", sql("SELECT version, concat_ws(' ', 'u1:1-2', rest2) AS spans, CASE WHEN n > 1 THEN 1 ELSE 0 END AS removed, 0 AS errors FROM lines", LINES_SQL))
def resize_push(spark, folder):
    return _edited(spark, folder, {"action": "resize_push", "unit_key": "u1", "end_page": 2})


@plan("units_from_spans", sql("SELECT version, lpad(CAST(n AS VARCHAR), 3, '0') || '-line-' || n AS unit_key, n AS page_start, l_returnflag AS source_text FROM numbered", NUMBERED_SQL))
def units_from_spans(spark, folder):
    b = _boards(spark, folder)
    span = lambda u: F.struct(u["page_start"].alias("start_page"), u["page_end"].alias("end_page"), u["start_y"].alias("start_y"), u["end_y"].alias("end_y"), u["title"].alias("title"), u["unit_type"].alias("unit_type"))
    u = review.units_from_spans(b.select("version", F.transform("units", span).alias("spans"), "pages"))
    return u.select("version", "unit_key", F.col("page_start").cast("long").alias("page_start"), "source_text")


@plan("resegment_unit", sql("SELECT version, concat_ws(' ', 'u1:1-1', rest) AS spans, 1 AS removed, 0 AS errors FROM lines", LINES_SQL))
def resegment_unit(spark, folder):
    """A unit that is split, and put together again by its first half's growth."""
    return _edited(spark, folder, {"action": "split", "unit_key": "u1", "at_page": 1, "at_y": 0.5, "title": "Half"}, {"action": "resize_push", "unit_key": "u1", "end_page": 1, "end_y": 1.0})


@plan("approve_preflight", sql("SELECT version, NOT bool_or(needs_ocr OR trim(source_text) = '') AND NOT bool_or(version LIKE '%7') AS ready FROM units GROUP BY 1", UNITS_SQL))
def approve_preflight(spark, folder):
    u = units(spark, folder)
    wrong = u.where("version like '%7'").select("version", F.lit("overlap").alias("code")).distinct()
    return review.preflight(wrong, u).select("version", "ready")


@plan("marker_key", "SELECT l_orderkey, l_linenumber, l_linenumber < 3 OR (l_linenumber = 3 AND l_discount < 0.05) AS before FROM lineitem")
def marker_key(spark, folder):
    here, there = review.marker(F.col("l_linenumber"), F.col("l_discount")), review.marker(F.lit(3), F.lit(0.05))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", (here < there).alias("before"))


@plan("span_empty", "SELECT l_orderkey, l_linenumber, l_linenumber >= l_suppkey % 7 AS empty FROM lineitem")
def span_empty(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", review.span_empty(review.marker(F.col("l_linenumber"), F.lit(0.0)), review.marker(F.col("l_suppkey") % 7, F.lit(0.0))).alias("empty"))


@plan("unit_content_hash")
def unit_content_hash(spark, folder):
    tags = review.tags_of(F.lit(1), F.lit(0.0), F.lit(2), F.lit(1.0))
    return units(spark, folder).select("version", "unit_key", review.content_hash(F.col("source_text"), tags).alias("hash"))
