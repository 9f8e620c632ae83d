"""Plans of chunking, layout, audits and safety."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout
from ..operators import chunking, safety
from .base import CHUNKS_SQL, chunks, sql, values_sql
from .registry import plan, table

HEADS = ("SECTION 3 Overview", "TEST #4: Valve", "Ordinary line here", "WARNING: you must disconnect", "ERROR CODE table", "TEST #8: Drain .......... 3-15", "DIAGNOSTIC MODE entry", "Sensor check", "IMPORTANT")
#: Documents' lines with headings put between them.
PAGES_SQL = f"""manual AS (SELECT doc_id, list_extract({list(HEADS)!r}, CAST(doc_id % 9 + 1 AS INTEGER)) || chr(10) || text || chr(10) || list_extract({list(HEADS)!r}, CAST(doc_id % 7 + 1 AS INTEGER)) || chr(10) || 'closing line' AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM manual)"""
TRIMMED = "trim(line)"
IS_HEADING = f"""CASE WHEN {TRIMMED} = '' OR regexp_matches({TRIMMED}, '{chunking.CONTENTS_ROW}') OR regexp_matches({TRIMMED}, '{chunking.NOT_HEADING}') OR NOT regexp_matches({TRIMMED}, '{chunking.HEADING}') THEN false WHEN regexp_matches({TRIMMED}, '{chunking.BANNER}') THEN true
WHEN regexp_matches({TRIMMED}, '{chunking.NOTE}') OR (contains({TRIMMED}, '.') AND length({TRIMMED}) > 40) THEN false ELSE length({TRIMMED}) <= 90 END"""


def manual(spark, folder):
    heads = F.array(*map(F.lit, HEADS))
    pick = lambda n: F.element_at(heads, (F.col("doc_id") % n + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", F.concat_ws("\n", pick(9), "text", pick(7), F.lit("closing line")).alias("text"))


def lines(spark, folder):
    return manual(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@plan("is_section_heading", sql(f"SELECT doc_id, pos, {IS_HEADING} AS heading FROM lines", PAGES_SQL))
def is_section_heading(spark, folder):
    return lines(spark, folder).select("doc_id", F.col("pos").cast("long").alias("pos"), chunking.is_heading(F.col("line")).alias("heading"))


@plan("page_banner", sql(f"SELECT doc_id, coalesce(min_by(regexp_extract({TRIMMED}, '{chunking.RUNNING}', 0), pos) FILTER (pos < 8 AND regexp_matches({TRIMMED}, '{chunking.RUNNING}')), '') AS banner FROM lines GROUP BY 1", PAGES_SQL))
def page_banner(spark, folder):
    return manual(spark, folder).select("doc_id", F.coalesce(chunking.page_banner(F.col("text")), F.lit("")).alias("banner"))


@plan("carry_section", sql(f"SELECT doc_id, pos, coalesce(last_value(CASE WHEN {IS_HEADING} THEN {TRIMMED} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), '') AS section FROM lines", PAGES_SQL))
def carry_section(spark, folder):
    return chunking.carry_section(lines(spark, folder), "doc_id", ["pos"]).select("doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce("section", F.lit("")).alias("section"))


@plan("split_prose", sql(rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece) AS piece, text FROM (SELECT doc_id, piece, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text FROM (
SELECT *, sum(CASE WHEN pos > 0 AND {IS_HEADING} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS piece FROM lines) GROUP BY 1, 2) WHERE text <> ''""", PAGES_SQL))
def split_prose(spark, folder):
    p = chunking.split_prose(manual(spark, folder), "doc_id")
    return p.select("doc_id", F.col("piece").cast("long").alias("piece"), "text")


@plan("chunk_fixed", r"SELECT doc_id, pos, substr(text, pos + 1, 200) AS window FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text), 1) - 1, 200)) AS pos FROM documents) WHERE regexp_matches(substr(text, pos + 1, 200), '\S')")
def chunk_fixed(spark, folder):
    return chunking.fixed_windows(table(spark, folder, "documents"), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), "window")


ROW_SQL = "rows AS (SELECT p_partkey, p_name, p_brand, ['Name', 'Brand', ''] AS headers, [p_name, p_brand, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END] AS cells FROM part)"


def part_rows(spark, folder):
    return table(spark, folder, "part").select("p_partkey", "p_brand", F.array(F.lit("Name"), F.lit("Brand"), F.lit("")).alias("headers"), F.array("p_name", "p_brand", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string"))).alias("cells"))


@plan("contextual_text", sql("SELECT p_partkey, '[' || p_brand || '] Section: Parts. Name: ' || cells[1] || ' | Brand: ' || cells[2] || CASE WHEN cells[3] = '' THEN '' ELSE ' | ' || cells[3] END AS text FROM rows", ROW_SQL))
def contextual_text(spark, folder):
    return part_rows(spark, folder).select("p_partkey", chunking.contextual_text(F.col("p_brand"), F.lit("Parts"), F.col("headers"), F.col("cells")).alias("text"))


@plan("table_row_chunks", sql("SELECT p_partkey, array_to_string(list_filter(cells, lambda c: c <> ''), ' | ') AS body FROM rows", ROW_SQL))
def table_row_chunks(spark, folder):
    return part_rows(spark, folder).select("p_partkey", chunking.row_line(F.col("cells")).alias("body"))


@plan("strip_table_cells", sql("SELECT p_partkey, array_to_string(list_filter([cells[1], cells[1] || ' | ' || cells[2], 'See ' || cells[1], cells[2] || ' | other', ' '], lambda x: NOT (trim(x) <> '' AND (list_contains(cells, trim(x)) OR (contains(x, ' | ') AND list_has_all(cells, list_transform(string_split(x, '|'), lambda p: trim(p))))))), '/') AS kept FROM rows", ROW_SQL))
def strip_table_cells(spark, folder):
    c = lambda i: F.col("cells")[i]
    made = F.array(c(0), F.concat(c(0), F.lit(" | "), c(1)), F.concat(F.lit("See "), c(0)), F.concat(c(1), F.lit(" | other")), F.lit(" "))
    return part_rows(spark, folder).select("p_partkey", F.array_join(chunking.strip_table_cells(made, F.col("cells")), "/").alias("kept"))


SHORT_SQL = "short AS (SELECT *, text AS body FROM chunks)"


@plan("dedupe_prefer_tables", sql("SELECT chunk_no FROM (SELECT s.*, t.codes FROM short s LEFT JOIN (SELECT doc_id, flatten(list(error_codes)) AS codes FROM short WHERE kind = 'table_row' GROUP BY 1) t USING (doc_id)) WHERE NOT (kind <> 'table_row' AND len(error_codes) > 0 AND codes IS NOT NULL AND list_has_all(codes, error_codes) AND length(body) < 120)", CHUNKS_SQL, SHORT_SQL))
def dedupe_prefer_tables(spark, folder):
    return chunking.prefer_tables(chunks(spark, folder)).select("chunk_no")


AUDIT_SQL = r"""input AS (SELECT doc_id, chunk_id, kind, body, error_codes, ['Code', 'Remedy'] AS headers, CASE WHEN chunk_no % 3 = 0 THEN doc_id || ' Code Remedy ' ELSE '' END || body AS text, doc_id AS label, CASE WHEN chunk_no % 4 = 0 THEN 'Sec' END AS section, CASE WHEN chunk_no % 5 = 1 THEN 'Prop' END AS proposal FROM short),
tbl AS (SELECT doc_id, flatten(list(error_codes)) AS codes FROM input WHERE kind = 'table_row' GROUP BY 1),
findings AS (SELECT doc_id, chunk_id, 'headers_in_meta_not_text' AS code, 'warning' AS severity, true AS repairable FROM input WHERE kind = 'table_row' AND NOT (contains(text, 'Code') AND contains(text, 'Remedy'))
UNION ALL SELECT doc_id, chunk_id, 'opaque_numeric_row', 'warning', true FROM input WHERE kind = 'table_row' AND regexp_matches(text, '[0-9]') AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) < 8
UNION ALL SELECT doc_id, chunk_id, 'error_code_unbound', 'critical', false FROM input WHERE kind = 'table_row' AND len(error_codes) > 0 AND (len(list_filter(string_split(body, '|'), lambda x: trim(x) <> '')) < 2 OR list_contains(error_codes, trim(body)))
UNION ALL SELECT doc_id, chunk_id, 'missing_section_path', 'warning', true FROM input WHERE kind IN ('prose', 'procedure', 'table_row') AND section IS NULL AND proposal IS NOT NULL
UNION ALL SELECT doc_id, chunk_id, 'missing_doc_context', 'info', true FROM input WHERE kind <> 'article' AND NOT contains(text, label)
UNION ALL SELECT i.doc_id, chunk_id, 'duplicate_table_as_prose', 'warning', true FROM input i JOIN tbl USING (doc_id) WHERE kind <> 'table_row' AND len(error_codes) > 0 AND list_has_all(codes, error_codes) AND length(body) < 120
UNION ALL SELECT doc_id, chunk_id, 'oversized_prose', 'info', false FROM input WHERE kind IN ('prose', 'procedure') AND length(body) > 4000)"""


def audit_input(spark, folder):
    n = F.col("chunk_no")
    c = chunks(spark, folder).withColumn("body", F.col("text"))
    text = F.concat(F.when(n % 3 == 0, F.concat("doc_id", F.lit(" Code Remedy "))).otherwise(""), "body")
    return c.select("doc_id", "chunk_id", "kind", "body", "error_codes", F.array(F.lit("Code"), F.lit("Remedy")).alias("headers"), text.alias("text"), F.col("doc_id").alias("label"), F.when(n % 4 == 0, "Sec").alias("section"), F.when(n % 5 == 1, "Prop").alias("proposal"))


@plan("audit_chunks", sql("SELECT doc_id, chunk_id, code, severity, repairable FROM findings", CHUNKS_SQL, SHORT_SQL, AUDIT_SQL))
def audit_chunks(spark, folder):
    return chunking.audit(audit_input(spark, folder))


@plan("quality_counts", sql("SELECT code, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical FROM findings GROUP BY 1", CHUNKS_SQL, SHORT_SQL, AUDIT_SQL))
def quality_counts(spark, folder):
    return chunking.audit(audit_input(spark, folder)).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"))


@plan("repair_chunks", sql("""SELECT chunk_id, CASE WHEN rebuild THEN concat_ws(' ', '[' || label || ']', 'Section: ' || coalesce(section, proposal) || '.', 'Code | Remedy', body) ELSE text END AS text FROM input LEFT JOIN (
SELECT chunk_id, bool_or(code = 'duplicate_table_as_prose') AS gone, bool_or(code <> 'duplicate_table_as_prose') AS rebuild FROM findings WHERE repairable GROUP BY 1) USING (chunk_id) WHERE NOT coalesce(gone, false)""", CHUNKS_SQL, SHORT_SQL, AUDIT_SQL))
def repair_chunks(spark, folder):
    c = audit_input(spark, folder)
    return chunking.repair(c, chunking.audit(c)).select("chunk_id", "text")


@plan("audit_improve", sql("SELECT i.doc_id, CASE WHEN f.n IS NULL THEN 'clean' WHEN f.r = 0 THEN 'no_repairable' ELSE 'after_one_repair' END AS stop_reason FROM (SELECT DISTINCT doc_id FROM input) i LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (repairable) AS r FROM findings GROUP BY 1) f USING (doc_id)", CHUNKS_SQL, SHORT_SQL, AUDIT_SQL))
def audit_improve(spark, folder):
    return chunking.audit_and_improve(audit_input(spark, folder))[2]


#: Page texts of all kinds.
LAYOUT = [
    (1, "TROUBLESHOOTING GUIDE #2 " + "x" * 60 + " PROBLEM POSSIBLE CAUSE CHECKS"), (2, "TABLE OF CONTENTS page of the manual with many sections inside it"), (3, "Wiring diagram of the washer with pinout"), (4, "a b c d e f g h"), (5, "COMPONENT ACCESS see Figure 3 for the panel"),
    (6, "TEST #3 procedure text"), (7, "plain text of a page that says nothing special at all"), (8, "A ..... 1 B ..... 2 C ..... 3 D ..... 4 and then some more"), (9, "exploded view of parts"), (10, None), (11, "TEST #1 wiring diagram " + "word " * 200), (12, ""), (13, "see the diagram in fig. 4"),
]
LAYOUT_SQL = values_sql("sheets", "page, text", LAYOUT)
_M = f"(length(t) >= 80 AND regexp_matches(t, '{layout.GUIDE}') AND regexp_matches(t, '{layout.CAUSE}'))"
KINDS_SQL = rf"""looks AS (SELECT page, t, {_M} AS m, length(trim(t)) >= 40 AND NOT {_M} AND (len(regexp_extract_all(t, '\.{{4,}}\s*[0-9]+(-[0-9]+)?', 0)) >= 4 OR regexp_matches(t, '(?i)TABLE OF CONTENTS') OR (len(regexp_extract_all(t, '(?i)TEST\s*#\s*[0-9]+', 0)) >= 8 AND regexp_matches(t, '(?i)Section\s+[0-9]+\s*:'))) AS c,
  regexp_matches(t, '{layout.SCHEMATIC}') AND NOT regexp_matches(t, '{layout.PROCEDURE}') AND length(trim(t)) >= 12 AS s0, regexp_extract_all(t, '[A-Za-z0-9]+', 0) AS w FROM (SELECT page, coalesce(text, '') AS t FROM sheets)),
more AS (SELECT *, s0 AND NOT m AND NOT c AS s, len(list_filter(w, lambda x: length(x) >= 3)) AS words, len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]'))) / greatest(len(w), 1) AS share FROM looks),
figures AS (SELECT *, length(trim(t)) >= 12 AND NOT m AND NOT c AND NOT (regexp_matches(t, '{layout.PROCEDURE}') AND length(t) > 400) AND (s OR (regexp_matches(t, '{layout.FIGURE_TITLE}') AND (words < 80 OR share >= 0.25)) OR (regexp_matches(t, '(^|\s)[A-Za-z](\s+[A-Za-z]){{3,}}') AND share >= 0.35 AND words < 40) OR (share >= 0.55 AND words < 20 AND length(t) < 400)) AS f FROM more)"""


def sheets(spark):
    return spark.createDataFrame(LAYOUT, "page int, text string")


@plan("page_layout", sql(rf"SELECT page, CASE WHEN m THEN 'matrix' WHEN c THEN 'toc' WHEN s THEN 'schematic' WHEN f THEN 'figure' WHEN regexp_matches(t, '{layout.PHOTO}') AND regexp_matches(t, '(?i)Figure\s+[0-9]+') THEN 'photo_access' WHEN page = 7 THEN 'table_heavy' WHEN regexp_matches(t, '{layout.PROCEDURE}') THEN 'multi_column' ELSE 'default' END AS layout FROM figures", LAYOUT_SQL, KINDS_SQL))
def page_layout(spark, folder):
    cells = F.when(F.col("page") == 7, 12).otherwise(0)
    return sheets(spark).select("page", layout.page_layout(F.col("text"), cells, F.lit(1)).alias("layout"))


@plan("should_index_chunk", sql("SELECT page, page % 4 = 0 OR NOT (s OR f) AS indexed FROM figures", LAYOUT_SQL, KINDS_SQL))
def should_index_chunk(spark, folder):
    return sheets(spark).select("page", layout.should_index(F.col("text"), F.when(F.col("page") % 4 == 0, "table_row").otherwise("prose")).alias("indexed"))


@plan("unread_figure", sql(f"SELECT page, coalesce(regexp_matches(text, '{layout.FIGURE_REFERENCE}'), false) AS unread FROM sheets", LAYOUT_SQL))
def unread_figure(spark, folder):
    return sheets(spark).select("page", layout.unread_figure(F.col("text")).alias("unread"))


def _markers(kind: str) -> str:
    return " + ".join(f"CAST(contains(lower(x), '{m}') AS INTEGER)" for m in layout.MARKERS[kind])


MARKED = "text || CASE doc_id % 5 WHEN 1 THEN ' avertissement laveuse' WHEN 2 THEN ' lavadora técnico' WHEN 3 THEN ' laveuse lavadora' ELSE '' END"


@plan("detect_language", f"SELECT doc_id, coalesce(CASE WHEN fr = 0 AND es = 0 THEN CASE WHEN length(trim(x)) > 40 THEN 'en' END WHEN fr = es THEN 'en' WHEN fr > es THEN 'fr' ELSE 'es' END, '-') AS language FROM (SELECT doc_id, x, {_markers('fr')} AS fr, {_markers('es')} AS es FROM (SELECT doc_id, {MARKED} AS x FROM documents))")
def detect_language(spark, folder):
    n = F.col("doc_id") % 5
    x = F.concat("text", F.when(n == 1, " avertissement laveuse").when(n == 2, " lavadora técnico").when(n == 3, " laveuse lavadora").otherwise(""))
    return table(spark, folder, "documents").select("doc_id", x.alias("x")).select("doc_id", F.coalesce(layout.detect_language(F.col("x")), F.lit("-")).alias("language"))


@plan("infer_steps", r"""SELECT p_partkey, CASE WHEN n >= 5 AND lo <= 3 AND hi - lo + 1 >= 5 THEN array_to_string(list_filter(generate_series(lo, hi), lambda x: NOT list_contains(f, x)), ',') ELSE '-' END AS missing FROM (
SELECT p_partkey, f, len(f) AS n, list_min(f) AS lo, list_max(f) AS hi FROM (SELECT p_partkey, list_sort(list_distinct([CAST(p_size % 4 + 1 AS BIGINT), p_size % 4 + 2, p_size % 4 + 3, p_size % 4 + 5, p_partkey % 9 + 1, p_size % 4 + 8])) AS f FROM part))""")
def infer_steps(spark, folder):
    n, k = F.col("p_size") % 4, F.col("p_partkey") % 9
    text = F.concat_ws("\n", *[F.concat(x.cast("string"), F.lit(". do it")) for x in (n + 1, n + 2, n + 3, n + 5, k + 1, n + 8)])
    return table(spark, folder, "part").select("p_partkey", F.coalesce(F.array_join(layout.missing_steps(text).cast("array<string>"), ","), F.lit("-")).alias("missing"))


@plan("map_pua", "SELECT doc_id, 'JJ3' || doc_id % 10 || 'x • J3' || '6-1' AS mapped FROM documents".replace("'JJ3' || doc_id % 10 || 'x • J3' || '6-1'", "CASE WHEN doc_id % 2 = 0 THEN '• J36-1 a' ELSE '• b J7-2' END"))
def map_pua(spark, folder):
    raw = F.when(F.col("doc_id") % 2 == 0, " JJ366--11 a\x00").otherwise(" b J7-2")
    return table(spark, folder, "documents").select("doc_id", layout.map_private(raw).alias("mapped"))


CASES = [
    (1, "owner", "How do I bypass the door lock?", "x"), (2, "owner", "measure 120 v at the plug", "Step 1. then measure voltage at the panel [1]"), (3, "technician", "measure 120 v at the plug", "TEST #4: 1. measure VAC"), (4, "owner", "unplug it and replace the control board", "remove the cover"),
    (5, "owner", "clean the filter", "1. Open the door and clean the filter well"), (6, "technician", "remove the rear panel and disable the interlock", "a"), (7, "owner", "", "b"), (8, "owner", "how to run TEST # 3", "See TEST #3 then step 2 measure"), (9, "technician", "unplug", "jumper the door lock now"),
    (10, "owner", "capacitor discharge shock", "ABSTAIN: step 1"), (11, "owner", "cut the drain hose", "the hose is fine"), (12, "owner", "lay the washer down on its side", "step 3 ok [2]"), (13, None, "hard reset", "replace the pump"),
]
CASES_SQL = values_sql("cases", "request_id, audience, question, answer", CASES)


def cases(spark):
    return spark.createDataFrame(CASES, "request_id int, audience string, question string, answer string")


_RULES = ", ".join(f"({i}, '{a}', '{r}', '{safety.REQUEST_PATTERNS[r].replace(chr(39), chr(39) * 2)}', '{act}', {safety.SEVERITY[act]})" for i, (a, r, act) in enumerate(safety.REQUEST_RULES))
ASSESS_SQL = f"""rules AS (SELECT * FROM (VALUES {_RULES}) v(ord, audience, rule_id, pattern, action, sev)),
assessed AS (SELECT c.request_id, coalesce(c.audience, 'owner') AS audience, c.question, c.answer, coalesce(r.action, 'allow') AS action, coalesce(r.rule_id, CASE WHEN trim(c.question) = '' THEN 'empty' ELSE 'allow' END) AS rule_id FROM cases c LEFT JOIN rules r ON r.audience = coalesce(c.audience, 'owner') AND regexp_matches(c.question, r.pattern) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY r.sev DESC NULLS LAST, r.ord) = 1),
hazards AS (SELECT *, CASE WHEN regexp_matches(answer, '{safety.FORBIDDEN_OUTPUT}') THEN 'output-bypass' WHEN audience = 'owner' AND regexp_matches(answer, '{safety.OWNER_PROCEDURE}') THEN 'owner-tech-procedure' WHEN audience = 'owner' AND action = 'escalate' AND regexp_matches(answer, '{safety.UNSAFE_PROCEDURE}') THEN rule_id END AS hazard,
  NOT regexp_matches(upper(answer), '^(ABSTAIN:|BLOCK:|ESCALATE:)') AND NOT regexp_matches(answer, '\\[[0-9]+\\]') AND regexp_matches(answer, '{safety.PROCEDURE}') AS bare FROM assessed)"""


@plan("assess_request", sql("SELECT request_id, action, rule_id FROM assessed", CASES_SQL, ASSESS_SQL))
def assess_request(spark, folder):
    return safety.assess(cases(spark)).select("request_id", "action", "rule_id")


def assessed(spark):
    return safety.assess(cases(spark)).withColumn("audience", F.coalesce("audience", F.lit("owner")))


@plan("output_hazard", sql("SELECT request_id, coalesce(hazard, '') AS hazard FROM hazards", CASES_SQL, ASSESS_SQL))
def output_hazard(spark, folder):
    c = F.col
    return assessed(spark).select("request_id", F.coalesce(safety.output_hazard(c("audience"), c("action"), c("rule_id"), c("answer")), F.lit("")).alias("hazard"))


@plan("needs_citation", sql("SELECT request_id, bare FROM hazards", CASES_SQL, ASSESS_SQL))
def needs_citation(spark, folder):
    return cases(spark).select("request_id", safety.needs_citation(F.col("answer")).alias("bare"))


@plan("gate_answer", sql("SELECT request_id, CASE WHEN action = 'block' OR hazard = 'output-bypass' THEN 'block' WHEN hazard IS NOT NULL THEN 'escalate' WHEN bare THEN 'ungrounded' ELSE action END AS gate_action, CASE WHEN action = 'block' THEN rule_id WHEN hazard IS NOT NULL THEN hazard WHEN bare THEN 'ungrounded-procedure' ELSE rule_id END AS gate_rule FROM hazards", CASES_SQL, ASSESS_SQL))
def gate_answer(spark, folder):
    return safety.gate(assessed(spark)).select("request_id", "gate_action", "gate_rule")


@plan("merge_assessment", sql("SELECT request_id, CASE WHEN request_id % 3 = 0 AND action <> 'block' THEN 'escalate' ELSE action END AS action FROM assessed", CASES_SQL, ASSESS_SQL))
def merge_assessment(spark, folder):
    other = F.when(F.col("request_id") % 3 == 0, "escalate").otherwise("allow")
    return assessed(spark).select("request_id", safety.raised(F.col("action"), other).alias("action"))


@plan("may_stream", sql("SELECT request_id, action <> 'block' AND NOT (audience = 'owner' AND action = 'escalate') AS may FROM assessed", CASES_SQL, ASSESS_SQL))
def may_stream(spark, folder):
    return assessed(spark).select("request_id", safety.may_stream(F.col("audience"), F.col("action")).alias("may"))


@plan("severity", sql("SELECT request_id, CASE action WHEN 'allow' THEN 0 WHEN 'warn' THEN 1 WHEN 'escalate' THEN 2 ELSE 3 END AS severity FROM assessed", CASES_SQL, ASSESS_SQL))
def severity(spark, folder):
    return assessed(spark).select("request_id", safety.severity(F.col("action")).alias("severity"))


@plan("owner_evidence_policy", sql(f"SELECT request_id, audience = 'owner' AND action <> 'block' AND regexp_matches(answer, '{safety.SERVICE_EVIDENCE}') AS adds_directive FROM assessed", CASES_SQL, ASSESS_SQL))
def owner_evidence_policy(spark, folder):
    c = F.col
    return assessed(spark).select("request_id", ((c("audience") == "owner") & (c("action") != "block") & safety.mentions_service_literature(c("answer"))).alias("adds_directive"))


@plan("stream_gate")
def stream_gate(spark, folder):
    pieces = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,24}"), F.lit(0))).alias("n", "piece"))
    return safety.released_prefix(pieces.withColumn("answer_id", F.concat_ws("-", "conv_id", "turn")).drop("conv_id", "turn"))
