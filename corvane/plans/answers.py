"""Plans of model output, citations, evidence labels and packs, grading and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout
from ..operators import answers, grading, metrics
from .base import CHUNKS_SQL, EDGES_SQL, MANUALS_SQL, chunks, edges, manuals, sql, values_sql
from .inputs import ANSWERS_SQL, TURNS_SQL, turns
from .inputs import answers as model_answers
from .registry import plan, table

NUMBERED = "FROM (SELECT event_id, CAST(event_id % 8 AS INTEGER) AS n FROM events) JOIN said USING (n)"


@plan("parse_output", sql(f"SELECT event_id, abstained, reason, cited {NUMBERED}", ANSWERS_SQL))
def parse_output(spark, folder):
    out = answers.parse_outputs(model_answers(spark, folder), ["event_id"])
    cited = F.transform("claims", lambda c: F.coalesce(c["evidence_index"].cast("string"), F.lit("-")))
    return out.select("event_id", "abstained", F.col("abstain_reason").alias("reason"), F.array_join(cited, ",").alias("cited"))


@plan("bind_generation", sql(f"SELECT event_id, display, abstained, bound {NUMBERED}", ANSWERS_SQL))
def bind_generation(spark, folder):
    out = answers.bind_outputs(model_answers(spark, folder), ["event_id"])
    return out.select("event_id", "display", "abstained", F.array_join(F.transform("citations", lambda c: c["index"].cast("string")), ",").alias("bound"))


@plan("resolve_citations", "SELECT event_id, CASE event_id % 8 WHEN 0 THEN '1' WHEN 3 THEN '2,3' WHEN 7 THEN '3' ELSE '' END AS cited FROM events")
def resolve_citations(spark, folder):
    e = model_answers(spark, folder).withColumn("answer", F.col("raw"))
    out = answers.resolve_outputs(e, ["event_id"])
    return out.select("event_id", F.array_join(F.transform("citations", lambda c: c["index"].cast("string")), ",").alias("cited"))


SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace(line, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p, chr(9) || chr(10) || chr(13) || ' ')), lambda p: p <> '')"


@plan("claims_from_prose", sql(rf"SELECT conv_id, turn, pos, claim, coalesce(try_cast(regexp_extract(claim, '\[(\d+)\]', 1) AS INTEGER), 0) AS cited FROM (SELECT conv_id, turn, unnest({SENTENCES}) AS claim, generate_subscripts({SENTENCES}, 1) AS pos FROM (SELECT conv_id, turn, text || ' See [' || turn || ']. Then [12]!' AS line FROM turns))", TURNS_SQL))
def claims_from_prose(spark, folder):
    line = F.concat("text", F.lit(" See ["), "turn", F.lit("]. Then [12]!"))
    t = turns(spark, folder).select("conv_id", "turn", F.posexplode(answers.claims_of(line)).alias("p", "c"))
    return t.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("pos"), F.col("c.text").alias("claim"), F.coalesce("c.evidence_index", F.lit(0)).alias("cited"))


@plan("evidence_fence", sql(rf"SELECT conv_id, turn, '{answers.EVIDENCE_BEGIN}' || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || '{answers.EVIDENCE_END}' AS fenced FROM turns", TURNS_SQL))
def evidence_fence(spark, folder):
    return turns(spark, folder).select("conv_id", "turn", answers.fenced(answers.fenced(F.col("text"))).alias("fenced"))


#: Hits of chunks: every chunk one, a fifth of them a unit's.
DETAIL_SQL = r"""rows_ AS (SELECT *, chunk_no % 5 = 0 AS unit, CASE chunk_no % 3 WHEN 0 THEN 'structured' WHEN 1 THEN 'semantic_llm' ELSE 'imported' END AS strategy, CASE chunk_no % 4 WHEN 0 THEN 'Table group: POOR WASH | Problem: Oversuds. (see note)' || chr(10) WHEN 1 THEN 'Error Code: f0e2 ' WHEN 2 THEN 'Problem: WON''T START' || chr(10) ELSE '' END || text AS body FROM chunks),
detail AS (SELECT *, CASE chunk_no % 4 WHEN 0 THEN 'POOR WASH / Oversuds.' WHEN 1 THEN 'F0E2' WHEN 2 THEN 'WON''T START' ELSE CASE WHEN len(found) = 1 THEN found[1] ELSE '' END END AS d FROM (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(body, '(?i)\bF\s*[0-9]\s*E\s*[0-9]\b', 0), lambda c: upper(regexp_replace(c, '\s+', '', 'g'))))) AS found FROM rows_)),
labelled AS (SELECT *, publication_number || CASE WHEN revision IS NULL THEN '' ELSE ' Rev ' || revision END || CASE WHEN unit THEN ' pp.' || page || '-' || (page + 2) ELSE ' p.' || page END || CASE WHEN unit OR strategy = 'semantic_llm' THEN ' [semantic]' WHEN strategy = 'structured' THEN ' [structured]' ELSE ' [imported]' END || CASE WHEN unit THEN ' — Unit ' || chunk_no WHEN d <> '' THEN ' — ' || d ELSE '' END AS label FROM detail)"""


def hits(spark, folder):
    n, c = F.col("chunk_no"), chunks(spark, folder)
    head = F.when(n % 4 == 0, "Table group: POOR WASH | Problem: Oversuds. (see note)\n").when(n % 4 == 1, "Error Code: f0e2 ").when(n % 4 == 2, "Problem: WON'T START\n").otherwise("")
    strategy = F.when(n % 3 == 0, "structured").when(n % 3 == 1, "semantic_llm").otherwise("imported")
    return c.withColumns({"unit": n % 5 == 0, "strategy": strategy, "body": F.concat(head, "text"), "title": F.concat(F.lit("Unit "), n)})


def labelled(spark, folder):
    c = F.col
    pages = answers.unit_pages(F.lit(None).cast("string"), c("page"), c("page") + 2)
    label = answers.format_label(c("publication_number"), c("doc_id"), c("revision"), c("page"), c("strategy"), c("body"), c("unit"), pages, c("title"))
    return hits(spark, folder).withColumn("label", label)


@plan("label_detail", sql("SELECT chunk_no, d AS detail FROM detail", CHUNKS_SQL, DETAIL_SQL))
def label_detail(spark, folder):
    return hits(spark, folder).select("chunk_no", answers.label_detail(F.col("body")).alias("detail"))


@plan("format_label", sql("SELECT chunk_no, label FROM labelled", CHUNKS_SQL, DETAIL_SQL))
def format_label(spark, folder):
    return labelled(spark, folder).select("chunk_no", "label")


STUB_SQL = """CASE WHEN NOT unit THEN '[3] ' || label || chr(10) || 'modality: structured_text' || chr(10) || body
 WHEN chunk_no % 2 = 0 THEN '[3] ' || label || chr(10) || 'modality: semantic_pdf' || chr(10) || 'unit: ' || chunk_id || ' (' || kind || ')' || chr(10) || 'Authority for [3]: attached PDF page-range (or page images) labeled [3].' || chr(10) || 'Do not invent content not visible in that attachment.'
 ELSE '[3] ' || label || chr(10) || 'modality: semantic_text_fallback' || chr(10) || 'Note: PDF/raster attach failed for [3]; authority is the extract below.' || chr(10) || body END"""


@plan("semantic_stub", sql(f"SELECT chunk_no, {STUB_SQL} AS body FROM labelled", CHUNKS_SQL, DETAIL_SQL))
def semantic_stub(spark, folder):
    c = F.col
    body = answers.prompt_body(F.lit("3"), c("label"), c("body"), c("unit"), c("chunk_no") % 2 == 0, c("chunk_id"), c("kind"))
    return labelled(spark, folder).select("chunk_no", body.alias("body"))


@plan("citation_public", sql("SELECT chunk_no, CASE WHEN page >= 1 AND chunk_no % 6 NOT IN (4, 5) THEN '/v1/documents/' || trim(id) || '/pages/' || page || '/image' ELSE '' END AS url FROM (SELECT *, CASE chunk_no % 6 WHEN 4 THEN '../' || doc_id WHEN 5 THEN doc_id || '..x' ELSE ' ' || doc_id END AS id FROM chunks)", CHUNKS_SQL))
def citation_public(spark, folder):
    n = F.col("chunk_no")
    doc = F.when(n % 6 == 4, F.concat(F.lit("../"), "doc_id")).when(n % 6 == 5, F.concat("doc_id", F.lit("..x"))).otherwise(F.concat(F.lit(" "), "doc_id"))
    return chunks(spark, folder).select("chunk_no", F.coalesce(answers.page_url(doc, F.col("page")), F.lit("")).alias("url"))


@plan("layout_from_hit", sql("SELECT chunk_no, chunk_no % 5 NOT IN (0, 1) AND page % 2 = 0 AS boxed FROM chunks", CHUNKS_SQL))
def layout_from_hit(spark, folder):
    n = F.col("chunk_no")
    box = F.struct(F.lit(10.0).alias("x0"), F.lit(5.0).alias("y0"), F.when(n % 5 == 0, 10.0).when(n % 5 == 1, F.lit(None)).otherwise(90.0).alias("x1"), F.lit(20.0).alias("y1"))
    return chunks(spark, folder).withColumn("box", box).select("chunk_no", answers.layout_box(F.col("box"), F.when(F.col("page") % 2 == 0, 612.0), F.lit(792.0)).isNotNull().alias("boxed"))


@plan("pack_order", sql("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN first THEN 0 WHEN turn % 3 = 0 THEN 1 ELSE 2 END, turn) AS place FROM (SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS first FROM turns)", TURNS_SQL))
def pack_order(spark, folder):
    from ..operators import evidence

    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(F.col("turn") % 3 == 0, 5.0).otherwise(0.0).alias("x1"), F.lit(9.0).alias("y1"))
    t = turns(spark, folder).withColumn("boxed", answers.layout_box(box, F.lit(612.0), F.lit(792.0)).isNotNull())
    return evidence.pack_order(t, "conv_id", "turn", "boxed").select("conv_id", "turn", F.col("place").cast("long").alias("place"))


SEEN = [f"COMPONENT ACCESS as shown in Figure {i}" if i % 3 == 0 else "see the wiring diagram" if i % 3 == 1 else "press start" for i in range(6)]


@plan("plan_page_images", sql(f"SELECT query_id, doc_id, page, place FROM (SELECT query_id, doc_id, page, row_number() OVER (PARTITION BY query_id ORDER BY min(turn)) AS place FROM (SELECT conv_id AS query_id, 'D' || turn % 4 AS doc_id, turn % 3 AS page, turn, turn % 6 % 3 < 2 AS gated FROM turns) WHERE gated AND page >= 1 AND doc_id <> 'D2' GROUP BY 1, 2, 3) WHERE place <= 3", TURNS_SQL))
def plan_page_images(spark, folder):
    from ..operators import evidence

    t = F.col("turn")
    text = F.element_at(F.array(*map(F.lit, SEEN)), (t % 6 + 1).cast("int"))
    h = turns(spark, folder).select(F.col("conv_id").alias("query_id"), F.concat(F.lit("D"), t % 4).alias("doc_id"), (t % 3).alias("page"), t.alias("rank"), text.alias("text"))
    held = spark.createDataFrame([("D0",), ("D1",), ("D3",)], "doc_id string")
    p = evidence.page_images(h, held, layout.needs_image(F.col("text")), 3)
    return p.select("query_id", "doc_id", "page", F.col("place").cast("long").alias("place"))


@plan("evidence_map", "SELECT conv_id, array_to_string(list(turn || ':' || length(text) ORDER BY turn), ',') AS blocks FROM conversations GROUP BY 1")
def evidence_map(spark, folder):
    from ..operators import evidence

    m = evidence.block_map(table(spark, folder, "conversations"), "conv_id", "turn", "text")
    line = F.transform(F.array_sort(F.map_entries("blocks")), lambda e: F.concat_ws(":", e["key"], F.char_length(e["value"])))
    return m.select("conv_id", F.array_join(line, ",").alias("blocks"))


#: Applicable parts lists, and the part numbers that their chunks name.
PARTS_SQL = r"""named AS (SELECT c.doc_id, c.chunk_no, unnest(regexp_extract_all(text || ' W' || (10000000 + chunk_no % 300) || ' W1' || lpad(substr(c.doc_id, 2), 7, '0'), '\bW\d{8}\b', 0)) AS part FROM chunks c JOIN manuals m USING (doc_id) WHERE m.doc_type = 'tech_sheet'),
firsts AS (SELECT doc_id, part, min(chunk_no) AS at0 FROM named WHERE part NOT IN (SELECT publication_number FROM manuals) GROUP BY 1, 2)"""


@plan("related_parts", sql("SELECT doc_id, string_agg(part, ',' ORDER BY at0, part) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY at0, part) AS r FROM firsts) WHERE r <= 8 GROUP BY 1", CHUNKS_SQL, MANUALS_SQL, PARTS_SQL))
def related_parts(spark, folder):
    from ..operators import evidence

    n = F.col("chunk_no")
    line = F.concat("text", F.lit(" W"), 10_000_000 + n % 300, F.lit(" W1"), F.lpad(F.substring("doc_id", 2, 9), 7, "0"))
    c = chunks(spark, folder).select(F.col("doc_id").alias("query_id"), "doc_id", n.alias("rank"), line.alias("text"))
    lists = manuals(spark).where("doc_type = 'tech_sheet'").select("doc_id")
    p = evidence.related_parts(c, lists, manuals(spark).select("publication_number"))
    return p.select(F.col("query_id").alias("doc_id"), F.array_join("parts", ",").alias("parts"))


# Grading


RULES_SQL = values_sql("rules", "k, must, contains_, fails, abstain", [(0, "D0001", "test", "bypass", False), (1, "W10000003 Rev B", "the", "zu", False), (2, None, None, "x9", True)])
GRADED_SQL = """graded AS (SELECT conv_id, turn, list_concat(list_concat(list_concat(CASE WHEN abstain AND NOT refuses THEN ['expected abstention'] ELSE [] END, CASE WHEN contains_ IS NOT NULL AND NOT contains(lower(text), contains_) THEN ['missing ''' || contains_ || ''''] ELSE [] END),
  CASE WHEN must IS NOT NULL AND NOT met THEN ['must_cite missing ''' || must || '''; got [''' || cited || ''']'] ELSE [] END), CASE WHEN NOT refuses AND contains(lower(text), fails) THEN ['fails_if matched ''' || fails || ''''] ELSE [] END) AS f FROM (
  SELECT *, conv_id % 7 = 2 AS refuses, CASE turn % 3 WHEN 0 THEN 'D0001' WHEN 1 THEN 'W10000003 Rev B' ELSE 'W10000003' END AS cited, CASE WHEN k = 0 THEN turn % 3 = 0 ELSE turn % 3 = 1 END AS met FROM (SELECT *, CAST(conv_id % 3 AS INTEGER) AS k FROM conversations) JOIN rules USING (k)) WHERE role = 'assistant')"""


def answered(spark, folder):
    r = spark.createDataFrame([(0, ["D0001"], ["test"], ["bypass"], False), (1, ["W10000003 Rev B"], ["the"], ["zu"], False), (2, None, None, ["x9"], True)], "k int, must_cite array<string>, expect_contains array<string>, fails_if_contains array<string>, expect_abstain boolean")
    c = table(spark, folder, "conversations").where("role = 'assistant'").withColumn("k", (F.col("conv_id") % 3).cast("int"))
    cited = F.when(F.col("turn") % 3 == 0, "D0001").when(F.col("turn") % 3 == 1, "W10000003 Rev B").otherwise("W10000003")
    none = F.lit(None).cast("array<string>")
    return c.join(F.broadcast(r), "k").withColumn("answer", F.col("text")).withColumns({"citations": F.array(cited), "abstained": F.col("conv_id") % 7 == 2, "phase": F.lit(None).cast("string"), "ruled_out": none, "hypotheses": none})


@plan("grade_answer", sql("SELECT conv_id, turn, len(f) = 0 AS passed, CASE WHEN len(f) = 0 THEN 'ok' ELSE array_to_string(f, '; ') END AS detail FROM graded", RULES_SQL, GRADED_SQL))
def grade_answer(spark, folder):
    return grading.graded(answered(spark, folder)).select("conv_id", "turn", "passed", "detail")


@plan("grade_turns", sql("SELECT conv_id, len(f) = 0 AS passed, CASE WHEN len(f) = 0 THEN 'ok' ELSE array_to_string(f, '; ') END AS detail FROM graded QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1", RULES_SQL, GRADED_SQL))
def grade_turns(spark, folder):
    a = answered(spark, folder)
    turns_ = a.select(F.col("conv_id").alias("scenario_id"), "turn", "answer", "citations", "abstained", "phase", "ruled_out", "hypotheses")
    scenarios = a.select(F.col("conv_id").alias("scenario_id"), F.lit(None).cast("long").alias("turn"), "must_cite", "expect_contains", "fails_if_contains", "expect_abstain").distinct()
    return grading.grade_turns(scenarios, turns_).select(F.col("scenario_id").alias("conv_id"), "passed", "detail")


#: Scenarios made of benchmark items: their rules, and an overlay for every third.
SCENARIOS_SQL = """scenarios AS (SELECT item_id AS scenario_id, text AS question, CASE item_id % 4 WHEN 0 THEN 'draft' ELSE 'ready' END AS status, CASE item_id % 5 WHEN 1 THEN ['D' || item_id] ELSE [] END AS must_cite, CASE item_id % 7 WHEN 0 THEN 'causes' ELSE '' END AS expect_phase FROM benchmark),
overlay AS (SELECT item_id AS scenario_id, ['W' || item_id, 'X'] AS must_cite, CASE WHEN item_id % 2 = 0 THEN 'close' END AS expect_phase FROM benchmark WHERE item_id % 3 = 0)"""


def scenarios(spark, folder):
    n, b = F.col("item_id"), table(spark, folder, "benchmark")
    cite = F.when(n % 5 == 1, F.array(F.concat(F.lit("D"), n))).otherwise(F.array().cast("array<string>"))
    return b.select(n.alias("scenario_id"), F.col("text").alias("question"), F.when(n % 4 == 0, "draft").otherwise("ready").alias("status"), cite.alias("must_cite"), F.when(n % 7 == 0, "causes").otherwise("").alias("expect_phase"))


def overlays(spark, folder):
    n = F.col("item_id")
    return table(spark, folder, "benchmark").where(n % 3 == 0).select(n.alias("scenario_id"), F.array(F.concat(F.lit("W"), n), F.lit("X")).alias("must_cite"), F.when(n % 2 == 0, "close").alias("expect_phase"))


@plan("merge_scenarios", sql("SELECT scenario_id, question, array_to_string(list_concat(s.must_cite, coalesce(o.must_cite, [])), ',') AS must_cite, coalesce(o.expect_phase, s.expect_phase) AS expect_phase FROM scenarios s LEFT JOIN overlay o USING (scenario_id)", SCENARIOS_SQL))
def merge_scenarios(spark, folder):
    m = grading.merge_scenarios(scenarios(spark, folder), overlays(spark, folder))
    return m.select("scenario_id", "question", F.array_join("must_cite", ",").alias("must_cite"), "expect_phase")


@plan("has_rule", sql("SELECT scenario_id, len(must_cite) > 0 OR expect_phase <> '' AS ruled FROM scenarios", SCENARIOS_SQL))
def has_rule(spark, folder):
    s = scenarios(spark, folder)
    return s.select("scenario_id", grading.has_rule({"must_cite": F.col("must_cite"), "expect_phase": F.col("expect_phase")}).alias("ruled"))


@plan("phrase_candidates")
def phrase_candidates(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(grading.phrase_candidates(F.col("text")), ",").alias("phrases"))


def results(spark, folder):
    """Every graded answer as a run's result."""
    g = grading.graded(answered(spark, folder))
    return g.select(F.concat_ws("-", "conv_id", "turn").alias("scenario_id"), F.lit("run-1.json").alias("run_label"), "detail", "answer", "passed", "abstained", F.lit("says why").alias("expect"), F.lit("").alias("fails_if"))


@plan("overlay_draft", sql("""SELECT conv_id || '-' || turn AS scenario_id, detail AS fail_detail, array_to_string(list_sort(list_distinct(regexp_extract_all(detail, 'must_cite missing ''([^'']+)''', 1))), ',') AS must_cite FROM (SELECT conv_id, turn, array_to_string(f, '; ') AS detail FROM graded WHERE len(f) > 0)""", RULES_SQL, GRADED_SQL))
def overlay_draft(spark, folder):
    d = grading.overlay_draft(results(spark, folder).where("not passed"))
    return d.select("scenario_id", "fail_detail", F.coalesce(F.array_join("must_cite", ","), F.lit("")).alias("must_cite"))


@plan("promote_failure")
def promote_failure(spark, folder):
    r = results(spark, folder)
    held = r.select("scenario_id", F.lit("live").alias("live"), F.when(F.endswith("scenario_id", F.lit("1")), "older").alias("draft"))
    return grading.promote_failures(r, held)


# Rates


@plan("false_escalation_rate", "SELECT role, round(count(*) FILTER (benign AND action IN ('escalate', 'block')) / nullif(count(*) FILTER (benign), 0), 6) AS rate FROM (SELECT role, turn % 3 <> 0 AS benign, CASE WHEN contains(lower(text), 'the ') THEN 'allow' WHEN length(text) > 600 THEN 'escalate' ELSE 'warn' END AS action FROM conversations) GROUP BY 1")
def false_escalation_rate(spark, folder):
    action = F.when(F.contains(F.lower("text"), F.lit("the ")), "allow").when(F.char_length("text") > 600, "escalate").otherwise("warn")
    c = table(spark, folder, "conversations").withColumns({"benign": F.col("turn") % 3 != 0, "action": action})
    return c.groupBy("role").agg(F.round(metrics.false_escalation_rate(c), 6).alias("rate"))


JUDGES_SQL = "runs AS (SELECT doc_id, quality = 1 AS expected, CASE WHEN toxic = 1 THEN false WHEN length(text) > 40 THEN true END AS judged, source FROM labels JOIN documents USING (doc_id))"


def judged_labels(spark, folder):
    both = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    return both.select("doc_id", "source", (F.col("quality") == 1).alias("expected"), F.when(F.col("toxic") == 1, False).when(F.char_length("text") > 40, True).alias("judged"))


@plan("judge_agreement", sql("SELECT source, round(count(*) FILTER (judged = expected) / nullif(count(judged), 0), 6) AS agreement FROM runs GROUP BY 1", JUDGES_SQL))
def judge_agreement(spark, folder):
    return judged_labels(spark, folder).groupBy("source").agg(F.round(metrics.agreement(F.col("judged"), F.col("expected")), 6).alias("agreement"))


#: Languages predicted by marker words, as runs of a labelling arm.
LANGS_SQL = "runs AS (SELECT source AS arm, lang AS expected, CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' und ') THEN 'de' WHEN contains(text, ' les ') THEN 'fr' END AS predicted, n_chars AS ms, n_chars / 1e6 * 2.5 AS cost FROM documents)"


def label_runs(spark, folder):
    x = F.col("text")
    guess = F.when(F.contains(x, F.lit(" the ")), "en").when(F.contains(x, F.lit(" und ")), "de").when(F.contains(x, F.lit(" les ")), "fr")
    return table(spark, folder, "documents").select(F.col("source").alias("arm"), F.col("lang").alias("expected"), guess.alias("predicted"), F.col("n_chars").alias("ms"), metrics.token_cost(F.col("n_chars"), F.lit(0), 2.5, 10.0).alias("cost"))


@plan("intent_accuracy", sql("SELECT arm, count(*) FILTER (expected IS NOT DISTINCT FROM predicted) AS n_right, round(avg(CASE WHEN expected IS NOT DISTINCT FROM predicted THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(ms), 6) AS mean_ms, round(sum(cost), 6) AS cost FROM runs GROUP BY 1", LANGS_SQL))
def intent_accuracy(spark, folder):
    a = metrics.label_accuracy(label_runs(spark, folder), "arm")
    return a.select("arm", F.col("right").alias("n_right"), F.round("accuracy", 6).alias("accuracy"), F.round("mean_ms", 6).alias("mean_ms"), F.round("cost", 6).alias("cost"))


@plan("intent_confusion", sql("SELECT arm, coalesce(expected, '-') AS expected, coalesce(predicted, '-') AS predicted, count(*) AS n FROM runs WHERE expected IS DISTINCT FROM predicted GROUP BY ALL", LANGS_SQL))
def intent_confusion(spark, folder):
    return metrics.confusion(label_runs(spark, folder), "arm").select("arm", F.coalesce("expected", F.lit("-")).alias("expected"), F.coalesce("predicted", F.lit("-")).alias("predicted"), "n")


@plan("token_cost", "SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN round(n_chars / 1e6 * 2.5 + length(source) / 1e6 * 10, 9) ELSE -1 END AS cost FROM documents")
def token_cost(spark, folder):
    cost = metrics.token_cost(F.when(F.col("doc_id") % 9 != 0, F.col("n_chars")), F.char_length("source"), 2.5, 10.0)
    return table(spark, folder, "documents").select("doc_id", F.coalesce(F.round(cost, 9), F.lit(-1.0)).alias("cost"))


# Documents' edges


@plan("edge_blob", sql("SELECT doc_id, string_agg(type || ' ' || target, ' ' ORDER BY type, target) AS blob FROM edges GROUP BY 1", EDGES_SQL))
def edge_blob(spark, folder):
    from ..operators import corpus

    return corpus.edge_blobs(edges(spark))


@plan("has_edge", sql("SELECT DISTINCT least(a.doc_id, b.doc_id) AS a, greatest(a.doc_id, b.doc_id) AS b FROM manuals a JOIN edges e ON e.doc_id = a.doc_id AND e.type IN ('corrects', 'supersedes', 'overrides', 'superseded_by', 'corrected_by') JOIN manuals b ON b.publication_number = e.target", MANUALS_SQL, EDGES_SQL))
def has_edge(spark, folder):
    from ..operators import corpus

    return corpus.precedence_pairs(manuals(spark), edges(spark))

