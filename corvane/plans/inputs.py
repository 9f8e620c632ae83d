"""Inputs that several plans share, made of whole tables: turns, answers, units with representations, pages with tables and words."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import values_sql
from .registry import table

#: What is said between the turns of a conversation, by number.
REPLIES = ("checked. those look good", "checked but still facing the issue", "ok, no issues found here", "it stops halfway through the wash", "that did not help")
REPLIES_SQL = "[" + ", ".join(f"'{r}'" for r in REPLIES) + "]"
CHECKS = "\n1. Check the drain hose and filter [1]\n2. See TEST #"
#: Conversations' turns, at even numbers, whole: every seventh with a fault code in front, a third of the answers with a list of checks; after every fifth one a short reply of the user.
TURNS_SQL = f"""turns AS (SELECT conv_id, turn * 2 AS turn, role, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'F' || conv_id % 10 || ' E' || turn % 10 || ' ' ELSE '' END || text || CASE WHEN role = 'assistant' AND (conv_id + turn) % 3 = 0 THEN '{CHECKS}'|| turn % 9 ELSE '' END AS text FROM conversations
  UNION ALL SELECT conv_id, turn * 2 + 1, 'user', ({REPLIES_SQL})[CAST((conv_id + turn) // 5 % 5 + 1 AS INTEGER)] FROM conversations WHERE (conv_id + turn) % 5 = 0)"""


def turns(spark, folder):
    c, k = table(spark, folder, "conversations"), F.col("conv_id") + F.col("turn")
    coded = F.when(k % 7 == 0, F.concat(F.lit("F"), F.col("conv_id") % 10, F.lit(" E"), F.col("turn") % 10, F.lit(" "))).otherwise("")
    listed = F.when((F.col("role") == "assistant") & (k % 3 == 0), F.concat(F.lit(CHECKS), F.col("turn") % 9)).otherwise("")
    said = c.select("conv_id", (F.col("turn") * 2).alias("turn"), "role", F.concat(coded, "text", listed).alias("text"))
    reply = F.element_at(F.array(*map(F.lit, REPLIES)), (F.floor(k / 5) % 5 + 1).cast("int"))
    return said.unionByName(c.where(k % 5 == 0).select("conv_id", (F.col("turn") * 2 + 1).alias("turn"), F.lit("user").alias("role"), reply.alias("text")))


#: Units: every document one, in its source's version; and its representations, of which every eleventh unit's were made for other content.
UNITS_SQL = """units AS (SELECT 'V' || source AS version, 'u' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS unit_key, doc_id AS ordinal, 'Unit ' || doc_id AS title, CASE doc_id % 3 WHEN 0 THEN 'procedure' WHEN 1 THEN 'table' ELSE 'other' END AS unit_type, text AS source_text, sha256(text) AS content_hash,
  CASE WHEN source LIKE '%1' OR doc_id % 17 <> 3 THEN 'approved' ELSE 'proposed' END AS review_status, doc_id % 23 = 5 AS needs_ocr FROM documents),
reps AS (SELECT version, unit_key, kind AS rep_kind, kind || ' of ' || title || '. ' || source_text AS text, CASE WHEN ordinal % 11 = 0 THEN 'older' ELSE content_hash END AS unit_content_hash, (ordinal + length(kind)) % 4 <> 0 AS embedded FROM units CROSS JOIN (SELECT unnest(['overview', 'facts', 'questions']) AS kind) WHERE ordinal % 13 <> 0)"""


def units(spark, folder):
    d, n = table(spark, folder, "documents"), F.col("doc_id")
    status = F.when(F.endswith("source", F.lit("1")) | (n % 17 != 3), "approved").otherwise("proposed")
    return d.select(
        F.concat(F.lit("V"), "source").alias("version"), F.concat(F.lit("u"), F.lpad(n.cast("string"), 7, "0")).alias("unit_key"), n.alias("ordinal"), F.concat(F.lit("Unit "), n).alias("title"),
        F.when(n % 3 == 0, "procedure").when(n % 3 == 1, "table").otherwise("other").alias("unit_type"), F.col("text").alias("source_text"), F.sha2("text", 256).alias("content_hash"),
        status.alias("review_status"), (n % 23 == 5).alias("needs_ocr"),
    )


def reps(spark, folder):
    u, n = units(spark, folder).where("ordinal % 13 <> 0"), F.col("ordinal")
    each = u.withColumn("rep_kind", F.explode(F.array(F.lit("overview"), F.lit("facts"), F.lit("questions"))))
    made_for = F.when(n % 11 == 0, "older").otherwise(F.col("content_hash"))
    text = F.concat("rep_kind", F.lit(" of "), "title", F.lit(". "), "source_text")
    return each.select("version", "unit_key", "rep_kind", text.alias("text"), made_for.alias("unit_content_hash"), ((n + F.length("rep_kind")) % 4 != 0).alias("embedded"))


#: Versions of documents: doc_id, version, strategy, status.
VERSIONS = [
    ("A", 1, "structured", "superseded"), ("A", 2, "semantic_llm", "active"), ("B", 1, "structured", "active"), ("B", 2, "semantic_llm", "candidate"), ("C", 1, "structured", "superseded"), ("C", 2, "semantic_llm", "abandoned"),
    ("D", 1, "semantic_llm", "ready"), ("E", 1, "structured", "active"), ("E", 2, "semantic_llm", "ready"), ("F", 1, "semantic_llm", "superseded"), ("F", 2, "semantic_llm", "active"), ("F", 3, "semantic_llm", "abandoned"),
]
#: The same, for each supplier.
HISTORY_SQL = values_sql("shape", "shape, version, strategy, status", VERSIONS) + """,
history AS (SELECT 'S' || s_suppkey AS doc_id, CAST(version AS INTEGER) AS version, strategy, status, 'fp' || s_suppkey AS source_fingerprint FROM supplier JOIN shape ON shape = ['A', 'B', 'C', 'D', 'E', 'F', 'G'][CAST(s_suppkey % 7 + 1 AS INTEGER)])"""


def history(spark, folder):
    """versions of documents as `operators.curation` has them; every seventh document has none."""
    shape = spark.createDataFrame(VERSIONS, "shape string, version int, strategy string, status string")
    s = table(spark, folder, "supplier").withColumn("shape", F.element_at(F.array(*map(F.lit, "ABCDEFG")), (F.col("s_suppkey") % 7 + 1).cast("int")))
    rows = s.join(F.broadcast(shape), "shape")
    none = F.lit(None).cast("int")
    return rows.select(F.concat(F.lit("S"), "s_suppkey").alias("doc_id"), "version", "strategy", "status", F.concat(F.lit("fp"), "s_suppkey").alias("source_fingerprint"), none.alias("superseded_by"), none.alias("forked_from"))


def history_docs(spark, folder):
    return table(spark, folder, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("doc_id"), F.concat(F.lit("fp"), "s_suppkey").alias("source_fingerprint"))


HEADERS = ["Problem", "Possible cause", "Checks & tests"]
#: Tables that pages have, by number: headers and rows.
TABLES = [
    (HEADERS, [["WON'T POWER UP\n• No operation\n• No keypad response", "Control lock is activated.", "Check if the control lock LED is on."], ["", "No power to washer.", "Check power at outlet, check circuit breakers."], ["", "ACU problem.", "See TEST #1: ACU Power Check, page 12."]]),
    (HEADERS, [["POOR WASH PERFORMANCE", "Please refer Use & Care Guide.", ""], ["Oversuds.", "", "1. Verify use of HE detergent. 2. Excessive detergent usage."], ["Load not rinsed.", "", "1. Check proper water supply."]]),
    (["Error Code", "Problem", "Checks & tests"], [["F5E2", "Door lock fault", "Replace the door lock"], ["F8 E1", "No water", "Check hoses"], ["", "", ""]]),
    (["Part", "Value"], [["Thermistor", "50 kOhm"], ["Valve"], ["Pump", "12 Ohm"], ["", "x"]]),
]
#: Pages' texts beside their own, by number.
GUIDES = [
    "TROUBLESHOOTING GUIDE #1\nPROBLEM POSSIBLE CAUSE CHECKS & TESTS",
    "FOR SERVICE TECHNICIAN'S USE ONLY\nTROUBLESHOOTING GUIDE #2\nPROBLEM POSSIBLE CAUSE CHECKS & TESTS\nPOOR WASH PERFORMANCE\nPlease refer Use & Care Guide.\nOversuds. 1. Verify use of HE detergent. 2. Excessive detergent usage.\nLoad not rinsed. 1. Check proper water supply. 2. Not using HE detergent.\nNot cleaning clothes. 1. Verify that load is not bunched.",
    "TEST #4: Valve\n1. Unplug the washer.\n2. Remove the panel.\n3. Measure 12 VAC.\n5. Replace the valve.\n6. Plug it in.",
    "SECTION 3 Overview",
    "TROUBLESHOOTING GUIDE #1\nPROBLEM POSSIBLE CAUSE CHECKS & TESTS\nWON'T START CYCLE\nDoor not fully closed. Check that the door is shut.\nNO BUTTON SOUND Sound is turned off. Press the volume key until it is on.",
]
TABLE_TYPE = "array<struct<headers:array<string>,rows:array<array<string>>>>"


def _table(t):
    heads, rows = t
    return F.struct(F.array(*map(F.lit, heads)).alias("headers"), F.array(*[F.array(*map(F.lit, r)) for r in rows]).alias("rows"))


def pages(spark, folder):
    """A page of every document: doc_id, page, label, text (a guide's lines and the whole text), tables, words of the whole text on a grid of ten (of two columns on every other page)."""
    n = F.col("doc_id")
    tables = _tables(n)
    text = F.concat_ws("\n", F.element_at(F.array(*map(F.lit, GUIDES)), (n % 7 % 5 + 1).cast("int")), "text")
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")

    def word(w, i):
        column, line = i % 10, F.floor(i / 10)
        x = F.when(n % 2 == 0, column * 55.0 + 30).otherwise(F.when(column < 5, column * 50.0 + 20).otherwise(column * 50.0 + 70))
        return F.struct(w.alias("text"), x.alias("x0"), (line * 12.0).alias("y0"), (x + 40.0).alias("x1"), (line * 12.0 + 10).alias("y1"))

    kind = F.element_at(F.array(*map(F.lit, ("default", "multi_column", "figure", "matrix"))), (n % 4 + 1).cast("int"))
    return table(spark, folder, "documents").select(
        n, (n % 40 + 1).cast("int").alias("page"), F.concat(F.lit("W1"), F.lpad((n % 20).cast("string"), 7, "0"), F.lit(" Rev B")).alias("label"), text.alias("text"), F.when(n % 7 != 0, F.col("lang")).alias("language"),
        tables.alias("tables"), F.transform(tokens, word).alias("words"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), kind.alias("layout_kind"), (n % 9 == 4).alias("drawn"), F.col("text").alias("body"),
    )


def _tables(n):
    """The table of every page, none of each fifth one."""
    out = F.array().cast(TABLE_TYPE)
    for i, t in enumerate(TABLES):
        out = F.when(n % 5 == i, F.array(_table(t))).otherwise(out)
    return out


def in_documents(p):
    """Pages as `operators.structured` takes them, one a document."""
    fields = ("page", "text", "language", "drawn", "tables", "words", "page_width", "page_height", "layout_kind")
    return p.select("doc_id", "label", F.array(F.struct(*fields)).alias("pages"))


#: Answers of models, by number; the text of a turn stands in some of them.
ANSWERS = [
    ('{"abstained": false, "abstain_reason": "", "answer": "Check the lock [1].", "claims": [{"text": "Check the lock", "evidence_index": 1}, {"text": " ", "evidence_index": 2}, {"text": "Then wait", "evidence_index": "2"}]}', False, "", "Check the lock [1].", "1,2", "1,2"),
    ('```json\n{"abstained": true, "abstain_reason": "no evidence", "answer": "", "claims": []}\n```', True, "no evidence", "ABSTAIN: no evidence", "", ""),
    ("ABSTAIN: not covered", True, "not covered", "ABSTAIN: not covered", "", ""),
    ("Unplug it [2]. Wait a minute! Then test [3] again", False, "", "Unplug it [2]. Wait a minute! Then test [3] again", "2,-,3", "2,3"),
    ("", True, "empty model output", "ABSTAIN: empty model output", "", ""),
    ('{"answer": "", "claims": [{"text": "Drain it", "evidence_index": 3.0}, {"text": "Look", "evidence_index": true}]}', False, "", "Drain it [3]\nLook", "3,-", "3"),
    ('{"answer": "See the hose [9]"', False, "", '{"answer": "See the hose [9]"', "9", ""),
    ("Not cleaning clothes is the trouble here", False, "", "Not cleaning clothes is the trouble here", "-", ""),
]
ANSWERS_SQL = values_sql("said", "n, raw, abstained, reason, display, cited, bound", [(i, *a) for i, a in enumerate(ANSWERS)])
CITED = "array(struct(1 as index, 'D1' as doc_id, 'W1 p.2 — Door lock / Lock' as label), struct(2 as index, 'D2' as doc_id, 'W2' as label), struct(3 as index, 'D3' as doc_id, 'W3 — POOR WASH / Not cleaning clothes' as label))"


def answers(spark, folder):
    """event_id, n and raw: a model's answer for every event."""
    e = table(spark, folder, "events").select("event_id", (F.col("event_id") % len(ANSWERS)).cast("int").alias("n"))
    return e.withColumn("raw", F.element_at(F.array(*[F.lit(a[0]) for a in ANSWERS]), F.col("n") + 1)).withColumn("available", F.expr(CITED))

