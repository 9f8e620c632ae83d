"""Plans of boards, replies, transcripts and what is searched for next."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parsing, replies
from ..operators import dialogue, expansion, sessions
from .base import sql
from .helpers import family_sql
from .inputs import TURNS_SQL, turns
from .registry import plan, table


def short_sql(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def says_sql(x: str, pattern: str) -> str:
    return f"({short_sql(x)} <> '' AND length({short_sql(x)}) <= {replies.LONGEST} AND regexp_matches({short_sql(x)}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


ACK = says_sql("text", replies.ACK)
UNRESOLVED = f"({says_sql('text', replies.UNRESOLVED)} AND NOT {ACK})"
PROGRESS = f"({ACK} OR {UNRESOLVED})"
CODES_SQL = r"list_transform(regexp_extract_all({x}, '(?i)\bF\s*[0-9]\s*E\s*[0-9]\b', 0), lambda c: upper(regexp_replace(c, '\s+', '', 'g')))"
TESTS_SQL = r"list_transform(regexp_extract_all({x}, '(?i)\btest\s*#\s*(\d+)\b', 1), lambda n: 'test #' || n)"


@plan("is_ack", sql(f"SELECT conv_id, turn, {ACK} AS ack FROM turns", TURNS_SQL))
def is_ack(spark, folder):
    return turns(spark, folder).select("conv_id", "turn", replies.is_ack(F.col("text")).alias("ack"))


@plan("is_unresolved", sql(f"SELECT conv_id, turn, {UNRESOLVED} AS unresolved FROM turns", TURNS_SQL))
def is_unresolved(spark, folder):
    return turns(spark, folder).select("conv_id", "turn", replies.is_unresolved(F.col("text")).alias("unresolved"))


@plan("is_progress", sql(f"SELECT conv_id, turn, {PROGRESS} AS progress FROM turns", TURNS_SQL))
def is_progress(spark, folder):
    return turns(spark, folder).select("conv_id", "turn", replies.is_progress(F.col("text")).alias("progress"))


@plan("regex_label", sql(f"SELECT conv_id, turn, CASE WHEN {ACK} THEN 'ack' WHEN {UNRESOLVED} THEN 'still_unresolved' ELSE '-' END AS label FROM turns WHERE role = 'user'", TURNS_SQL))
def regex_label(spark, folder):
    return turns(spark, folder).where("role = 'user'").select("conv_id", "turn", F.coalesce(replies.reply_label(F.col("text")), F.lit("-")).alias("label"))


MID = family_sql("text", "mid_cycle_stop")
SAID_SQL = f"""said AS (SELECT conv_id, turn, text, {PROGRESS} AS p, {MID} AS mid, bool_and({PROGRESS}) OVER (PARTITION BY conv_id) AS every, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, row_number() OVER (PARTITION BY conv_id, {PROGRESS} ORDER BY turn DESC) AS own FROM turns WHERE role = 'user'),
asked AS (SELECT conv_id, list_sort(list_distinct(flatten(list({CODES_SQL.format(x='text')})))) AS codes, trim(coalesce(min_by(text, turn) FILTER (NOT p), min_by(text, turn))) AS anchor, coalesce(min_by(mid, turn) FILTER (NOT p), min_by(mid, turn)) AS anchor_mid,
  trim(max_by(text, turn)) AS latest, max_by(p, turn) AS late, max_by(mid, turn) AS latest_mid, trim(string_agg(text, ' ' ORDER BY turn) FILTER (CASE WHEN every THEN back <= 3 ELSE NOT p AND own <= 3 END)) AS recent FROM said GROUP BY 1)"""


@plan("session_query", sql("SELECT conv_id, trim(concat_ws(' ', nullif(array_to_string(codes, ' '), ''), CASE WHEN latest_mid AND NOT anchor_mid THEN latest WHEN late THEN anchor ELSE recent END)) AS query FROM asked", TURNS_SQL, SAID_SQL))
def session_query(spark, folder):
    return sessions.session_query(turns(spark, folder))


@plan("query_for_label", sql("""SELECT conv_id, trim(concat_ws(' ', nullif(array_to_string(codes, ' '), ''), CASE WHEN latest_mid THEN latest ELSE anchor END)) AS query FROM asked""", TURNS_SQL, SAID_SQL))
def query_for_label(spark, folder):
    user = turns(spark, folder).where("role = 'user'")
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    s = user.groupBy("conv_id").agg(rows.alias("t"))
    real = F.filter("t", lambda x: ~replies.is_progress(x["text"]))
    anchor = F.trim(F.coalesce(F.get(real, F.lit(0))["text"], F.get("t", F.lit(0))["text"]))
    latest = F.element_at("t", -1)["text"]
    label = F.when(expansion.matches_family(latest, "mid_cycle_stop"), "mid_cycle_stop").otherwise(replies.reply_label(latest))
    said = dialogue.session_codes(F.transform("t", lambda x: x["text"]))
    return s.select("conv_id", dialogue.query_for_label(F.coalesce(label, F.lit("unclear")), anchor, F.trim(latest), said).alias("query"))


@plan("session_codes", sql(f"SELECT conv_id, array_to_string(list_sort(list_distinct(flatten(list({CODES_SQL.format(x='text')})))), ',') AS codes FROM turns GROUP BY 1", TURNS_SQL))
def session_codes(spark, folder):
    return turns(spark, folder).groupBy("conv_id").agg(F.array_join(dialogue.session_codes(F.collect_list("text")), ",").alias("codes"))


@plan("turn_limit", sql("SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM turns WHERE role = 'user') WHERE place <= 3", TURNS_SQL))
def turn_limit(spark, folder):
    return sessions.within_limit(turns(spark, folder), 3).select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@plan("prior_assistant", sql("SELECT conv_id, turn, coalesce(prior, '') AS prior FROM (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM turns) WHERE role = 'user'", TURNS_SQL))
def prior_assistant(spark, folder):
    return sessions.prior_assistant(turns(spark, folder)).select("conv_id", "turn", F.coalesce("prior", F.lit("")).alias("prior"))


LINES, CHARS = 6, 2_000
TRANSCRIPT_SQL = f"""lines AS (SELECT conv_id, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM turns WHERE role IN ('user', 'assistant')),
whole AS (SELECT conv_id, CASE WHEN n <= {LINES} THEN string_agg(line, chr(10) ORDER BY i) ELSE min_by(line, i) || chr(10) || '(… ' || (n - {LINES}) || ' earlier lines omitted …)' || chr(10) || string_agg(line, chr(10) ORDER BY i) FILTER (i > n - {LINES - 1}) END AS t FROM lines GROUP BY conv_id, n)"""


@plan("transcript_window", sql(rf"SELECT conv_id, CASE WHEN length(t) <= {CHARS} THEN t ELSE regexp_replace(substr(t, 1, {CHARS - 20}), '\s+$', '') || chr(10) || '(… truncated …)' END AS transcript FROM whole", TURNS_SQL, TRANSCRIPT_SQL))
def transcript_window(spark, folder):
    t = turns(spark, folder).where("role in ('user', 'assistant')").withColumn("line", F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return t.groupBy("conv_id").agg(lines.alias("lines")).select("conv_id", dialogue.transcript(F.col("lines"), LINES, CHARS).alias("transcript"))


@plan("procedure_needles", sql(f"SELECT conv_id, turn, array_to_string({TESTS_SQL.format(x='text')}, ',') AS needles FROM turns", TURNS_SQL))
def procedure_needles(spark, folder):
    return turns(spark, folder).select("conv_id", "turn", F.array_join(dialogue.test_numbers(F.col("text")), ",").alias("needles"))


def boards(spark, folder):
    """Every conversation's board; the turns' labels are those of their words, and a stop in mid-cycle."""
    t, x = turns(spark, folder), F.col("text")
    label = F.when(F.col("role") == "user", F.when(expansion.matches_family(x, "mid_cycle_stop"), "mid_cycle_stop").otherwise(replies.reply_label(x)))
    report = F.when((F.col("role") == "user") & (F.col("turn") % 6 == 2), F.lit('{"phase": "next_step", "hypotheses": ["door lock"], "next_check": "See TEST #4", "observations": ["LED is off"]}'))
    return dialogue.fold_boards(t.withColumn("label", label).withColumn("diagnostic", report))


@plan("board_fold")
def board_fold(spark, folder):
    return boards(spark, folder)


@plan("board_helpers")
def board_helpers(spark, folder):
    """Distinct observations and checks of the boards, with the labels that a reader sees."""
    b = boards(spark, folder)
    return b.select("conv_id", F.explode("ruled_out").alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("boards"))


def last_answers(spark, folder):
    return turns(spark, folder).where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("assistant"))


@plan("board_tally")
def board_tally(spark, folder):
    cite = F.array(F.struct(F.lit(1).alias("index"), F.lit("W1 p.2").alias("label"), F.concat(F.lit("D"), "conv_id").alias("doc_id"), F.lit(2).alias("page")))
    return dialogue.with_tally(boards(spark, folder).join(last_answers(spark, folder), "conv_id", "left").withColumn("citations", cite))


@plan("tally_segments")
def tally_segments(spark, folder):
    return dialogue.with_segments(boards(spark, folder))


@plan("format_board")
def format_board(spark, folder):
    c = F.col
    text = dialogue.board_text(c("step"), c("phase"), c("symptom_anchor"), F.transform("symptom_path", lambda s: s["text"]), c("hypotheses"), c("ruled_out"), c("next_check"))
    return boards(spark, folder).select("conv_id", text.alias("board"))


DONE_SQL = f"""tests AS (SELECT conv_id, coalesce(flatten(list({TESTS_SQL.format(x='text')}) FILTER (role = 'assistant')), []) AS asked, coalesce(flatten(list({TESTS_SQL.format(x='text')}) FILTER (role = 'assistant' AND turn < 6)), []) AS done FROM turns GROUP BY 1)"""


@plan("exhausted_close", sql("SELECT conv_id, len(asked) > 0 AND list_has_all(done, asked) AS closed FROM tests", TURNS_SQL, DONE_SQL))
def exhausted_close(spark, folder):
    said = F.when(F.col("role") == "assistant", F.col("text"))
    g = turns(spark, folder).groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") < 6, said)).alias("ruled_out"), F.array_join(F.collect_list(said), "\n").alias("evidence"))
    return g.select("conv_id", dialogue.exhausted(F.col("ruled_out"), F.col("evidence")).alias("closed"))


@plan("demote_texts", sql(f"""SELECT conv_id, array_to_string(list_concat(flatten(coalesce(list(list_concat([trim(text)], {TESTS_SQL.format(x='text')}) ORDER BY turn) FILTER (role = 'user'), [])), coalesce(list_concat([trim(max_by(text, turn) FILTER (role = 'assistant'))], {TESTS_SQL.format(x="max_by(text, turn) FILTER (role = 'assistant')")}), [])), '|') AS texts FROM turns GROUP BY 1""", TURNS_SQL))
def demote_texts(spark, folder):
    user = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"])
    g = turns(spark, folder).groupBy("conv_id").agg(user.alias("ruled"), F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("asked"))
    return g.select("conv_id", F.array_join(dialogue.demoted_texts(F.col("ruled"), F.col("asked"), F.array().cast("array<string>")), "|").alias("texts"))


STICK_SQL = rf"""shown AS (SELECT conv_id AS query_id, turn AS rank, 'D' || turn % 4 AS doc_id, text, 1.0 / (turn + 1) AS score, {TESTS_SQL.format(x='text')} AS t FROM turns WHERE role = 'assistant'),
marked AS (SELECT *, CASE WHEN list_has_any(t, ['test #3', 'test #6']) OR contains(lower({short_sql('text')}), 'check the drain hose and filter') THEN 2 WHEN doc_id = 'D2' THEN 0 ELSE 1 END AS bucket FROM shown)"""


@plan("stick_hits", sql("SELECT query_id, rank, bucket, row_number() OVER (PARTITION BY query_id ORDER BY bucket, score DESC, rank) AS place FROM marked", TURNS_SQL, STICK_SQL))
def stick_hits(spark, folder):
    t = turns(spark, folder).where("role = 'assistant'")
    hits = t.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat(F.lit("D"), F.col("turn") % 4).alias("doc_id"), "text", (1.0 / (F.col("turn") + 1)).alias("score"))
    s = dialogue.stick_hits(hits, F.array(F.lit("D2")), F.array(F.lit("test #3"), F.lit("TEST # 6"), F.lit("Check the drain hose  and filter"), F.lit("short")))
    return s.select("query_id", "rank", "bucket", F.col("place").cast("long").alias("place"))


REUSE_SQL = f"""SELECT conv_id, turn, had AND NOT {MID} AND {PROGRESS} AS reuses FROM (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS had FROM turns) WHERE role = 'user'"""


@plan("evidence_reuse", sql(REUSE_SQL, TURNS_SQL))
def evidence_reuse(spark, folder):
    x = F.col("text")
    before = F.count(F.when(F.col("role") == "assistant", 1)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    label = F.when(expansion.matches_family(x, "mid_cycle_stop"), "mid_cycle_stop").otherwise(replies.reply_label(x))
    t = turns(spark, folder).withColumn("had", before > 0).where("role = 'user'")
    return t.select("conv_id", "turn", dialogue.reuses_evidence(label, x, F.col("had")).alias("reuses"))


LABELS = ("ack", "still_unresolved", "mid_cycle_stop", "new_symptom", "unclear")
SAID = ('{"label": "ack"}', "still_unresolved", '```json\n{"label": "new_symptom"}\n```', "Ack", '{"label": "other"}', "unclear", "mid_cycle_stop.", '{"label": 3')
READ = ("ack", "still_unresolved", "new_symptom", "-", "-", "unclear", "-", "-")
READ_SQL = "[" + ", ".join(f"'{r}'" for r in READ) + "]"


@plan("label_parse", f"SELECT event_id, ({READ_SQL})[CAST(event_id % 8 + 1 AS INTEGER)] AS label FROM events")
def label_parse(spark, folder):
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, folder, "events").select("event_id", F.coalesce(parsing.model_label(said, LABELS), F.lit("-")).alias("label"))


@plan("choice_parse", "SELECT event_id, CASE WHEN event_id % 3 <> 1 AND CAST(json_extract_string(props, '$.k') AS INTEGER) >= 60 THEN 'ack' ELSE '-' END AS label FROM events")
def choice_parse(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int") / 100.0
    kind = F.when(F.col("event_id") % 3 == 1, "text").otherwise("choice")
    answer = F.to_json(F.struct(F.struct(F.struct(kind.alias("type"), F.lit("ack").alias("choice"), k.alias("confidence")).alias("retrieve_label")).alias("answers")))
    return table(spark, folder, "events").select("event_id", F.coalesce(parsing.confident_choice(answer, LABELS, 0.6), F.lit("-")).alias("label"))


LAST_IDS_SQL = sql(
    "SELECT conv_id, coalesce(string_agg(d, ',' ORDER BY t), '') AS docs FROM (SELECT conv_id, nullif(trim(doc), '') AS d, min(turn) AS t FROM "
    "(SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN ' ' ELSE 'D' || length(text) % 4 END AS doc FROM turns WHERE role = 'assistant') GROUP BY 1, 2) GROUP BY 1",
    TURNS_SQL,
)


@plan("last_doc_ids", LAST_IDS_SQL)
def last_doc_ids(spark, folder):
    from ..operators import evidence

    doc = F.when(F.col("turn") % 3 == 1, " ").otherwise(F.concat(F.lit("D"), F.char_length("text") % 4))
    cites = turns(spark, folder).where("role = 'assistant'").select("conv_id", "turn", doc.alias("doc_id"))
    return evidence.first_ids(cites, "conv_id", "turn", "doc_id").select("conv_id", F.array_join("ids", ",").alias("docs"))

