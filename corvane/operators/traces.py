"""Traces of answers: read from several shapes of JSON, classified by what went wrong, deduplicated, and reported.

traces: trace_id, name, ts, question, answer, turns, citations, abstained, abstain_code, git_sha. A failure's
fingerprint is its code and the question; of one fingerprint the first trace counts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intent, texts
from . import expansion
from .rows import map_rows, settled

# What gives a failure away.
INVENTED_KNOB = r"(?i)cycle selector|turn the cycle|to the \"Off\"|to \"Normal\"|Start/Pause.{0,40}3 seconds"
DIAGNOSTIC = r"(?i)diagnostic|service diagnostic"
PROCEDURAL = r"(?i)\b(follow these steps|press and hold|enter the|activate)\b"
ASSERTED = r"(?i)\b(you have|showing|display shows|error code)\s+F5\s*E?2\b|\bF5\s*E?2\s+(is|means|indicates)\b"
WRONG_POLARITY = r"(?i)won'?t lock|will not lock|door not closed|Ensure that door is completely closed"
SKIPS_CLARIFYING = r"(?i)test\s*#\s*4|replace the door lock"
# Codes in order, and rules that a replay of each is held to.
CODES = ("invented_diag_entry", "clarify_as_abstain", "wrong_polarity", "skip_clarify", "empty_cites_procedure", "plan_code_as_fact")
CLARIFY = {"expect_contains_any": ["stuck", "unlock", "lock", "F5E2", "open", "closed"], "fails_if_contains": ["replace the door lock", "test #4", "TEST #4"]}
RULES = {
    "invented_diag_entry": {
        "expect_cites_any": ["W11169652"], "expect_contains_any": ["Service Diagnostic", "diagnostic mode", "888", "three (3) buttons", "three buttons"],
        "fails_if_contains": ["cycle selector", 'to "Normal"'],
    },
    "wrong_polarity": {"expect_contains_any": ["unlock", "open", "Add Garment", "pause"], "fails_if_contains": ["won't lock", "will not lock", "Ensure that door is completely closed"]},
    "clarify_as_abstain": CLARIFY,
    "skip_clarify": CLARIFY,
    "empty_cites_procedure": {"expect_cites_any": ["W11169652", "W11320651", "W11156989", "W11156985"], "fails_if_contains": ["follow these steps"]},
    "plan_code_as_fact": {"expect_contains_any": ["If", "if you", "possible", "may"], "fails_if_contains": ["you have F5E2", "showing F5E2"]},
}
RULE_NAMES = ("expect_cites_any", "expect_contains_any", "fails_if_contains")
# The report's sections, and the length that long trace values are cut to.
SECTIONS = (
    ("actionable", "Actionable (still fails on current code)"), ("resolved_stale", "Resolved stale (fixed on replay — no action needed)"),
    ("covered", "Already covered by ready fixtures"), ("skipped", "Skipped"),
)
TRACE_CHARS, QUESTION_CHARS = 12_000, 120

RECORD = "trace_id string, name string, ts string, question string, answer string, turns array<string>, citations array<string>, abstained boolean, abstain_code string, git_sha string"
QUESTION_KEYS, ANSWER_KEYS = ("question", "user_message", "message"), ("answer", "answer_preview", "assistant_message", "content")
CITATION_KEYS = ("doc_id", "label", "publication_number")


def _loose(value):
    """JSON in text becomes what it says; other values stay."""
    if isinstance(value, str) and value.strip()[:1] in ("{", "["):
        try:
            return json.loads(value.strip())
        except (json.JSONDecodeError, RecursionError):
            return value
    return value


def _one_of(value, keys: tuple[str, ...]) -> str:
    if isinstance(value, dict):
        return next((str(value[k]) for k in keys if value.get(k)), "")
    return value if isinstance(value, str) else ""


def _sha(value) -> str | None:
    """A stamp as text; one that was read as a number can't be restored, but counts as a stamp."""
    if value is None or value == "" or isinstance(value, bool):
        return None
    return f"numeric-corrupt:{value:.6g}" if isinstance(value, float) else str(value).strip() or None


def read_trace(raw: str | None) -> dict | None:
    """A record of a trace as JSON, with its observations' values where it has none; None for what says nothing."""
    data = _loose(raw)
    if not isinstance(data, dict):
        return None
    trace_id = str(data.get("id") or data.get("trace_id") or data.get("traceId") or "")
    parts = [data, *(o for o in data.get("observations") or [] if isinstance(o, dict))]
    ins, outs = ([_loose(p.get(k)) for p in parts] for k in ("input", "output"))
    question = next((q for q in (_one_of(x, QUESTION_KEYS) if i == 0 or isinstance(x, dict) else "" for i, x in enumerate(ins)) if q), "")
    answers = [_one_of(x, ANSWER_KEYS) if i == 0 or isinstance(x, dict) else "" for i, x in enumerate(outs)]
    at = next((i for i, a in enumerate(answers) if a), 0)
    answer, out = answers[at], outs[at] if isinstance(outs[at], dict) else {}
    first = outs[0] if isinstance(outs[0], dict) else {}
    cited = [c if isinstance(c, str) else _one_of(c, CITATION_KEYS) if isinstance(c, dict) else str(c) for x in ([first] if at == 0 else [first, out]) for c in (x.get("citations") if isinstance(x.get("citations"), list) else [])]
    turns = [str(t) for t in ins[0].get("turns") or []] if isinstance(ins[0], dict) else []
    meta: dict = {}
    for p in reversed(parts):
        meta |= p["metadata"] if isinstance(p.get("metadata"), dict) else {}
    names = [str(p.get("name") or "") for p in parts]
    name = names[0] or next((n for n in names[1:] if n in ("ask", "diagnose")), "") or "ask"
    if not trace_id or not (question or answer):
        return None
    ts = next((str(data[k]) for k in ("timestamp", "createdAt", "start_time", "startTime", "created_at", "ts") if data.get(k)), "")
    return {
        "trace_id": trace_id, "name": name, "ts": ts, "question": question or (turns[0] if turns else ""), "answer": answer, "turns": turns, "citations": [c for c in cited if c],
        "abstained": bool(first.get("abstained")), "abstain_code": str(first.get("abstain_code") or ""), "git_sha": _sha(meta.get("app_git_sha")),
    }


def normalised(raw: DataFrame, column: str = "value") -> DataFrame:
    """RECORD for each trace in a column of JSON that says something."""
    return map_rows(raw.select(column), lambda r: [t for t in [read_trace(r[column])] if t], RECORD)


def newest(traces: DataFrame, limit: int) -> DataFrame:
    """The newest traces, of asks and of dialogues a half of the limit at most each, so that neither starves the other."""
    half = max(1, (limit + 1) // 2)
    order = Window.partitionBy("name").orderBy(F.desc("ts"), "trace_id")
    once = traces.dropDuplicates(["trace_id"])
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= half).drop("r").orderBy(F.desc("ts"), "trace_id").limit(limit)


def stamped(traces: DataFrame, sha: str | None = None, require: bool = True) -> DataFrame:
    """Traces with a stamp (or, without `require`, any), and where a stamp is asked for, none with another."""
    out = traces.where("git_sha is not null") if require else traces
    return out if sha is None else out.where(F.col("git_sha").isNull() | (F.col("git_sha") == sha))


def since(spec: Column, now: Column) -> Column:
    """The moment that 7d, 24h or 30m before `now` is; null for other forms."""
    x = F.lower(F.trim(F.coalesce(spec, F.lit("7d"))))
    n, unit = F.regexp_extract(x, r"^(\d+)\s*([dhm])$", 1), F.regexp_extract(x, r"^(\d+)\s*([dhm])$", 2)
    n = F.nullif(n, F.lit("")).cast("int")
    part = lambda u: F.when(unit == u, n).otherwise(F.lit(0))
    return F.when(n.isNotNull(), now - F.make_dt_interval(part("d"), part("h"), part("m")))


def failure_codes(question: Column, answer: Column, citations: Column, abstained: Column) -> Column:
    """What went wrong in an answer, by its words, in order."""
    q, a = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    low, up = F.lower(a), F.upper(q)
    refuses = F.startswith(F.upper(F.ltrim(a)), F.lit("ABSTAIN:"))
    uncited = F.size(F.coalesce(citations, F.array().cast("array<string>"))) == 0
    named = F.contains(up, F.lit("F5E2")) | F.contains(up, F.lit("F5 E2")) | F.contains(F.substring(low, 1, 80), F.lit("if "))

    def read(polarity: Column) -> Column:
        unclear = expansion.unclear(q, polarity)
        tests = {
            "invented_diag_entry": a.rlike(INVENTED_KNOB) & a.rlike(DIAGNOSTIC),
            "clarify_as_abstain": refuses & (unclear | F.contains(low, F.lit("error code")) | F.contains(low, F.lit("door lock"))),
            "wrong_polarity": F.coalesce(polarity == "unlock", F.lit(False)) & a.rlike(WRONG_POLARITY), "skip_clarify": unclear & ~refuses & a.rlike(SKIPS_CLARIFYING),
            "empty_cites_procedure": a.rlike(PROCEDURAL) & uncited & ~F.coalesce(abstained, F.lit(False)), "plan_code_as_fact": a.rlike(ASSERTED) & ~named,
        }
        return F.array_compact(F.array(*[F.when(tests[c], F.lit(c)) for c in CODES]))

    return intent.once(expansion.polarity(q), read)


def rules_for(code: Column, question: Column) -> Column:
    """The rules that a replay of a failure is held to, as a struct of RULE_NAMES; for other codes the question's beginning must come back."""
    text = lambda xs: F.array(*map(F.lit, xs)) if xs else F.lit(None).cast("array<string>")
    made = lambda r: F.struct(*[text(r.get(n)).alias(n) for n in RULE_NAMES])
    start = F.array(F.coalesce(F.nullif(F.substring(question, 1, 20), F.lit("")), F.lit(".")))
    out = F.struct(text(None).alias(RULE_NAMES[0]), start.alias(RULE_NAMES[1]), text(None).alias(RULE_NAMES[2]))
    for name, rules in RULES.items():
        out = F.when(code == name, made(rules)).otherwise(out)
    return out


def question_key(text: Column) -> Column:
    return F.lower(texts.collapse(text))


def covered_questions(scenarios: DataFrame) -> DataFrame:
    """question: what ready scenarios(status, question, turns) ask, in lower case with single spaces."""
    ready = scenarios.where("status = 'ready'")
    said = F.concat(F.array("question"), F.coalesce("turns", F.array().cast("array<string>")))
    each = ready.select(F.explode(F.filter(said, lambda x: F.coalesce(x, F.lit("")) != "")).alias("q"))
    return each.select(question_key(F.col("q")).alias("question")).distinct()


def mined(traces: DataFrame, covered: DataFrame, replayed: DataFrame | None = None) -> DataFrame:
    """trace_id, code, fingerprint, question, outcome, detail for each failure of each trace, in order of `ord`.

    traces: with ord (their order). covered: question. replayed (trace_id, code, passed, detail): what running the
    question again gave; without it a failure counts as still there.
    """
    t = settled(traces.select("trace_id", "ord", "question", failure_codes(F.col("question"), F.col("answer"), F.col("citations"), F.col("abstained")).alias("codes")))
    none = t.where(F.size("codes") == 0).select("trace_id", "ord", F.lit(None).cast("string").alias("code"), F.lit("").alias("fingerprint"), "question", F.lit("skipped").alias("outcome"), F.lit("no failure rules").alias("detail"))
    each = t.select("trace_id", "ord", "question", F.posexplode("codes").alias("at", "code")).withColumn("fingerprint", texts.trace_fingerprint(F.col("code"), F.col("question")))
    # the first of a fingerprint by an aggregation, since one may be that of most traces
    at = F.struct("ord", "trace_id", "at")
    first = each.groupBy("fingerprint").agg(F.min(at).alias("first"))
    each = each.join(first, "fingerprint").withColumn("again", at != F.col("first"))
    each = each.join(covered.select("question", F.lit(True).alias("held")).withColumnRenamed("question", "key"), question_key(F.col("question")) == F.col("key"), "left")
    if replayed is None:
        each = each.withColumn("passed", F.lit(False)).withColumn("said", F.lit("replay skipped"))
    else:
        each = each.join(replayed.select("trace_id", "code", "passed", F.col("detail").alias("said")), ["trace_id", "code"], "left")
    outcome = F.when(F.col("again"), "skipped").when(F.col("held"), "covered").when(F.col("passed"), "resolved_stale").otherwise("actionable")
    detail = F.when(F.col("again"), "fingerprint already noted in this run").when(F.col("held"), "ready fixture already covers question").otherwise(F.col("said"))
    return each.select("trace_id", "ord", "code", "fingerprint", "question", outcome.alias("outcome"), detail.alias("detail")).unionByName(none)


def report(outcomes: DataFrame) -> DataFrame:
    """place and line: a report in Markdown, of counts by outcome and then every outcome in its section."""
    counts = outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("outcome", "n"))), lambda c: F.concat(F.lit("**"), c["outcome"], F.lit("**="), c["n"])), ", ").alias("line"))
    head = total.select(F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("o"), F.lit("").alias("t"), F.lit("").alias("c")).alias("place"), F.coalesce(F.nullif("line", F.lit("")), F.lit("No traces after filters.")).alias("line"))
    spark = outcomes.sparkSession
    sections = spark.createDataFrame([(i, s, f"## {h}") for i, (s, h) in enumerate(SECTIONS, 1)], "s int, outcome string, heading string")
    heads = sections.select(F.struct("s", F.lit(-1).cast("long").alias("o"), F.lit("").alias("t"), F.lit("").alias("c")).alias("place"), F.col("heading").alias("line"))
    said = F.concat(F.lit("- **trace** `"), "trace_id", F.lit("` · codes=`"), F.coalesce("code", F.lit("—")), F.lit("` · "), F.coalesce("detail", F.lit("")), F.lit(" · "), F.substring(F.coalesce("question", F.lit("")), 1, QUESTION_CHARS))
    rows = outcomes.join(F.broadcast(sections), "outcome").select(F.struct("s", F.col("ord").cast("long").alias("o"), F.col("trace_id").alias("t"), F.coalesce("code", F.lit("")).alias("c")).alias("place"), said.alias("line"))
    return head.unionByName(heads).unionByName(rows).orderBy("place").select("place", "line")


def truncated(value: Column, most: int = TRACE_CHARS) -> Column:
    """A long text cut, with a note of its length."""
    return F.when(F.char_length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, most - 20), F.lit("... ["), F.char_length(value), F.lit(" chars total]")))


def truncate_json(raw: DataFrame, keys: list[str], column: str = "value", most: int = TRACE_CHARS) -> DataFrame:
    """keys and the column with every long text anywhere in its JSON cut."""

    def cut(x):
        if isinstance(x, str):
            return x if len(x) <= most else f"{x[: most - 20]}... [{len(x)} chars total]"
        if isinstance(x, dict):
            return {k: cut(v) for k, v in x.items()}
        return [cut(v) for v in x] if isinstance(x, list) else x

    def run(r: dict) -> list[dict]:
        data = _loose(r[column])
        return [{k: r[k] for k in keys} | {column: cut(data) if isinstance(data, str) or data is None else json.dumps(cut(data), ensure_ascii=False)}]

    types = ", ".join(f"{k} {raw.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(raw.select(*keys, column), run, f"{types}, {column} string")
