"""Grading of answers and turns by scenarios' rules, and drafts of rules from failures.

A scenario's rules are columns (arrays of texts, a phase, a truth value). An answer passes if no rule fails; the
failures are told in the order of the rules. Overlays extend a scenario: lists are joined, other values replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes

# The rules that need no judge, in order, and words that own up to an older edition.
TEXT_RULES = ("expect_contains", "expect_contains_any", "expect_cites_any", "must_cite", "must_not_cite", "must_not_cite_as_current", "fails_if_contains", "expect_ruled_out_any", "expect_hypotheses_any")
RULES = ("must_cite", "must_not_cite", "must_not_cite_as_current", "expect_contains", "expect_contains_any", "expect_cites_any", "fails_if_contains", "expect_abstain", "expect_phase", "expect_ruled_out_any", "expect_hypotheses_any")
SUPERSESSION = (
    r"(?i)\b(superseded|no longer current|previous (?:revision|manual|edition|version)|"
    r"replaced by|older (?:manual|revision|edition)|not (?:the )?current)\b"
)
# What makes a phrase of an answer worth proposing.
PHRASE = r"\b(?:F\dE\d|W\d{8}|TEST #\d+[a-z]?|[A-Za-z][A-Za-z0-9-]{3,})\b"
PHRASES, PROPOSED, EXCERPT = 6, 4, 400

TEXTS = "array<string>"


def _texts(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(TEXTS))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), x, F.lit("'"))


def _listed(xs: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(xs, _quoted), ", "), F.lit("]"))


def cites(citations: Column, wanted: Column) -> Column:
    """Whether one of the citations satisfies a wanted one."""
    return F.exists(citations, lambda c: codes.matches_citation(c, wanted))


def failures(rules: dict[str, Column], answer: Column, citations: Column, abstained: Column, phase: Column, ruled_out: Column, hypotheses: Column, hard: Column | None = None) -> Column:
    """What an answer fails, in order. rules: a column for each of RULES; missing ones don't apply. hard: a failure of grounding, or null."""
    low, cited = F.lower(F.coalesce(answer, F.lit(""))), _texts(citations)
    r = {k: _texts(rules[k]) if k in rules else F.array().cast(TEXTS) for k in TEXT_RULES}
    holds = lambda hay: lambda p: F.contains(hay, F.lower(p))
    said = lambda xs: F.lower(F.array_join(_texts(xs), " "))
    none = F.array().cast(TEXTS)

    def one(condition: Column, text: Column | str) -> Column:
        return F.when(condition, F.array(F.lit(text) if isinstance(text, str) else text)).otherwise(none)

    def each(name: str, bad, text) -> Column:
        return F.transform(F.filter(r[name], bad), text)

    def any_of(name: str, good, got: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name} missing one of "), _listed(r[name]), *([] if got is None else [F.lit("; got "), got]))
        return one((F.size(r[name]) > 0) & ~F.exists(r[name], good), text)

    want = rules.get("expect_phase", F.lit(None).cast("string"))
    wrong_phase = (F.coalesce(want, F.lit("")) != "") & ~F.coalesce(phase, F.lit("")).eqNullSafe(want)
    parts = [
        one(F.coalesce(rules.get("expect_abstain", F.lit(False)), F.lit(False)) & ~abstained, "expected abstention"),
        each("expect_contains", lambda p: ~holds(low)(p), lambda p: F.concat(F.lit("missing "), _quoted(p))),
        any_of("expect_contains_any", holds(low)),
        any_of("expect_cites_any", lambda p: cites(cited, p), _listed(cited)),
        each("must_cite", lambda p: ~cites(cited, p), lambda p: F.concat(F.lit("must_cite missing "), _quoted(p), F.lit("; got "), _listed(cited))),
        each("must_not_cite", lambda p: cites(cited, p), lambda p: F.concat(F.lit("must_not_cite hit "), _quoted(p))),
        each("must_not_cite_as_current", lambda p: cites(cited, p) & ~F.coalesce(answer, F.lit("")).rlike(SUPERSESSION), lambda p: F.concat(F.lit("must_not_cite_as_current hit "), _quoted(p))),
        F.when(abstained, none).otherwise(each("fails_if_contains", holds(low), lambda p: F.concat(F.lit("fails_if matched "), _quoted(p)))),
        none if hard is None else F.when(hard.isNotNull() & ~abstained, F.array(hard)).otherwise(none),
        one(wrong_phase, F.concat(F.lit("expect_phase "), _quoted(want), F.lit("; got "), F.coalesce(_quoted(phase), F.lit("None")))),
        any_of("expect_ruled_out_any", holds(said(ruled_out)), _listed(_texts(ruled_out))),
        any_of("expect_hypotheses_any", holds(said(hypotheses)), _listed(_texts(hypotheses))),
    ]
    return F.concat(*parts)


def graded(answers: DataFrame, hard: Column | None = None) -> DataFrame:
    """`answers` with passed and detail. Columns: answer, citations, abstained, phase, ruled_out, hypotheses, and rules of RULES."""
    rules = {k: F.col(k) for k in RULES if k in answers.columns}
    found = failures(rules, F.col("answer"), F.col("citations"), F.coalesce("abstained", F.lit(False)), F.col("phase"), F.col("ruled_out"), F.col("hypotheses"), hard)
    out = answers.withColumn("failures", found)
    return out.withColumn("passed", F.size("failures") == 0).withColumn("detail", F.when(F.size("failures") == 0, "ok").otherwise(F.array_join("failures", "; "))).drop("failures")


def grade_turns(scenarios: DataFrame, turns: DataFrame, hard: Column | None = None) -> DataFrame:
    """scenario_id, passed, detail. scenarios: scenario_id, turn (null: the expected one, else the last), and rules; turns: scenario_id, turn, and an answer's columns.

    A scenario with rules for several turns has a row for each; it passes if all of them do.
    """
    last = turns.groupBy("scenario_id").agg(F.max("turn").alias("last_"))
    wanted = scenarios.withColumn("own_", F.col("turn").isNotNull()).join(last, "scenario_id", "left").withColumn("turn", F.coalesce("turn", "last_"))
    both = wanted.join(turns, ["scenario_id", "turn"], "left")
    there = turns.select("scenario_id", "turn", F.lit(True).alias("there_")).distinct()
    each = graded(both, hard).join(there, ["scenario_id", "turn"], "left")
    detail = F.when(F.col("last_").isNull(), "no turns recorded").when(F.col("there_").isNull(), "missing").when(~F.col("passed"), F.col("detail"))
    each = each.select("scenario_id", "turn", F.when(F.col("own_") & F.col("last_").isNotNull(), F.concat(F.lit("turn "), "turn", F.lit(": "), detail)).otherwise(detail).alias("d"))
    bad = F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("turn", "d"))))
    out = each.groupBy("scenario_id").agg(bad.alias("b"))
    return out.select("scenario_id", (F.size("b") == 0).alias("passed"), F.when(F.size("b") == 0, "ok").otherwise(F.array_join(F.transform("b", lambda x: x["d"]), "; ")).alias("detail"))


def has_rule(rules: dict[str, Column]) -> Column:
    """Whether one of the rules says anything: a list with items, a truth value that is true, a text that isn't empty."""
    out = F.lit(False)
    for name, c in rules.items():
        if name in TEXT_RULES:
            out = out | (F.size(_texts(c)) > 0)
        elif name == "expect_abstain":
            out = out | F.coalesce(c, F.lit(False))
        elif name in RULES:
            out = out | (F.coalesce(c, F.lit("")) != "")
    return out


def merge_scenarios(base: DataFrame, overlay: DataFrame, key: str = "scenario_id") -> DataFrame:
    """`base` under `overlay`: lists are joined, other values of the overlay that aren't null replace; columns that only the overlay has are added."""
    o = overlay.select(F.col(key), *[F.col(c).alias(f"o_{c}") for c in overlay.columns if c != key])
    both = base.join(o, key, "left")
    columns = []
    for f in base.schema.fields:
        if f.name == key or f.name not in overlay.columns:
            columns.append(F.col(f.name))
        elif f.dataType.typeName() == "array":
            joined = F.concat(F.col(f.name), F.col(f"o_{f.name}"))
            columns.append(F.coalesce(joined, f"o_{f.name}", f.name).alias(f.name))
        else:
            columns.append(F.coalesce(f"o_{f.name}", f.name).alias(f.name))
    return both.select(*columns, *[F.col(f"o_{c}").alias(c) for c in overlay.columns if c not in base.columns])


def runnable(scenarios: DataFrame) -> DataFrame:
    """Scenarios that are ready and have turns (diagnose) or a question (others)."""
    diagnose = F.coalesce(F.col("command") == "diagnose", F.lit(False))
    asked = F.when(diagnose, F.size(_texts(F.col("turns"))) > 0).otherwise(F.coalesce("question", F.lit("")) != "")
    return scenarios.where((F.col("status") == "ready") & asked)


def phrase_candidates(answer: Column, most: int = PHRASES) -> Column:
    """Distinct tokens of an answer that could mark it, by first place, whatever their case."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(PHRASE), F.lit(0))
    low = F.transform(found, lambda x: F.lower(x))
    first = F.filter(found, lambda x, i: F.array_position(low, F.get(low, i)) == i + 1)
    return F.slice(first, 1, most)


def overlay_draft(results: DataFrame) -> DataFrame:
    """Drafts of rules for failed results(scenario_id, run_label, detail, answer, passed, abstained, expect, fails_if)."""
    d = F.coalesce("detail", F.lit(""))
    cite = F.array_sort(F.array_distinct(F.regexp_extract_all(d, F.lit(r"must_cite missing '([^']+)'"), F.lit(1))))
    text = F.array_distinct(F.regexp_extract_all(d, F.lit(r"(?<!must_cite )missing '([^']+)'"), F.lit(1)))
    hint = F.nullif(F.regexp_extract(d, r"expect_contains_any missing one of (\[[^\]]+\])", 1), F.lit(""))
    full = lambda xs: F.when(F.size(xs) > 0, xs)
    proposed = F.when(~F.coalesce("passed", F.lit(False)) & ~F.coalesce("abstained", F.lit(False)), F.slice(phrase_candidates(F.col("answer")), 1, PROPOSED))
    return results.select(
        "scenario_id", F.col("run_label").alias("promoted_from"), d.alias("fail_detail"), F.nullif("expect", F.lit("")).alias("expect_note"), F.nullif("fails_if", F.lit("")).alias("fails_if_note"),
        full(cite).alias("must_cite"), full(text).alias("expect_contains"), hint.alias("expect_contains_any_hint"), full(proposed).alias("suggested_fails_if_contains"),
        F.substring(F.coalesce("answer", F.lit("")), 1, EXCERPT).alias("answer_excerpt"),
    )


def promote_failures(results: DataFrame, grading: DataFrame, force: bool = False) -> DataFrame:
    """grading(scenario_id, live, draft) after the drafts of failed results: live rules stay, a draft that is there too, unless `force`."""
    made = overlay_draft(results.where("not passed"))
    draft = made.select("scenario_id", F.to_json(F.struct(*[c for c in made.columns if c != "scenario_id"])).alias("new_"))
    both = grading.join(draft, "scenario_id", "full")
    return both.select("scenario_id", "live", (F.coalesce("new_", "draft") if force else F.coalesce("draft", "new_")).alias("draft"))


def relevant_labels(explicit: Column, must_cite: Column, must_cite_any: Column) -> Column:
    """The labels that count as relevant: those listed, or else all that must or may be cited."""
    none = F.array().cast("array<string>")
    listed = F.coalesce(explicit, none)
    return F.array_sort(F.when(F.size(listed) > 0, F.array_distinct(listed)).otherwise(F.array_union(F.coalesce(must_cite, none), F.coalesce(must_cite_any, none))))


def forbidden_labels(explicit: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(explicit, F.array().cast("array<string>"))))
