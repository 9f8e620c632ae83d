"""Whether an answer that a policy covers is released: as it is, as a question back, rewritten once, or withheld.

A policy has variables (name, role fact or claim, type bool, int, real or enum, values, unknown, requires, ask) and
rules. A formalization maps a turn onto them; the finding of the check, with the variables' questions, decides.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import map_rows

# What is said where nothing more can be.
UNMATCHED = "I could not check that answer against the rules I apply. Please describe the symptom again in your own words."
ONE_MORE = "I need one more fact before I can confirm that."
TOO_COMPLEX = "I can't check that statement against the rules, so I won't state it as fact."
HELD = ("invalid", "impossible", "too_complex")

FORMAL = "premises map<string,string>, claims map<string,string>, untranslated array<string>, ambiguous boolean, reason string, confidence double"


class BadAssignment(ValueError):
    """A payload that can't be read as assignments."""


def coerced(kind: str, values: list[str] | None, raw: str) -> str:
    """A value as its variable's type has it, in text; raises for others."""
    low = raw.strip().lower()
    if kind == "bool" and low in ("true", "false"):
        return low
    if kind == "int" and re.fullmatch(r"[+-]?\d+", low):
        return str(int(low))
    if kind == "real" and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", low):
        return repr(float(low))
    if kind == "enum" and raw in (values or []):
        return raw
    raise BadAssignment(f"{raw!r} is no {kind}")


def _texts(value) -> list[str]:
    return [s for s in (str(x).strip() for x in value) if s] if isinstance(value, list) else []


class Reader:
    """Reads payloads against a policy's variables."""

    def __init__(self, variables: list[dict]):
        self.variables = {v["name"]: v for v in variables}

    def assignments(self, rows, role: str, stated: dict, dropped: list[str]) -> dict[str, str]:
        """name -> value of one role. Claims that are false, or whose fact isn't stated, are left out; their text goes to `dropped`."""
        out: dict[str, str] = {}
        if rows is not None and not isinstance(rows, list):
            raise BadAssignment("assignments must be a list")
        for row in rows or []:
            if not isinstance(row, dict):
                raise BadAssignment("assignment must be an object")
            name, raw = (str(row.get(k) or "").strip() for k in ("name", "value"))
            if not name and not raw:
                continue
            if (v := self.variables.get(name)) is None:
                raise BadAssignment(f"unknown variable {name}")
            if v["role"] != role:
                raise BadAssignment(f"{name} is a {v['role']}, not a {role}")
            if not raw:
                continue
            value = coerced(v["type"], v.get("values"), raw)
            if (role == "claim" and value == "false" and v["type"] == "bool") or (v.get("requires") and v["requires"] not in stated):
                text = str(row.get("text") or "").strip()
                dropped += [text] if text and text not in dropped else []
            elif out.setdefault(name, value) != value:
                raise BadAssignment(f"conflicting values for {name}")
        return out

    def read(self, payload) -> dict:
        """The fields of FORMAL."""
        unclear = {"premises": {}, "claims": {}, "untranslated": [], "ambiguous": True, "reason": "invalid_payload", "confidence": 0.0}
        if not isinstance(payload, dict):
            return unclear
        left, error, premises = _texts(payload.get("untranslated")), "", {}
        try:
            premises = self.assignments(payload.get("premises"), "fact", {}, [])
        except BadAssignment as e:
            error = str(e)
        flagged = payload.get("ambiguous")
        in_scope = lambda n: not self.variables.get(n, {}).get("requires") or self.variables[n]["requires"] in premises
        names = [n for n in _texts(flagged) if in_scope(n)]
        if flagged is True or names:
            return unclear | {"reason": ":".join(x for x in ("model_ambiguous", ",".join(names)) if x), "untranslated": left}
        try:
            claims = self.assignments(payload.get("claims"), "claim", premises, left)
        except BadAssignment as e:
            error = error or str(e)
        if error:
            return unclear | {"reason": error, "untranslated": left}
        return {"premises": premises, "claims": claims, "untranslated": left, "ambiguous": False, "reason": "", "confidence": 1.0}


def _payload(raw: str | None):
    text = (raw or "").strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        return json.loads(text)
    except (json.JSONDecodeError, RecursionError):
        return None


def formalizations(outputs: DataFrame, keys: list[str], variables: list[dict], raw: str = "raw") -> DataFrame:
    """keys and FORMAL for a column of translators' output."""
    reader, types = Reader(variables), ", ".join(f"{k} {outputs.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(outputs.select(*keys, raw), lambda r: [reader.read(_payload(r[raw])) | {k: r[k] for k in keys}], f"{types}, {FORMAL}")


def agreed(formal: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One formalization for each key: the translators' (in `order`) own where they all say the same; none at all, or different ones, are ambiguous."""
    line = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), "\x1f")
    said = F.concat_ws("\x1e", line(F.col("premises")), line(F.col("claims")))
    head = F.min_by(F.struct("premises", "claims", "untranslated", "ambiguous", "reason", "confidence"), order)
    later = F.count_if(F.col("ambiguous"))
    g = formal.withColumn("said", said).groupBy(*keys).agg(head.alias("h"), F.countDistinct("said").alias("n"), F.count(F.lit(1)).alias("k"), later.alias("unclear"))
    others = F.col("unclear") - F.col("h.ambiguous").cast("int")
    differ = (F.col("k") > 1) & ((F.col("n") > 1) | (others > 0))
    empty = F.create_map().cast("map<string,string>")
    pick = lambda name, other: F.when(differ, other).otherwise(F.col(f"h.{name}")).alias(name)
    return g.select(
        *keys, pick("premises", empty), pick("claims", empty), pick("untranslated", F.array().cast("array<string>")), pick("ambiguous", F.lit(True)),
        pick("reason", F.lit("translators_disagreed")), pick("confidence", F.lit(0.0)),
    )


def question_back(names: Column, asks: dict[str, str]) -> Column:
    """The question of the first named fact that has one; empty without any."""
    table = F.create_map(*[F.lit(x) for pair in asks.items() for x in pair]) if asks else F.create_map().cast("map<string,string>")
    found = F.filter(F.transform(names, lambda n: F.try_element_at(table, F.trim(n))), lambda q: q.isNotNull())
    return F.when(F.size(found) > 0, F.concat(F.lit(ONE_MORE + " "), F.get(found, F.lit(0)))).otherwise("")


def choice(premises: Column, model: Column, counterexample: Column, unknown: dict[str, str], asks: dict[str, str]) -> Column:
    """What to ask: the first premise that has its unknown value, else the first fact in which the model and the counterexample differ."""
    open_ = [F.when(F.try_element_at(premises, F.lit(n)) == v, F.lit(n)) for n, v in unknown.items()]
    unsure = F.array_compact(F.array(*open_)) if open_ else F.array().cast("array<string>")
    differ = F.filter(F.map_keys(model), lambda k: ~F.try_element_at(model, k).eqNullSafe(F.try_element_at(counterexample, k)))
    said = question_back(F.concat(unsure, F.coalesce(differ, F.array().cast("array<string>"))), asks)
    return F.when(said != "", said).otherwise(ONE_MORE)


def withheld_text(outcome: Column, rules: Column) -> Column:
    named = F.coalesce(F.nullif(F.array_join(rules, ", "), F.lit("")), F.lit("a policy rule"))
    conflict = F.concat(F.lit("Those facts conflict with "), named, F.lit(", so I can't choose a side."))
    return F.when(outcome == "impossible", conflict).when(outcome == "too_complex", TOO_COMPLEX).otherwise(F.concat(F.lit("I can't state that, because it conflicts with "), named, F.lit(".")))


def released(cases: DataFrame, asks: dict[str, str], unknown: dict[str, str]) -> DataFrame:
    """cases with action (release, ask, rewrite, withhold), text, abstained and cited (indexes of citations kept; null: all of the answer's).

    cases: answer, ambiguous, reason, outcome, rule_ids, premises, model, counterexample, untranslated, and of a second
    draft rewritten (text or null), second_outcome, second_rule_ids, second_abstained.
    """
    outcome = F.when(F.col("ambiguous"), "translation_ambiguous").otherwise(F.col("outcome"))
    flagged = F.when(F.contains("reason", F.lit(":")), F.split(F.element_at(F.split("reason", ":", 2), 2), ",")).otherwise(F.array().cast("array<string>"))
    named = question_back(flagged, asks)
    back = F.when(outcome == "translation_ambiguous", F.when(named != "", named).otherwise(UNMATCHED)).otherwise(choice(F.col("premises"), F.col("model"), F.col("counterexample"), unknown, asks))
    second = F.col("rewritten").isNotNull()
    good = second & (F.col("second_outcome") == "valid") & ~F.coalesce("second_abstained", F.lit(False))
    action = (
        F.when(outcome.isNull() | outcome.isin("no_translations", "valid"), "release").when(outcome.isin("satisfiable", "translation_ambiguous"), "ask")
        .when((outcome == "invalid") & good, "rewrite").otherwise("withhold")
    )
    # a second draft that fails too speaks for itself
    worse = (outcome == "invalid") & second & F.col("second_outcome").isin(*HELD)
    body = withheld_text(F.when(worse, F.col("second_outcome")).otherwise(outcome), F.when(worse, F.col("second_rule_ids")).otherwise(F.col("rule_ids")))
    spans = F.filter(F.transform(F.coalesce("untranslated", F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s.rlike(r"\[\d+\]"))
    extra = F.array_join(spans, "\n\n")
    out = cases.withColumn("action", action)
    held = F.when(extra != "", F.concat(body, F.lit("\n\n"), extra)).otherwise(body)
    text = F.when(F.col("action") == "release", F.col("answer")).when(F.col("action") == "ask", back).when(F.col("action") == "rewrite", F.col("rewritten")).otherwise(held)
    cited = F.when(F.col("action") == "ask", F.array().cast("array<int>")).when(F.col("action") == "withhold", F.array_distinct(F.transform(F.regexp_extract_all(extra, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))))
    return out.withColumn("text", text).withColumn("abstained", (F.col("action") == "withhold") & (extra == "")).withColumn("cited", cited)
