"""Parsing of model output and of loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive_index(value: Column) -> Column:
    """A whole number above zero, from text that may also be written as a whole float; else null."""
    x = F.trim(value)
    plain = F.when(x.rlike(r"^[0-9]+(\.0+)?$"), F.regexp_replace(x, r"\.0+$", "").try_cast("int"))
    return F.when(plain > 0, plain)


def json_part(text: Column) -> Column:
    """A fenced JSON object, else what stands between the first and the last brace, else the text."""
    x = F.trim(text)
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    inner = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(inner != "", inner).otherwise(x)


def verdict(text: Column) -> Column:
    """pass, fail, abstain or invalid, from a judge's answer."""
    j = json_part(text)
    said = F.lower(F.trim(F.coalesce(F.get_json_object(j, "$.verdict"), F.lit(""))))
    passed = F.get_json_object(j, "$.passed")
    return (
        F.when(F.try_parse_json(j).isNull(), "invalid").when((said == "abstain") | (F.coalesce(F.get_json_object(j, "$.abstained"), F.lit("")) == "true"), "abstain")
        .when(said.isin("pass", "fail"), said).when(passed == "true", "pass").when(passed == "false", "fail").otherwise("invalid")
    )


def combined_verdict(deterministic: Column, judged: Column) -> Column:
    """A deterministic failure stands; a judge that abstains leaves a pass."""
    return deterministic & F.coalesce(judged.isin("pass", "abstain"), F.lit(True))


def closed_label(text: Column, labels: tuple[str, ...]) -> Column:
    """A label of a closed set, from JSON with a key `label` or from bare text; null for any other."""
    said = F.lower(F.trim(F.coalesce(F.get_json_object(text, "$.label"), text)))
    return F.when(said.isin(*labels), said)


def vector(text: Column) -> Column:
    """Doubles from text like [1, 2.5]; null if it is no such list."""
    return F.from_json(text, "array<double>")


def fence(text: Column) -> Column:
    """Evidence between delimiters, put there once."""
    mark = "<<<EVIDENCE"
    return F.when(F.contains(text, F.lit(mark)), text).otherwise(F.concat(F.lit(mark + "\n"), text, F.lit("\nEVIDENCE>>>")))


def model_label(text: Column, labels: tuple[str, ...]) -> Column:
    """A label of a closed set, from a JSON object (fenced or not) with a key `label`, or bare; null for any other."""
    x = F.trim(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(x, r"(?i)^```(?:json)?\s*|\s*```$", "")
    is_object = F.startswith(bare, F.lit("{")) & F.try_parse_json(bare).isNotNull()
    said = F.when(is_object, F.trim(F.coalesce(F.get_json_object(bare, "$.label"), F.lit("")))).otherwise(x)
    return F.when(said.isin(*labels), said)


def confident_choice(payload: Column, labels: tuple[str, ...], least: float) -> Column:
    """A decision's label, if it is a choice of the closed set and sure enough; else null."""
    j = lambda k: F.get_json_object(payload, f"$.answers.retrieve_label.{k}")
    choice, sure = F.trim(F.coalesce(j("choice"), F.lit(""))), F.coalesce(j("confidence").try_cast("double"), F.lit(0.0))
    return F.when((j("type") == "choice") & choice.isin(*labels) & (sure >= least), choice)
