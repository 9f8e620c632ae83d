"""Versions of a document from proposal to use, their units' representations, and the trail of proposals.

versions: doc_id, version, strategy, status, source_fingerprint, superseded_by, forked_from. A document has one active
version at most; a candidate must be ready before it serves. Requests that a version's state doesn't allow come back
with a reason and change nothing. Everything is a table in, a table out, so a step for all documents is one plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from .rows import map_rows
from .versions import next_version

# Strategies, statuses, and those that may be made active.
STRUCTURED, SEMANTIC = "structured", "semantic_llm"
CANDIDATE, READY, ACTIVE, SUPERSEDED, ABANDONED = "candidate", "ready", "active", "superseded", "abandoned"
STATUSES = (CANDIDATE, READY, ACTIVE, SUPERSEDED, ABANDONED)
ACTIVATABLE = (READY, SUPERSEDED, ACTIVE)
# Kinds of representations in order, review flags, and the fence around model output.
KINDS = ("overview", "facts", "questions")
REVIEW_FLAGS = ("none", "ambiguous_boundary", "cross_page_dependency", "table_relationship", "figure_relationship", "warning_scope", "diagnostic_dependency", "other")
FENCE = re.compile(r"(?i)^```(?:json)?\s*|\s*```$")

FIELDS = ("doc_id", "version", "strategy", "status", "source_fingerprint", "superseded_by", "forked_from")


def _last(status: str | tuple[str, ...], condition: Column | None = None) -> Column:
    """The highest version of those statuses."""
    among = F.col("status").isin(*([status] if isinstance(status, str) else status))
    return F.max(F.when(among if condition is None else among & condition, F.col("version")))


def states(versions: DataFrame) -> DataFrame:
    """doc_id, active (version), active_strategy, open_candidate, last_structured, latest."""
    semantic = F.col("strategy") == SEMANTIC
    return versions.groupBy("doc_id").agg(
        _last(ACTIVE).alias("active"), F.max(F.when(F.col("status") == ACTIVE, F.col("strategy"))).alias("active_strategy"),
        F.min(F.when(F.col("status").isin(CANDIDATE, READY) & semantic, F.col("version"))).alias("open_candidate"),
        F.max(F.when(F.col("strategy") == STRUCTURED, F.col("version"))).alias("last_structured"), F.max("version").alias("latest"),
    )


def created(versions: DataFrame, wanted: DataFrame, strategy: str, status: str) -> DataFrame:
    """`versions` with a new one of each document of wanted(doc_id, source_fingerprint, forked_from), under its next number."""
    if strategy not in (STRUCTURED, SEMANTIC) or status not in STATUSES:
        raise ValueError(f"unknown strategy {strategy} or status {status}")
    new = wanted.join(next_version(versions), "doc_id", "left").select(
        "doc_id", F.coalesce("next_version", F.lit(1)).cast("int").alias("version"), F.lit(strategy).alias("strategy"), F.lit(status).alias("status"), "source_fingerprint",
        F.lit(None).cast("int").alias("superseded_by"), F.col("forked_from").cast("int").alias("forked_from"),
    )
    return versions.select(*FIELDS).unionByName(new)


def moved(versions: DataFrame, wanted: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """(versions after wanted(doc_id, version) have another status that isn't active, refusals with a reason)."""
    if status not in STATUSES or status == ACTIVE:
        raise ValueError(f"{status} is not a status to move to; make a version active instead")
    asked = wanted.select("doc_id", "version").distinct().withColumn("asked_", F.lit(True))
    both = versions.join(asked, ["doc_id", "version"], "full")
    reason = F.when(F.col("strategy").isNull(), "does not exist").when(F.col("status") == ACTIVE, "is active")
    refused = both.where("asked_").withColumn("reason", reason).where("reason is not null").select("doc_id", "version", "reason")
    goes = F.coalesce("asked_", F.lit(False)) & (F.col("status") != ACTIVE)
    after = both.where("strategy is not null").withColumn("status", F.when(goes, status).otherwise(F.col("status")))
    return after.select(*FIELDS), refused


def activated(versions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions after wanted(doc_id, version) are active and those before them superseded, refusals with a reason). One wanted version a document."""
    asked = wanted.groupBy("doc_id").agg(F.max("version").alias("target"))
    held = versions.select("doc_id", F.col("version").alias("target"), F.col("status").alias("held"))
    tried = asked.join(held, ["doc_id", "target"], "left")
    reason = F.when(F.col("held").isNull(), "does not exist").when(~F.col("held").isin(*ACTIVATABLE), F.concat(F.lit("is "), "held"))
    refused = tried.withColumn("reason", reason).where("reason is not null").select("doc_id", F.col("target").alias("version"), "reason")
    good = tried.where(F.col("held").isin(*ACTIVATABLE)).select("doc_id", "target")
    out = versions.join(good, "doc_id", "left")
    up, down = F.col("version") == F.col("target"), F.col("target").isNotNull() & (F.col("status") == ACTIVE)
    status = F.when(up, ACTIVE).when(down, SUPERSEDED).otherwise(F.col("status"))
    by = F.when(up, F.lit(None)).when(down, F.col("target")).otherwise(F.col("superseded_by"))
    return out.withColumn("superseded_by", by.cast("int")).withColumn("status", status).select(*FIELDS), refused


def reverted(versions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As `activated`, for earlier versions; an abandoned one has no chunks to go back to."""
    return activated(versions, wanted)


def structured_active(versions: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions in which each of docs(doc_id, source_fingerprint) has an active structured one, what was done).

    It is kept, made active again, or created; where another strategy is active the document is refused. The second
    table: doc_id, action (reuse, reactivate, create, refuse) and the version.
    """
    s = docs.join(states(versions), "doc_id", "left")
    action = F.when(F.col("active_strategy") == STRUCTURED, "reuse").when(F.col("active").isNotNull(), "refuse").when(F.col("last_structured").isNotNull(), "reactivate").otherwise("create")
    s = s.withColumn("action", action).withColumn("target", F.when(action == "reuse", F.col("active")).when(action == "reactivate", F.col("last_structured")).when(action == "create", F.coalesce("latest", F.lit(0)) + 1))
    kept = s.where(F.col("action").isin("reuse", "reactivate")).select("doc_id", "target", F.col("source_fingerprint").alias("fresh_"))
    out = versions.join(kept, "doc_id", "left")
    mine = F.coalesce(F.col("version") == F.col("target"), F.lit(False))
    out = out.withColumn("status", F.when(mine, ACTIVE).otherwise(F.col("status"))).withColumn("source_fingerprint", F.when(mine, F.col("fresh_")).otherwise(F.col("source_fingerprint")))
    out = out.withColumn("superseded_by", F.when(mine, F.lit(None).cast("int")).otherwise(F.col("superseded_by"))).select(*FIELDS)
    new = s.where("action = 'create'").select("doc_id", "source_fingerprint", F.lit(None).cast("int").alias("forked_from"))
    done = s.select("doc_id", "action", F.col("target").cast("int").alias("version"))
    return created(out, new, STRUCTURED, ACTIVE), done


def proposed(versions: DataFrame, docs: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions with a candidate for each of docs(doc_id, source_fingerprint), what became of it).

    Documents with an open candidate are refused. findings(doc_id, code): what is wrong with the proposed spans; a
    proposal with any is rejected, though its version and trail stay. The second table: doc_id, version, outcome
    (proposed, rejected, refused), detail.
    """
    s = docs.join(states(versions), "doc_id", "left").join(findings.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("code")), "; ").alias("codes")), "doc_id", "left")
    outcome = F.when(F.col("open_candidate").isNotNull(), "refused").when(F.col("codes").isNotNull(), "rejected").otherwise("proposed")
    detail = F.when(F.col("open_candidate").isNotNull(), F.concat(F.lit("version "), "open_candidate", F.lit(" is already an open candidate"))).otherwise(F.coalesce("codes", F.lit("")))
    number = F.when(F.col("open_candidate").isNull(), F.coalesce("latest", F.lit(0)) + 1)
    done = s.select("doc_id", number.cast("int").alias("version"), outcome.alias("outcome"), detail.alias("detail"))
    new = s.where("open_candidate is null").select("doc_id", "source_fingerprint", F.lit(None).cast("int").alias("forked_from"))
    return created(versions, new, SEMANTIC, CANDIDATE), done


def forked(versions: DataFrame, units: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions with a candidate cloned from the active semantic one of each of docs(doc_id), units with its clones, refusals).

    units: doc_id, version, unit_key, and others; edits (array of JSON) if there is one gets a note of the fork.
    """
    counts = units.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n_units"))
    s = docs.select("doc_id").distinct().join(states(versions), "doc_id", "left").join(counts.withColumnRenamed("version", "active"), ["doc_id", "active"], "left")
    reason = (
        F.when(F.col("open_candidate").isNotNull(), F.concat(F.lit("version "), "open_candidate", F.lit(" is already open")))
        .when(F.col("active").isNull() | (F.col("active_strategy") != SEMANTIC), "no active semantic version to revise")
        .when(F.col("n_units").isNull(), "no units to clone")
    )
    s = s.withColumn("reason", reason)
    go = s.where("reason is null").select("doc_id", "active", (F.col("latest") + 1).cast("int").alias("next_"))
    source = versions.select("doc_id", F.col("version").alias("active"), "source_fingerprint")
    new = go.join(source, ["doc_id", "active"]).select("doc_id", "source_fingerprint", F.col("active").alias("forked_from"))
    clones = units.join(go.withColumnRenamed("active", "version"), ["doc_id", "version"])
    if "edits" in units.columns:
        note = F.format_string('{"action": "fork", "from_version": %d}', "version")
        clones = clones.withColumn("edits", F.array_append(F.coalesce("edits", F.array().cast("array<string>")), note))
    clones = clones.withColumn("version", F.col("next_")).drop("next_")
    return created(versions, new, SEMANTIC, CANDIDATE), units.unionByName(clones), s.where("reason is not null").select("doc_id", "reason")


def summary(versions: DataFrame) -> DataFrame:
    """A document's versions in order, as one row: doc_id, history (array of structs), active, latest_semantic."""
    row = F.struct("version", "strategy", "status", "superseded_by")
    return versions.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("history"), _last(ACTIVE).alias("active"), _last(STATUSES, F.col("strategy") == SEMANTIC).alias("latest_semantic"))


def ingestion_status(docs: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, version, strategy, chunks, embedded and open_candidate of all documents; `state`: not ingested, active or inactive. chunks: doc_id, version, embedded (boolean)."""
    n = chunks.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("embedded").alias("embedded"))
    s = docs.select("doc_id").join(states(versions), "doc_id", "left").withColumnRenamed("active", "version").join(n, ["doc_id", "version"], "left")
    state = F.when(F.col("latest").isNull(), "not ingested").when(F.col("version").isNotNull(), "active").otherwise("inactive")
    return s.select("doc_id", "version", F.col("active_strategy").alias("strategy"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("embedded", F.lit(0)).alias("embedded"), "open_candidate", state.alias("state"))


def all_approved(units: DataFrame, key: list[str]) -> DataFrame:
    """key and approved: whether every unit of a version is; versions without units have no row, so none is."""
    return units.groupBy(*key).agg(F.bool_and(F.coalesce(F.col("review_status") == "approved", F.lit(False))).alias("approved"))


# Representations


def parsed_representations(outputs: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys, rep_kind, text, tokens and place of each kind that a model's output has; outputs that aren't usable give one row with `error`."""

    def read(row: dict) -> list[dict]:
        own, text = {k: row[k] for k in keys}, FENCE.sub("", (row[raw] or "").strip())
        try:
            data = json.loads(text) if text else None
        except (json.JSONDecodeError, RecursionError):
            return [own | {"error": "not JSON"}]
        if not isinstance(data, dict):
            return [own | {"error": "nothing returned" if data is None else "not an object"}]
        lists = {k: "\n".join(s for s in (str(i).strip() for i in data[k]) if s) for k in KINDS[1:] if isinstance(data.get(k), list)}
        bodies = {KINDS[0]: str(data.get(KINDS[0]) or "").strip()} | lists
        found = [own | {"rep_kind": k, "text": bodies[k], "tokens": tokens.estimated(bodies[k]), "place": i} for i, k in enumerate(KINDS, 1) if bodies.get(k)]
        return found or [own | {"error": "no usable representations"}]

    types = ", ".join(f"{k} {outputs.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(outputs.select(*keys, raw), read, f"{types}, rep_kind string, text string, tokens int, place int, error string")


def generated(units: DataFrame, keys: list[str], model: Callable[[str, bool], str], budget: int = tokens.BUDGET, attempts: int = 2) -> DataFrame:
    """keys, rep_kind, text, tokens, over_limit and attempts of units(keys, prompt), by a model called with the prompt and whether to tighten.

    Kinds that fit the budget stay; as long as one doesn't, the model is asked again, `attempts` times at most.
    """

    def run(row: dict) -> list[dict]:
        held: dict[str, dict] = {}
        used = 0
        while used < max(1, attempts) and (not used or any(r["over_limit"] for r in held.values())):
            used += 1
            try:
                data = json.loads(FENCE.sub("", (model(row["prompt"], used > 1) or "").strip()))
            except (json.JSONDecodeError, RecursionError):
                continue
            for kind in KINDS if isinstance(data, dict) else ():
                got = data.get(kind)
                text = str(got or "").strip() if kind == KINDS[0] else "\n".join(s for s in (str(i).strip() for i in got) if s) if isinstance(got, list) else ""
                if text and (kind not in held or held[kind]["over_limit"]):
                    n = tokens.estimated(text)
                    held[kind] = {"rep_kind": kind, "text": text, "tokens": n, "over_limit": n > budget}
        return [held[k] | {"attempts": used} | {c: row[c] for c in keys} for k in KINDS if k in held]

    types = ", ".join(f"{k} {units.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(units.select(*keys, "prompt"), run, f"{types}, rep_kind string, text string, tokens int, over_limit boolean, attempts int")


def rep_id(unit_key: Column, kind: Column) -> Column:
    return F.concat_ws(":", unit_key, kind)


def rep_hash(text: Column, rep: Column) -> Column:
    """A representation's identity: its id and its text with single spaces."""
    return F.sha2(F.concat_ws("\n", rep, F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), 256)


def written(held: DataFrame, fresh: DataFrame, keys: list[str], prune: bool = True) -> tuple[DataFrame, DataFrame]:
    """(the rows after fresh representations are written, drafts that were turned away).

    held: keys, unit_key, rep_kind, content_hash, text, embedding; fresh: keys, unit_key, rep_kind, text, over_limit. A row
    whose hash stays keeps its vector. Over-limit drafts aren't written; they retire the row that they would replace. With
    `prune`, rows of a written unit that aren't in `fresh` go; rows of other units stay.
    """
    key = [*keys, "unit_key", "rep_kind"]
    full = fresh.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("new_hash", rep_hash(F.col("text"), rep_id(F.col("unit_key"), F.col("rep_kind"))))
    good, drafts = full.where("not over_limit"), full.where("over_limit")
    old = held.select(*key, F.col("content_hash").alias("old_hash"), F.col("embedding").alias("old_vector"))
    rows = good.join(old, key, "left").select(*key, F.col("new_hash").alias("content_hash"), "text", F.when(F.col("new_hash") == F.col("old_hash"), F.col("old_vector")).alias("embedding"))
    touched = fresh.select(*keys, "unit_key").distinct()
    stay = held.join(touched, [*keys, "unit_key"], "left_anti") if prune else held.join(fresh.select(*key).distinct(), key, "left_anti")
    return rows.unionByName(stay.select(*key, "content_hash", "text", "embedding")), drafts.select(*key, "text")


def missing_vectors(rows: DataFrame) -> DataFrame:
    """Rows without a vector, which alone are embedded."""
    return rows.where("embedding is null")


def with_vectors(rows: DataFrame, keys: list[str], embed: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """`rows` with vectors where there were none, by a column function of the text."""
    return rows.withColumn("embedding", F.coalesce("embedding", F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", embed(F.col(text)))))


def units_with_reps(units: DataFrame, reps: DataFrame, keys: list[str]) -> DataFrame:
    """units(keys, unit_key, content_hash) with representations (array, by kind), and stale: whether one was made for other content. reps: keys, unit_key, rep_kind, text, unit_content_hash, embedded."""
    rows = F.array_sort(F.collect_list(F.struct("rep_kind", "text", "embedded")))
    by = reps.groupBy(*keys, "unit_key").agg(rows.alias("representations"), F.collect_set(F.coalesce("unit_content_hash", F.lit(""))).alias("made_for"))
    out = units.join(by, [*keys, "unit_key"], "left")
    other = F.exists("made_for", lambda h: ~h.eqNullSafe(F.col("content_hash")))
    none = F.array().cast(by.schema["representations"].dataType)
    return out.withColumn("stale", F.coalesce(other, F.lit(False))).withColumn("representations", F.coalesce("representations", none)).drop("made_for")


def unit_prompt(title: Column, unit_type: Column, section_path: Column, pages: Column, text: Column, tighten: Column, most: int = 24_000) -> Column:
    """What a model is asked to make representations of."""
    body = F.when(F.char_length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+$", ""), F.lit("\n[unit continues]"))).otherwise(text)
    lines = F.array(
        F.concat(F.lit("Unit title: "), F.coalesce(F.nullif(title, F.lit("")), F.lit("(untitled)"))), F.concat(F.lit("Unit type: "), unit_type),
        F.when(F.size(section_path) > 0, F.concat(F.lit("Section: "), F.array_join(section_path, " > "))), F.when(F.coalesce(pages, F.lit("")) != "", F.concat(F.lit("Source: "), pages)),
        F.when(tighten, F.lit("A previous attempt was too long to embed. Keep the same coverage, but cut every word that carries no search value.")),
    )
    return F.concat(F.array_join(F.array_compact(lines), "\n"), F.lit("\n\nUnit content:\n"), body)


# Proposals


def attempts(proposals: DataFrame, key: list[str]) -> DataFrame:
    """Proposals with their attempt, from 1 in order of made_at, then proposal_id."""
    return proposals.withColumn("attempt", F.row_number().over(Window.partitionBy(*key).orderBy("made_at", "proposal_id")))


def training_export(proposals: DataFrame, units: DataFrame, key: list[str]) -> DataFrame:
    """key and record: JSON of a version's proposals in order and its units as they are now."""
    a = attempts(proposals, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("attempt", "model", "raw_output", "validation"))).alias("proposals"))
    u = units.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "unit_key", "title", "source_text", "review_status"))).alias("units"))
    both = a.join(u, key, "full")
    return both.select(*key, F.to_json(F.struct(*key, "proposals", "units"), {"ignoreNullFields": "false"}).alias("record"))


PROPOSED_UNIT = "at int, start_page int, end_page int, start_y double, end_y double, title string, unit_type string, rationale string, review_flag string, review_note string, error string"


def _float(x, other: float) -> float:
    try:
        return float(x)
    except (TypeError, ValueError):
        return other


def read_proposal(raw: str | None) -> list[dict]:
    """The units of a segmentation's output; one row with `error` where its shape is wrong."""
    text = FENCE.sub("", (raw or "").strip())
    try:
        data = json.loads(text) if text else None
    except (json.JSONDecodeError, RecursionError):
        return [{"error": "not JSON"}]
    found = data.get("units") if isinstance(data, dict) else None
    if not isinstance(found, list):
        return [{"error": "empty response" if data is None else "not an object" if not isinstance(data, dict) else "no units array"}]
    out = []
    for i, u in enumerate(found):
        try:
            pages = {"start_page": int(u["start_page"]), "end_page": int(u["end_page"])}
        except (TypeError, ValueError, KeyError):
            return [{"error": f"unit {i} has invalid pages" if isinstance(u, dict) else f"unit {i} is not an object"}]
        said = lambda name, other="": str(u.get(name) or other).strip() or other  # noqa: B023, E731
        flag = said("review_flag", "none")
        flag = flag if flag in REVIEW_FLAGS else "other"
        out.append(pages | {
            "at": i, "start_y": _float(u.get("start_y"), 0.0), "end_y": _float(u.get("end_y"), 1.0), "title": said("title"), "unit_type": said("unit_type", "other"),
            "rationale": said("rationale"), "review_flag": flag, "review_note": "" if flag == "none" else said("review_note"),
        })
    return out or [{"error": "no units"}]


def parsed_proposals(outputs: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys and PROPOSED_UNIT for each unit of a segmentation's output."""
    types = ", ".join(f"{k} {outputs.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(outputs.select(*keys, raw), lambda r: [u | {k: r[k] for k in keys} for u in read_proposal(r[raw])], f"{types}, {PROPOSED_UNIT}")


def parsed_suggestions(outputs: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys, rationale, overview, facts, questions and error of an assistant's output."""

    def read(row: dict) -> list[dict]:
        own, text = {k: row[k] for k in keys}, FENCE.sub("", (row[raw] or "").strip())
        try:
            data = json.loads(text) if text else None
        except (json.JSONDecodeError, RecursionError):
            return [own | {"error": "not JSON"}]
        if not isinstance(data, dict):
            return [own | {"error": "nothing returned" if data is None else "not an object"}]
        bad = [k for k in ("facts", "questions") if data.get(k) is not None and not isinstance(data[k], list)]
        if bad:
            return [own | {"error": f"{bad[0]} must be an array"}]
        lists = {k: [s for s in (str(i).strip() for i in data.get(k) or []) if s] for k in ("facts", "questions")}
        return [own | lists | {k: str(data.get(k) or "").strip() for k in ("rationale", "overview")}]

    types = ", ".join(f"{k} {outputs.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(outputs.select(*keys, raw), read, f"{types}, rationale string, overview string, facts array<string>, questions array<string>, error string")
