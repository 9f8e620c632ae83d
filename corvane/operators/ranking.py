"""Applicability of documents, additive boosts, and diverse top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, intent, serials
from . import expansion

# Patterns of evidence.
UNLOCK_EVIDENCE = r"(?i)will not unlock|won'?t unlock|door will not unlock|add garment|door locks when cycle|touch (?:start/)?pause"
WRONG_EVIDENCE = r"(?i)door won'?t lock|door will not lock|ensure that door is completely closed|door not closed"
LED_EVIDENCE = r"(?i)(status led|diagnostic led|step 10|0\.5.*0\.5|blinks? (rapidly|slowly))"
POWER_EVIDENCE = r"(?i)TEST #1.*ACU Power Check"
ENTRY_EVIDENCE = r"(?i)Activating Service Diagnostic Mode|Select any three \(3\) buttons|wait 30 seconds before\s+activating Service Diagnostic"
PAUSE_EVIDENCE = r"(?is)Enumeration:\s*\d+.{0,80}Pauses the machine"
# Kinds of documents for owners.
OWNER_TYPES = ("owners_manual", "use_and_care", "quick_start_guide", "knowledge_article", "warranty", "cycle_guide", "installation_instructions", "dimension_guide")
POINTERS = ("technical_service_pointer", "service_pointer")


def document_applies(appliances: DataFrame, models: DataFrame, ranges: DataFrame, docs: DataFrame, pairs: DataFrame | None = None, every: bool = True) -> DataFrame:
    """Whether each document governs each appliance, and why: query_id, doc_id, applies, reason.

    With pairs(query_id, doc_id), such as a pool's, only those are decided; without, the whole matrix is asked for, or
    without `every` the part of it where the model is listed.

    appliances: query_id, model, serial, introduced; models: doc_id, pattern; ranges: doc_id, scope, model,
    first, last; docs: doc_id, published (a date of any precision). Patterns are matched by equality with
    each prefix of a model, so that no pair of rows is compared that doesn't match.
    """
    asked = appliances.withColumn("model", F.upper(F.trim("model")))
    prefixes = F.transform(F.sequence(F.lit(0), F.length("model")), lambda i: F.concat(F.substr(F.col("model"), F.lit(1), i), F.lit("*")))
    keyed = asked.select("query_id", F.explode(F.array_append(prefixes, F.col("model"))).alias("key"))
    matched = models.select("doc_id", F.upper(F.trim("pattern")).alias("key")).join(keyed, "key").select("query_id", "doc_id").distinct()
    if pairs is not None:
        matched = matched.join(pairs, ["query_id", "doc_id"], "left_semi")
    own = ranges.withColumnRenamed("model", "pattern").join(matched, "doc_id").join(asked, "query_id")
    own = own.where(F.col("pattern").isNull() | serials.model_matches(F.col("pattern"), F.col("model")))
    parts = serials.serial_parts(F.col("serial"))
    year = F.coalesce("introduced", F.try_to_number(F.nullif(F.regexp_extract("published", "^([0-9]{4})", 1), F.lit("")), F.lit("9999")).cast("int"))
    own = own.join(docs.select("doc_id", "published"), "doc_id").withColumn("year", year)
    inside = F.coalesce(serials.serial_in_range(parts, serials.serial_parts(F.col("first")), serials.serial_parts(F.col("last")), F.col("year")), F.lit(False))
    seen = own.groupBy("query_id", "doc_id").agg(
        F.bool_and(F.col("scope") == "all").alias("all_serials"), F.bool_or((F.col("scope") == "all") | inside).alias("inside"),
        F.max(F.col("year").isNotNull()).alias("dated"), F.max(F.col("serial").isNotNull()).alias("has_serial"), F.max(parts.isNotNull()).alias("readable"),
    )
    if pairs is not None:
        everything = pairs.join(asked.select("query_id"), "query_id", "left_semi").join(docs.select("doc_id"), "doc_id", "left_semi")
    else:
        everything = asked.select("query_id").crossJoin(docs.select("doc_id")) if every else matched.join(docs.select("doc_id"), "doc_id", "left_semi")
    out = everything.join(matched.withColumn("matched", F.lit(True)), ["query_id", "doc_id"], "left").join(seen, ["query_id", "doc_id"], "left")
    reason = (
        F.when(F.col("matched").isNull(), "model not listed").when(F.col("inside").isNull(), "no serial restriction").when(F.col("all_serials"), "all serial numbers")
        .when(~F.col("has_serial"), "serial number missing").when(~F.col("dated"), "year code ambiguous").when(~F.col("readable"), "serial malformed")
        .when(F.col("inside"), "serial in a range").otherwise("serial outside every range")
    )
    return out.select("query_id", "doc_id", reason.isin("no serial restriction", "all serial numbers", "serial in a range").alias("applies"), reason.alias("reason"))


def apply_filter(hits: DataFrame, applies: DataFrame) -> DataFrame:
    """Hits of documents that apply; of documents not known, none."""
    return hits.join(applies.where("applies").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")


def boosts() -> dict[str, Column]:
    """The boosts by name, over a hit joined with its query and document.

    A hit: text, kind, error_codes, publication_number, revision; its document: doc_type, tier, corrects
    (has such an edge), superseded; its query: ask, audience, bibliographic, installation, mid_cycle, and
    is_target (the publication is one that an article among the hits refers to); and what `understood` reads in it.
    """
    col, text, ask = F.col, F.coalesce("text", F.lit("")), F.col("ask")
    bib, ins, tech, kind_of = col("bibliographic"), col("installation"), intent.is_technician_query(ask), col("doc_type")
    asked, named, rev = col("asked_"), col("named_"), col("wanted_")
    own = F.transform(F.coalesce("error_codes", F.array().cast("array<string>")), F.upper)
    led, polarity = intent.is_led_query(ask), col("polarity_")
    owner, pub = F.lower(F.coalesce("audience", F.lit(""))) == "owner", F.upper("publication_number")
    met = (F.size(asked) > 0) & F.arrays_overlap(own, asked)
    article = F.coalesce(kind_of == "knowledge_article", F.lit(False))
    plain = met & ~((ins | tech) & article)
    unlock, lock = F.coalesce(polarity == "unlock", F.lit(False)), F.coalesce(polarity == "lock", F.lit(False))
    right, wrong = text.rlike(UNLOCK_EVIDENCE), text.rlike(WRONG_EVIDENCE)
    listed = F.array_contains(named, pub)
    entry = text.rlike(ENTRY_EVIDENCE)
    target = col("is_target")
    correcting = col("corrects") | col("tier").isin("service_pointer", "technical_service_pointer") | kind_of.isin(*POINTERS)
    # The weights.
    table = {
        "correcting": (~bib & correcting, 0.05), "corrects_edge": (~bib & col("corrects"), 0.08), "superseded": (~bib & col("superseded"), -0.25),
        "manual": (bib & (kind_of == "service_manual"), 0.15), "manual_revision": (bib & (kind_of == "service_manual") & (F.upper("revision") == rev), 0.25),
        "pointer": (bib & kind_of.isin(*POINTERS), -0.12), "pointer_revision": (bib & kind_of.isin(*POINTERS) & rev.isNotNull(), -0.18),
        "installation": (ins & (kind_of == "installation_instructions"), 0.12), "tier": (col("tier").isin("service_literature", "service_pointer", "technical_service_pointer"), 0.02),
        "technician": (tech & kind_of.isin("tech_sheet", "service_manual"), 0.30), "technician_article": (tech & article, -0.45),
        "owner": (owner & kind_of.isin(*OWNER_TYPES), 0.12), "owner_unlock": (owner & unlock & kind_of.isin("owners_manual", "knowledge_article"), 0.10),
        "named": ((F.size(named) > 0) & listed, 0.45), "not_named": ((F.size(named) > 0) & pub.isNotNull() & ~listed, -0.35),
        "target": (target, 0.25), "target_installation": (target & ins & (F.size(asked) > 0), 0.35), "target_instructions": (target & ins & (F.size(asked) > 0) & (kind_of == "installation_instructions"), 0.15),
        "drum_light": (led & text.rlike("(?i)drum light"), -0.20), "led": (led & text.rlike(LED_EVIDENCE), 0.30), "power_check": (led & text.rlike(POWER_EVIDENCE), 0.15),
        "unlock": (unlock & right, 0.28), "unlock_wrong": (unlock & wrong & ~right, -0.22), "lock": (lock & wrong, 0.12),
        "entry": (col("mid_cycle") & entry, 0.38), "pause": (col("mid_cycle") & ~entry & text.rlike(PAUSE_EVIDENCE), -0.20),
        "code_article": (met & (ins | tech) & article, 0.05), "code": (plain, 0.15), "code_focus": (plain & ((F.size(F.array_except(own, asked)) == 0) | (F.size(F.array_distinct(own)) <= 2)), 0.25),
        "code_kind": (plain & (col("kind") == "article"), 0.10), "code_knowledge": (plain & article, 0.20),
    }
    return {k: F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0)) for k, (c, v) in table.items()}


def understood(hits: DataFrame) -> DataFrame:
    """Hits with what their query asks for, read once a hit: asked_ (codes), named_ (publications), wanted_ (revision), polarity_."""
    ask = F.col("ask")
    return hits.withColumns({"asked_": codes.error_codes(ask), "named_": codes.queried_publications(ask), "wanted_": codes.requested_revision(ask), "polarity_": expansion.polarity(ask)})


def boosted(hits: DataFrame, keep: bool = False) -> DataFrame:
    """Hits with `boost` and `final_score`, and with `keep` each boost as a column of its own (boost_<name>)."""
    made = boosts()
    total = None
    for c in made.values():
        total = c if total is None else total + c
    out = understood(hits).withColumn("boost", total).withColumn("final_score", F.col("score") + F.col("boost"))
    out = out.withColumns({f"boost_{k}": c for k, c in made.items()}) if keep else out
    return out.drop("asked_", "named_", "wanted_", "polarity_")


def diverse_top(hits: DataFrame, limit: int, per_doc: int = 2, score: str = "final_score", order: str = "merge_ord") -> DataFrame:
    """The first `limit` hits of each query, of a document `per_doc` at most unless there's only one; `rank` is a hit's place."""
    best = [F.desc(score), F.col(order)]
    # one document only: its first and last ids agree
    alone = F.min("doc_id").over(Window.partitionBy("query_id")) == F.max("doc_id").over(Window.partitionBy("query_id"))
    own = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*best))
    some = hits.withColumn("alone_", alone).withColumn("own_", own).where(F.col("alone_") | (F.col("own_") <= per_doc)).drop("alone_", "own_")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(F.col("rank") <= limit)


def dispositions(hits: DataFrame, limit: int, per_doc: int = 2) -> DataFrame:
    """All hits with what became of them: kept, max_per_doc or top_k."""
    best = [F.desc("final_score"), F.col("merge_ord")]
    alone = F.min("doc_id").over(Window.partitionBy("query_id")) == F.max("doc_id").over(Window.partitionBy("query_id"))
    out = hits.withColumn("fits_", alone | (F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(*best)) <= per_doc))
    upto = F.sum(F.col("fits_").cast("int")).over(Window.partitionBy("query_id").orderBy(*best).rowsBetween(Window.unboundedPreceding, 0))
    # once the list is full, everything further falls to its length
    full = F.col("upto_") - F.col("fits_").cast("int") >= limit
    return out.withColumn("upto_", upto).withColumn("disposition", F.when(full, "top_k").when(F.col("fits_"), "kept").otherwise("max_per_doc")).drop("fits_", "upto_")
