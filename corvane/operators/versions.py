"""Versioned storage and curation: change detection, replacement, one active version, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify_changes(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key and state: new, changed, unchanged or gone, by fingerprint."""
    a, b = old.select(key, F.col(fingerprint).alias("a")), new.select(key, F.col(fingerprint).alias("b"))
    state = F.when(F.col("a").isNull() & F.col("b").isNotNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def replace_chunks(old: DataFrame, new: DataFrame, keys: list[str], content_hash: str = "content_hash", vector: str = "embedding") -> DataFrame:
    """The new set of chunks; a chunk whose hash didn't change keeps its vector, others have none."""
    held = old.select(*keys, F.col(content_hash).alias("h_"), F.col(vector).alias("v_"))
    rows = new.drop(vector).join(held, keys, "left")
    return rows.withColumn(vector, F.when(F.col("h_") == F.col(content_hash), F.col("v_"))).drop("h_", "v_")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, the new one where a key has two."""
    a, b = old.alias("a"), new.alias("b")
    columns = [F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in old.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*columns)


def activate(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """versions(doc_id, version, status) after wanted(doc_id, version) are made active and active ones superseded.

    Only ready, superseded or active versions can be made active; documents whose wanted version is none of these stay as they are.
    """
    able = versions.where(F.col("status").isin("ready", "superseded", "active")).select("doc_id", "version")
    go = wanted.join(able, ["doc_id", "version"], "left_semi").select("doc_id", F.col("version").alias("target"))
    out = versions.join(go, "doc_id", "left")
    status = F.when(F.col("version") == F.col("target"), "active").when(F.col("target").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("target")


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("doc_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def span_order() -> list[Column]:
    return [F.col("start_page"), F.col("start_y"), F.col("end_page"), F.col("end_y"), F.col("idx")]


def validate_spans(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Findings over proposed spans: version, code, idx (null for findings over all), detail.

    spans: version, idx, start_page, end_page, start_y, end_y; windows: version, first, last. Rows are tried
    for y out of range, pages out of the window and reversed ends, in this order; those that pass for
    duplicates, overlaps with the span before, and pages that no span covers.
    """
    s = spans.join(windows, "version")
    bad_y = F.least("start_y", "end_y") < -0.05
    bad_y = bad_y | (F.greatest("start_y", "end_y") > 1.05)
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    outside = (F.col("start_page") < F.col("first")) | (F.col("end_page") > F.col("last")) | (F.col("start_page") < 1)
    reverse = (F.col("start_page") > F.col("end_page")) | ((F.col("start_page") == F.col("end_page")) & (clamp("start_y") > clamp("end_y")))
    s = s.withColumn("code", F.when(bad_y, "invalid_y").when(outside, "unknown_page").when(reverse, "reversed_boundary"))
    rows = s.where("code is not null").select("version", "code", F.col("idx").cast("int").alias("idx"), F.lit(None).cast("string").alias("detail"))
    good = s.where("code is null").withColumns({"start_y": clamp("start_y"), "end_y": clamp("end_y")})
    key = ["version", "start_page", "start_y", "end_page", "end_y"]
    again = good.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("idx"))).where("r > 1").select("version", F.lit("duplicate_unit").alias("code"), F.col("idx").cast("int").alias("idx"), F.lit(None).cast("string").alias("detail"))
    order = Window.partitionBy("version").orderBy(*span_order())
    here, before = F.struct("start_page", "start_y"), F.lag(F.struct(F.col("end_page"), F.col("end_y"))).over(order)
    lap = good.withColumn("before", before).where((F.col("start_page") < F.col("before.end_page")) | ((F.col("start_page") == F.col("before.end_page")) & (F.col("start_y") < F.col("before.end_y"))))
    lap = lap.select("version", F.lit("overlapping_units").alias("code"), F.col("idx").cast("int").alias("idx"), F.lit(None).cast("string").alias("detail"))
    del here
    gaps = missing_pages(good, windows).groupBy("version").agg(F.count(F.lit(1)).alias("n")).select("version", F.lit("coverage_gap").alias("code"), F.lit(None).cast("int").alias("idx"), F.concat(F.col("n").cast("string"), F.lit(" pages")).alias("detail"))
    none = windows.join(spans.select("version").distinct(), "version", "left_anti").select("version", F.lit("no_units").alias("code"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("detail"))
    return rows.unionByName(again).unionByName(lap).unionByName(gaps).unionByName(none)


def missing_pages(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """version, page: pages of a window that no span covers, of versions that have a span."""
    held = spans.select("version").distinct()
    pages = windows.join(held, "version", "left_semi").select("version", F.explode(F.sequence("first", "last")).alias("page"))
    covered = spans.select("version", F.explode(F.sequence("start_page", "end_page")).alias("page")).distinct()
    return pages.join(covered, ["version", "page"], "left_anti")


def absorb_gaps(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Spans grown over missing pages: each goes to the last span, in order, of those that end before it, pages before all to the first.

    spans are in order and don't overlap.
    """
    gaps = missing_pages(spans, windows)
    order = Window.partitionBy("version").orderBy(*span_order())
    s = spans.withColumn("own_", F.row_number().over(order)).withColumn("next_", F.lead("start_page").over(order))
    grown = s.join(gaps, "version", "left")
    mine = (F.col("end_page") < F.col("page")) & (F.col("next_").isNull() | (F.col("page") < F.col("next_")))
    early = (F.col("own_") == 1) & (F.col("page") < F.col("start_page"))
    out = grown.groupBy("version", "idx", "start_page", "end_page", "start_y", "end_y").agg(F.max(F.when(mine, F.col("page"))).alias("to_"), F.min(F.when(early, F.col("page"))).alias("from_"))
    return out.select(
        "version", "idx", F.coalesce("from_", "start_page").alias("start_page"), F.coalesce("to_", "end_page").alias("end_page"),
        F.when(F.col("from_").isNotNull(), 0.0).otherwise(F.col("start_y")).alias("start_y"), F.when(F.col("to_").isNotNull(), 1.0).otherwise(F.col("end_y")).alias("end_y"),
    )


def edition_key() -> Column:
    """Orders editions: by date of any precision, then letters before numbers."""
    parts = F.split("published", "-")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).cast("int"), F.lit(0))
    r = F.trim(F.coalesce("revision", F.lit("")))
    kind = F.when(r == "", 0).when(r.rlike("^[A-Za-z]+$"), 1).otherwise(2)
    return F.struct(at(1).alias("y"), at(2).alias("m"), at(3).alias("d"), kind.alias("k"), F.upper(r).alias("r"))


def newest_editions(docs: DataFrame) -> DataFrame:
    """publication_number and the doc_id of its newest edition. docs: doc_id, publication_number, published, revision."""
    return docs.groupBy("publication_number").agg(F.max_by("doc_id", F.struct(edition_key().alias("e"), F.col("doc_id"))).alias("newest"))


def prune(logs: DataFrame, keep: int, cutoff: Column) -> DataFrame:
    """Logs (log_id, prefix, at) and whether they go: all but the newest `keep` of a prefix, and those before the cutoff."""
    place = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("at"), F.desc("log_id")))
    return logs.withColumn("drop", (place > keep) | (F.col("at") < cutoff))
