"""The corpus as its manifest describes it: checks, editions and precedence, and files held against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout
from .containment import holding

# Edges that say which document prevails, and licences that may be filed.
PRECEDENCE = ("corrects", "supersedes", "superseded_by", "overrides", "corrected_by")
SYNTHETIC_DOC, SYNTHETIC_PUBLICATION = "synth-", "SYNTH-"


def problems(docs: DataFrame, edges: DataFrame, excluded: DataFrame, licences: list[str]) -> DataFrame:
    """doc_id and problem of docs(doc_id, publication_number, revision, license): repeated ids, repeated editions, licences that aren't allowed, edges to nothing known. excluded: publication_number."""
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit("duplicate doc_id").alias("problem"))
    edition = ["publication_number", F.coalesce("revision", F.lit("")).alias("rev_")]
    again = docs.where("publication_number is not null").select("doc_id", *edition)
    again = again.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("publication_number", "rev_"))).where("n > 1").select("doc_id", F.lit("duplicate edition").alias("problem"))
    licence = docs.where(F.col("license").isNotNull() & ~F.col("license").isin(*licences)).select("doc_id", F.lit("licence not allowed").alias("problem"))
    known = docs.select(F.col("publication_number").alias("target")).unionByName(excluded.select(F.col("publication_number").alias("target"))).distinct()
    dangling = edges.join(known, "target", "left_anti").select("doc_id", F.concat(F.lit("dangling target "), "target").alias("problem"))
    return twice.unionByName(again).unionByName(licence).unionByName(dangling).distinct()


def found(docs: DataFrame, needle: str) -> DataFrame:
    """Documents whose id or title has a text, whatever its case, or whose publication it is."""
    low = F.lit(needle.lower())
    return docs.where(F.contains(F.lower("doc_id"), low) | F.contains(F.lower(F.coalesce("title", F.lit(""))), low) | (F.upper("publication_number") == needle.upper()))


def file_state(pinned: Column, actual: Column, volatile: Column) -> Column:
    """A document's file against the hashes that it is pinned to: missing, unpinned, ok, drift (where bytes may change) or mismatch."""
    return F.when(actual.isNull(), "missing").when(F.size(F.coalesce(pinned, F.array().cast("array<string>"))) == 0, "unpinned").when(F.array_contains(pinned, actual), "ok").when(volatile, "drift").otherwise("mismatch")


def verified(docs: DataFrame, files: DataFrame) -> DataFrame:
    """file and state for docs(file, pinned, volatile) and files(file, sha256): `file_state`, and `unexpected` for files that no document names."""
    both = docs.withColumn("own_", F.lit(True)).join(files, "file", "full")
    return both.select("file", F.when(F.col("own_").isNull(), "unexpected").otherwise(file_state(F.col("pinned"), F.col("sha256"), F.coalesce("volatile", F.lit(False)))).alias("state"))


def edition_identity(pages: DataFrame, key: str, order: str, content: Column) -> DataFrame:
    """key and identity: a digest over a document's pages' content in order, and how many there are. Pages are hashed where they are."""
    held = pages.select(key, F.col(order).alias("o_"), F.sha2(content, 256).alias("h_"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_", "h_"))), lambda r: r["h_"]), "")
    return held.groupBy(key).agg(F.concat(F.sha2(line, 256), F.lit("-"), F.count(F.lit(1))).alias("identity"))


def pinned(docs: DataFrame, files: DataFrame) -> DataFrame:
    """docs(doc_id, file, pinned) with the hash of the file at hand among the pinned ones, once. files: file, sha256."""
    both = docs.join(files.select("file", F.col("sha256").alias("new_")), "file", "left")
    own = F.coalesce("pinned", F.array().cast("array<string>"))
    return both.withColumn("pinned", F.when(F.col("new_").isNull() | F.array_contains(own, F.col("new_")), own).otherwise(F.array_append(own, F.col("new_")))).drop("new_").select(*docs.columns)


def edge_blobs(edges: DataFrame) -> DataFrame:
    """doc_id and blob: a document's edges as one searchable line."""
    return edges.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "target"))), lambda e: F.concat_ws(" ", e["type"], e["target"])), " ").alias("blob"))


def precedence_pairs(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """a and b (a < b): documents of which one has an edge of precedence to the other's publication."""
    aims = edges.where(F.col("type").isin(*PRECEDENCE)).select(F.col("doc_id").alias("x"), F.col("target").alias("publication_number"))
    pairs = aims.join(docs.select("publication_number", F.col("doc_id").alias("y")), "publication_number").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def date_key(published: Column) -> Column:
    """A date of any precision, comparable; null for what is none."""
    parts = F.split(published, "-")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(F.get(parts, F.lit(0)).try_cast("int").isNotNull(), F.struct(at(1).alias("y"), at(2).alias("m"), at(3).alias("d")))


def drift(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """notice, a and b: editions of one publication without any edge of precedence among them, and newer documents that name an older publication in their title, note or edges but don't say how they stand to it.

    docs: doc_id, publication_number, published, blob (what is searched for publications). An edition pair counts as
    linked if any pair of its publication's editions is; a publication is named if its number stands anywhere in the blob.
    """
    pairs = precedence_pairs(docs, edges)
    d = docs.where("publication_number is not null")
    linked = pairs.join(d.select(F.col("doc_id").alias("a"), F.col("publication_number").alias("p")), "a").join(d.select(F.col("doc_id").alias("b"), F.col("publication_number").alias("q")), "b").where("p = q").select("p").distinct()
    many = d.groupBy(F.col("publication_number").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("n > 1")
    unlinked = many.join(linked, "p", "left_anti").select(F.lit("editions without precedence").alias("notice"), "a", "b")
    dated = d.where(date_key(F.col("published")).isNotNull())
    newer = dated.select(F.col("doc_id").alias("x"), F.col("publication_number").alias("own"), date_key(F.col("published")).alias("dx"))
    older = d.select(F.col("doc_id").alias("y"), F.lower("publication_number").alias("name"), F.col("publication_number").alias("other"), date_key(F.col("published")).alias("dy"))
    held = holding(dated.select(F.col("doc_id").alias("x"), F.lower("blob").alias("hay")), older.select("name"), "x", "hay", "name")
    named = newer.join(held, "x").join(older, "name").where((F.col("own") != F.col("other")) & (F.col("dx") > F.col("dy")))
    named = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "x", "y").join(pairs, ["a", "b"], "left_anti")
    return unlinked.unionByName(named.select(F.lit("names an older document").alias("notice"), F.col("x").alias("a"), F.col("y").alias("b")).distinct())


def is_synthetic(doc_id: Column, publication: Column) -> Column:
    return F.startswith(doc_id, F.lit(SYNTHETIC_DOC)) | F.startswith(F.coalesce(publication, F.lit("")), F.lit(SYNTHETIC_PUBLICATION))


def with_synthetic(docs: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs and the made-up documents that may be added for a bench, those that may not, with a reason). made: doc_id, publication_number, role."""
    reason = (
        F.when(~F.startswith("doc_id", F.lit(SYNTHETIC_DOC)), "doc_id must be synthetic").when(F.col("publication_number").isNotNull() & ~F.startswith("publication_number", F.lit(SYNTHETIC_PUBLICATION)), "publication must be synthetic")
        .when(~F.coalesce("role", F.lit("")).eqNullSafe(F.lit("synthetic_eval")), "role must be synthetic_eval")
    )
    tried = made.withColumn("reason", reason)
    good = tried.where("reason is null").select(*docs.columns)
    return docs.unionByName(good), tried.where("reason is not null").select("doc_id", "reason")


def other_models(rows: DataFrame, model: str) -> Column:
    """Whether a row's vector is of another model (none counts as another)."""
    return F.col("embedding").isNotNull() & ~F.col("embedding_model").eqNullSafe(F.lit(model))


def cleared(rows: DataFrame, model: str) -> DataFrame:
    """Rows without the vectors of other models."""
    other = other_models(rows, model)
    return rows.withColumn("keep_", ~other).withColumn("embedding", F.when(F.col("keep_"), F.col("embedding"))).withColumn("embedding_model", F.when(F.col("keep_"), F.col("embedding_model"))).drop("keep_")


def with_embeddings(rows: DataFrame, vectors: DataFrame, keys: list[str], model: str) -> DataFrame:
    """Rows with fresh vectors(keys, vector) put in, empty ones skipped."""
    new = vectors.where(F.size("vector") > 0).select(*keys, F.col("vector").alias("new_"))
    out = rows.join(new, keys, "left")
    return out.withColumn("embedding", F.coalesce("new_", "embedding")).withColumn("embedding_model", F.when(F.col("new_").isNotNull(), F.lit(model)).otherwise(F.col("embedding_model"))).drop("new_")


def refreshed(rows: DataFrame, fresh: DataFrame, keys: list[str], content: str, columns: list[str]) -> DataFrame:
    """Rows whose content is the same with the fresh row's other columns; `refreshed` says where they differ. Rows with other content stay for a full replacement."""
    new = fresh.select(*keys, F.col(content).alias("c_"), *[F.col(c).alias(f"n_{c}") for c in columns])
    both = rows.join(new, keys, "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
    both = both.withColumn("refreshed", F.coalesce(F.col("c_") == F.col(content), F.lit(False)) & differs)
    return both.select(*[c for c in rows.columns if c not in columns], *[F.when(F.col("refreshed"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in columns], "refreshed")


def scale_notices(workers: Column, documents: Column, most: int = 50) -> Column:
    """What a deployment has outgrown: more than one worker, more documents than are curated by hand."""
    one = F.concat(workers, F.lit(" workers: sessions are kept in one process and would be parted"))
    two = F.concat(documents, F.lit(f" documents, more than {most}: curation by hand is the bottleneck"))
    return F.array_compact(F.array(F.when(workers > 1, one), F.when(documents > most, two)))


def audience_record(audience: Column, attested: Column) -> Column:
    """What is noted of an audience that a caller claims; it is never verified."""
    return F.struct(audience.alias("audience"), F.lit(False).alias("audience_verified"), (F.coalesce(attested, F.lit(False)) & audience.eqNullSafe(F.lit("technician"))).alias("technician_attested"))


def support_message(kind: Column, model: Column, serial: Column, maker: str = "the manufacturer") -> Column:
    """What a reader is told where there is no evidence: unsupported_model, no_evidence or weak_evidence."""
    named = F.coalesce(F.nullif(model, F.lit("")), F.lit(None))
    of = F.concat(F.lit(" on model "), named)
    hint = F.coalesce(F.concat(F.lit(" (serial "), serial, F.lit(")")), F.lit(""))
    unsupported = F.concat(F.lit("We don't have service documentation for model "), named, hint, F.lit(f" in this assistant.\n\nCheck the model number on the rating plate.\n\nFor repair help, contact {maker} with your model and serial number."))
    none = F.coalesce(F.concat(F.lit("No applicable manufacturer evidence was found for this question"), of, F.lit(". Try rephrasing, or include an error code if one is displayed.")), F.lit("No applicable manufacturer evidence was retrieved. Specify an appliance model or rephrase your question."))
    weak = F.concat(F.lit("We don't have sufficiently matching manufacturer documentation for this question"), F.coalesce(of, F.lit("")), F.lit(". Try rephrasing, or include an error code if one is displayed."))
    return F.when(kind == "unsupported_model", unsupported).when(kind == "weak_evidence", weak).otherwise(none)


def stamp(content: Column, name: str) -> Column:
    """A short stamp of a file's content, by name; none where there is no file."""
    return F.when(content.isNull(), "none").otherwise(F.concat(F.lit(f"{name}@"), F.substring(F.sha2(content, 256), 1, 12)))


def active_rows(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows(doc_id, version, ...) of documents' active versions."""
    return rows.join(versions.where("status = 'active'").select("doc_id", "version"), ["doc_id", "version"], "left_semi")


def kinds(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, correcting (by an edge, or as a service pointer) and superseded of docs(doc_id, tier, doc_type)."""
    t, pointer = F.col("type"), "technical_service_pointer"
    by = edges.groupBy("doc_id").agg(F.bool_or(t.isin("corrects", "supersedes", "overrides")).alias("c"), F.bool_or(t == "superseded_by").alias("s"))
    correcting = F.coalesce("c", F.lit(False)) | (F.col("tier") == pointer) | (F.col("doc_type") == pointer)
    return docs.join(by, "doc_id", "left").select("doc_id", correcting.alias("correcting"), F.coalesce("s", F.lit(False)).alias("superseded"))


def rows_without_vector(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows in the index's language that have no vector."""
    return rows.where(layout.is_index_language(F.col("language"))).join(vectors.select(key), key, "left_anti")


def models(rows: DataFrame) -> DataFrame:
    """The models that rows' vectors are of."""
    return rows.where("embedding is not null and embedding_model is not null").select("embedding_model").distinct()


def page_range_text(pages: DataFrame, key: str, page: str, text: str, first: int, last: int) -> DataFrame:
    """key and the text of its pages from first to last, a line each."""
    some = pages.where(F.col(page).between(first, last))
    held = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return some.groupBy(key).agg(F.array_join(F.transform(held, lambda r: r["t"]), "\n").alias("text"))


def parts(pages: Column, size: int) -> Column:
    """A document of so many pages in parts of `size` at most: an array of structs part, first, last."""
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((pages - 1) / size))
    made = lambda i: F.struct(i.alias("part"), (i * size + 1).alias("first"), F.least((i + 1) * size, pages).alias("last"))
    return F.when(pages > 0, F.transform(numbers, made)).otherwise(F.filter(F.transform(F.array(F.lit(0).cast("long")), made), lambda x: F.lit(False)))
