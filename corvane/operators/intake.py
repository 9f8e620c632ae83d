"""Filing downloads: what a file says it is, and which document of the corpus that makes it.

downloads: file, and of saved pages content (their text with soft breaks), of PDFs sample (text of the first and last
page and the title). documents: doc_id, publication_number, revision, title, source_url, is_pdf, citation; edges:
doc_id, type, target. Files are joined to documents by what they name, never compared with all of them, except for
titles and paths, which are looked for in saved pages all at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .containment import holding

# How publications, revisions and captured addresses are written, and kinds of files.
PUBLICATION = r"(?i)(?<![0-9A-Za-z])(W\d{8})([A-Z])?(?![0-9A-Za-z])"
SLUG_REVISION = r"(?i)-rev-?([a-z])(?![a-z0-9])"
LOCATION = r"(?im)^(?:Snapshot-)?Content-Location:\s*(\S+)"
ARCHIVES = (".html", ".htm", ".mhtml", ".mht")
OUTBOUND = ("corrects", "supersedes", "references")
TITLE_CHARS = 12

TEXTS = "array<string>"


def publications(text: Column) -> Column:
    """Publications that a text names, in upper case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PUBLICATION), F.lit(1)), lambda x: F.upper(x))))


def glued_revision(text: Column) -> Column:
    """The first revision letter that is glued to a publication; null without one."""
    letters = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PUBLICATION), F.lit(2)), lambda x: x != "")
    return F.upper(F.get(letters, F.lit(0)))


def name_revision(name: Column) -> Column:
    """A file name's revision: glued to the publication, or else spelled out."""
    return F.coalesce(glued_revision(name), F.upper(F.nullif(F.regexp_extract(name, SLUG_REVISION, 1), F.lit(""))))


def is_archive(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).isin(*ARCHIVES)


def plain_url(url: Column) -> Column:
    """An address unescaped, without a slash at the end, in lower case."""
    x = F.coalesce(url, F.lit(""))
    # what isn't an escape must not be taken for one
    safe = F.regexp_replace(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(safe), x), r"/+$", ""))


def signals(downloads: DataFrame) -> DataFrame:
    """downloads with archive, named (publications in the name), numbers (in name or sample), revision, declared (captured addresses)."""
    sample = F.coalesce("sample", F.lit(""))
    declared = F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(LOCATION), F.lit(1)), lambda u: plain_url(F.regexp_replace(u, r"[\">;,]+$", "")))
    archive = is_archive(F.col("file"))
    numbers = F.array_sort(F.array_union(publications(F.col("file")), F.when(archive, F.array().cast(TEXTS)).otherwise(publications(sample))))
    revision = F.coalesce(name_revision(F.col("file")), F.when(~archive, glued_revision(sample)))
    return downloads.withColumns({"archive": archive, "named": publications(F.col("file")), "numbers": numbers, "revision": revision, "declared": F.array_distinct(declared)})


def url_tail(url: Column) -> Column:
    """The last two parts of an address."""
    return F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(url, "/")), 1, 2)), 1, 2), "/")


def archive_matches(files: DataFrame, documents: DataFrame) -> DataFrame:
    """file, doc_id and reason for saved pages: the address that they declare, or else a document's path in them, or else its title.

    files: file, content, declared. Of several documents at one level the first by doc_id is taken. Paths and titles are
    looked for all at once, in one pass over the files.
    """
    docs = documents.withColumn("url", plain_url(F.col("source_url"))).withColumn("tail", url_tail(F.col("url")))
    docs = docs.withColumn("name", F.lower(F.trim(F.element_at(F.split("title", r"\("), 1))))
    soft = F.regexp_replace(F.coalesce("content", F.lit("")), r"=\r?\n", "")
    held = files.select("file", plain_url(F.concat_ws("\n", "file", soft)).alias("hay"), "declared")
    exact = held.select("file", F.explode("declared").alias("url")).join(docs.where("url <> ''").select("url", "doc_id"), "url").select("file", "doc_id", F.lit(1).alias("level"))
    path = docs.where("url <> '' and tail <> ''").select("doc_id", F.col("tail").alias("needle"), F.lit(2).alias("level"))
    title = docs.where(F.char_length("name") > TITLE_CHARS).select("doc_id", F.col("name").alias("needle"), F.lit(3).alias("level"))
    needles = path.unionByName(title)
    met = holding(held.select("file", "hay"), needles, "file", "hay", "needle").join(needles, "needle").select("file", "doc_id", "level")
    best = exact.unionByName(met).groupBy("file").agg(F.min(F.struct("level", "doc_id")).alias("b"))
    reason = F.element_at(F.array(F.lit("declares this address"), F.lit("holds its path"), F.lit("holds its title")), F.col("b.level"))
    return files.select("file").join(best, "file", "left").select("file", F.col("b.doc_id").alias("doc_id"), F.coalesce(reason, F.lit("nothing matched")).alias("reason"), F.col("b.level").alias("level"))


def by_citation(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """file and doc_id where just one of a file's candidates(file, doc_id, publication_number) refers to all the others."""
    aims = edges.where(F.col("type").isin(*OUTBOUND)).groupBy("doc_id").agg(F.collect_set("target").alias("aims"))
    numbers = candidates.groupBy("file").agg(F.collect_set("publication_number").alias("numbers"))
    both = candidates.join(numbers, "file").join(aims, "doc_id", "left")
    others = F.array_except("numbers", F.array("publication_number"))
    citing = both.where(F.size(F.array_except(others, F.coalesce("aims", F.array().cast(TEXTS)))) == 0)
    return citing.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").drop("n")


def plan(downloads: DataFrame, documents: DataFrame, edges: DataFrame) -> DataFrame:
    """file, doc_id (null where undecided), reason, revision_conflict (boolean) for every download."""
    s = signals(downloads)
    saved = archive_matches(s.where("archive").select("file", "content", "declared"), documents.where("not is_pdf")).select("file", "doc_id", "reason", F.lit(False).alias("revision_conflict"))
    pdfs = s.where("not archive").select("file", "named", "numbers", "revision")
    docs = documents.where("is_pdf").select("doc_id", "publication_number", F.col("revision").alias("own"), "citation")
    hits = pdfs.withColumn("publication_number", F.explode("numbers")).join(docs, "publication_number")
    same = F.coalesce(F.col("own") == F.col("revision"), F.lit(False))
    facts = hits.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_same"), F.bool_and(F.col("own").isNull()).alias("unrevised"), F.min("doc_id").alias("only"),
        F.array_join(F.array_sort(F.collect_set(F.coalesce("own", F.lit("(none)")))), ", ").alias("held"),
    )
    # a revision narrows the candidates if one has it
    narrow = hits.join(facts.select("file", "n_same"), "file").where(F.col("revision").isNull() | same | (F.col("n_same") == 0))
    named = F.array_contains("named", F.col("publication_number"))
    counts = narrow.groupBy("file").agg(
        F.count(F.lit(1)).alias("k"), F.count_if(named).alias("k_named"), F.min("doc_id").alias("one"), F.min(F.when(named, F.col("doc_id"))).alias("one_named"),
        F.array_join(F.array_sort(F.collect_list("citation")), ", ").alias("all"), F.array_join(F.array_sort(F.collect_list(F.when(named, F.col("citation")))), ", ").alias("all_named"),
    )
    cited = by_citation(narrow.select("file", "doc_id", "publication_number"), edges).withColumnRenamed("doc_id", "by_edges")
    p = pdfs.join(facts, "file", "left").join(counts, "file", "left").join(cited, "file", "left")
    conflict = F.col("revision").isNotNull() & (F.col("n_same") == 0) & F.col("n").isNotNull()
    unrevised = conflict & (F.col("n") == 1) & F.col("unrevised")
    doc = (
        F.when(F.col("n").isNull(), F.lit(None)).when(unrevised, F.col("only")).when(conflict, F.lit(None)).when(F.col("k") == 1, F.col("one"))
        .when(F.col("k_named") == 1, F.col("one_named")).when(F.col("k_named") == 0, F.col("by_edges"))
    )
    reason = (
        F.when(F.col("n").isNull() & (F.size("numbers") > 0), F.concat(F.lit("publication number(s) "), F.array_join("numbers", ", "), F.lit(" not in the manifest")))
        .when(F.col("n").isNull(), "no publication number found in name or content").when(unrevised, "the manifest records no revision")
        .when(conflict, F.concat(F.lit("document is Rev "), "revision", F.lit(" but the manifest holds "), "held")).when(doc.isNotNull(), "publication number")
        .otherwise(F.concat(F.lit("ambiguous: matches "), F.when(F.col("k_named") > 0, F.col("all_named")).otherwise(F.col("all"))))
    )
    return p.select("file", doc.alias("doc_id"), reason.alias("reason"), conflict.alias("revision_conflict")).unionByName(saved)
