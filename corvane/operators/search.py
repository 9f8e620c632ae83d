"""Searches: the arms' hits merged, held to what applies, boosted, restricted and diversified, under named strategies.

All of a table of queries is searched at once. Pools are kept (they are a query's few dozen hits) since documents'
reasons, references and restrictions each read them again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, intent
from . import arms, expansion, fulltext, fusion, ranking
from .rows import settled

#: Documents' kinds of edges that make them prevail.
PREVAILS = ("corrects", "supersedes", "overrides")
SERVICE_MANUAL, ARTICLE = "service_manual", "knowledge_article"


@dataclass
class Corpus:
    """chunks; vectors (chunk_no, embedding); docs (doc_id, publication_number, doc_type, tier, published); edges (doc_id, type, target); models (doc_id, pattern); ranges (doc_id, scope, model, first, last)."""

    chunks: DataFrame
    vectors: DataFrame
    docs: DataFrame
    edges: DataFrame
    models: DataFrame
    ranges: DataFrame

    def embedded(self) -> DataFrame:
        return self.chunks.join(self.vectors, "chunk_no")


def understood(queries: DataFrame, bibliographic: str, installation: str) -> DataFrame:
    """queries(query_id, ask, ...) with codes, connectors, wanted (revision), led, bibliographic, installation and mid_cycle."""
    a = F.col("ask")
    return queries.withColumns({
        "codes": codes.error_codes(a), "connectors": codes.connector_ids(a), "wanted": codes.requested_revision(a), "led": intent.is_led_query(a),
        "bibliographic": a.rlike(bibliographic), "installation": a.rlike(installation), "mid_cycle": expansion.matches_family(a, "mid_cycle_stop"),
    })


def vector_arm(q: DataFrame, c: Corpus, limit: int, synthetic: bool = False) -> DataFrame:
    return arms.vector_fetch(q.where("vector is not null").select("query_id", "vector"), c.embedded(), limit, synthetic)


def code_arm(q: DataFrame, c: Corpus) -> DataFrame:
    return arms.code_fetch(q.where(F.size("codes") > 0).select("query_id", "codes"), c.chunks)


def revision_arm(q: DataFrame, c: Corpus) -> DataFrame:
    """Chunks of applicable service manuals at the revision that a bibliographic query names: 8 for queries about LEDs, else 12."""
    asked = q.where("bibliographic and wanted is not null")
    able = ranking.document_applies(asked.select("query_id", "model", "serial", "introduced"), c.models, c.ranges, c.docs.where(F.col("doc_type") == SERVICE_MANUAL), every=False).where("applies")
    pubs = able.join(c.docs.select("doc_id", "publication_number"), "doc_id").select("query_id", "publication_number")
    found = arms.manual_revision_fetch(asked.select("query_id", F.col("wanted").alias("revision"), "led"), pubs, c.chunks, 12)
    return found.join(asked.select("query_id", "led"), "query_id").where(~F.col("led") | (F.col("arm_rank") <= 8)).drop("led")


def annotated(pool: DataFrame, q: DataFrame, c: Corpus) -> DataFrame:
    """A pool with its queries' and documents' columns, as boosts want them. Targets are what articles of the whole pool refer to."""
    t = F.col("type")
    kinds = c.edges.groupBy("doc_id").agg(F.bool_or(t.isin(*PREVAILS)).alias("corrects"), F.bool_or(t == "superseded_by").alias("superseded"))
    docs = c.docs.select("doc_id", "doc_type", "tier").join(kinds, "doc_id", "left").fillna(False, ["corrects", "superseded"])
    articles = c.docs.where(F.col("doc_type") == ARTICLE).select("doc_id").join(c.edges.where("type = 'references'"), "doc_id").select("doc_id", F.col("target").alias("publication_number"))
    cited = pool.select("query_id", "doc_id").distinct().join(articles, "doc_id").select("query_id", "publication_number").distinct().withColumn("is_target", F.lit(True))
    hits = pool.join(docs, "doc_id", "left").fillna(False, ["corrects", "superseded"])
    hits = hits.join(q.select("query_id", "ask", "audience", "bibliographic", "installation", "mid_cycle"), "query_id")
    return hits.join(cited, ["query_id", "publication_number"], "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def applicable(pool: DataFrame, q: DataFrame, c: Corpus, plain: DataFrame | None = None) -> DataFrame:
    """A pool's hits of documents that apply to the query's appliance; queries without a model keep all. plain: the pool before columns were added."""
    pairs = (pool if plain is None else plain).select("query_id", "doc_id").distinct()
    ok = ranking.document_applies(q.where("model is not null").select("query_id", "model", "serial", "introduced"), c.models, c.ranges, c.docs, pairs).where("applies").select("query_id", "doc_id", F.lit(True).alias("ok_"))
    named = q.select("query_id", F.col("model").isNull().alias("any_"))
    return pool.join(named, "query_id").join(ok, ["query_id", "doc_id"], "left").where("any_ or ok_").drop("any_", "ok_")


def by_score(hits: DataFrame, limit: int, score: str = "final_score") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "merge_ord"))).where(F.col("rank") <= limit)


def filtered_and_ranked(pool: DataFrame, q: DataFrame, c: Corpus, limit: int) -> DataFrame:
    """What is left of a pool, with final_score and rank: applicable documents' hits, boosted, of named publications if any is there, two a document, and for owners their kinds of documents if any is there.

    As many as a pool has are diversified before the first `limit` are taken.
    """
    pool = settled(pool)
    hits = ranking.boosted(applicable(annotated(pool, q, c), q, c, pool)).withColumn("final_score", F.round("final_score", 9))
    hits = fusion.restrict(hits, F.array_contains(codes.queried_publications(F.col("ask")), F.upper("publication_number")))
    hits = ranking.diverse_top(hits, 1_000_000).drop("rank")
    owners = (F.lower(F.coalesce("audience", F.lit(""))) == "owner") & ~intent.needs_service_literature(F.col("ask"), F.col("bibliographic"))
    return by_score(fusion.restrict(hits, F.col("doc_type").isin(*ranking.OWNER_TYPES), owners), limit)


def production(q: DataFrame, c: Corpus, limit: int, overfetch: int, synthetic: bool = False) -> DataFrame:
    """All arms. References are followed from the code arm's hits. A query about an LED at a named revision that finds that revision skips the other arms."""
    revised = settled(revision_arm(q, c))
    found = revised.select("query_id").distinct().withColumn("found_", F.lit(True))
    rest = q.join(found, "query_id", "left").where(~(F.col("bibliographic") & F.col("wanted").isNotNull() & F.col("led") & F.coalesce("found_", F.lit(False)))).drop("found_")
    rest = settled(rest)
    coded = settled(code_arm(rest, c))
    wires = arms.connector_fetch(rest.where(F.size("connectors") > 0).select("query_id", "connectors"), c.chunks)
    refs = arms.reference_fetch(coded, c.edges, c.chunks, rest.select("query_id", "installation"), 3)
    pool = fusion.merge_hits(revised, coded, wires, refs, vector_arm(rest, c, max(overfetch, limit), synthetic))
    kinds = c.docs.select("doc_id", F.col("doc_type").alias("type_"))
    pool = pool.join(kinds, "doc_id", "left").join(q.select("query_id", "wanted", F.col("bibliographic").alias("bib_")), "query_id")
    pool = fusion.restrict(pool, (F.col("type_") == SERVICE_MANUAL) & (F.upper("revision") == F.col("wanted")), F.col("bib_")).drop("type_", "wanted", "bib_")
    return filtered_and_ranked(pool if synthetic else fusion.drop_synthetic(pool), q, c, limit)


def raw(q: DataFrame, c: Corpus, limit: int, overfetch: int) -> DataFrame:
    pool = fusion.merge_hits(code_arm(q, c), vector_arm(q, c, limit, True))
    return pool.withColumn("final_score", F.col("score")).withColumn("rank", F.col("merge_ord")).where(F.col("rank") <= limit)


def coded_pool(q: DataFrame, c: Corpus, other: DataFrame) -> DataFrame:
    return fusion.merge_hits(code_arm(q, c), other)


def _scored(scores: DataFrame, c: Corpus) -> DataFrame:
    """Fused scores as hits, in order."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "chunk_no")
    return scores.join(c.chunks, ["doc_id", "chunk_id"]).withColumn("arm_rank", F.row_number().over(order))


def applied(q: DataFrame, c: Corpus, limit: int, overfetch: int) -> DataFrame:
    pool = applicable(settled(coded_pool(q, c, vector_arm(q, c, overfetch, True))), q, c)
    return by_score(pool.withColumn("final_score", F.col("score")), limit)


def reranked(score: Callable[[Column, Column], Column]):
    """A strategy that orders what applies by a model's score of query and text (of 1,500 characters, as the model reads)."""

    def run(q: DataFrame, c: Corpus, limit: int, overfetch: int) -> DataFrame:
        pool = applied(q, c, overfetch, overfetch).join(q.select("query_id", "ask"), "query_id")
        return by_score(pool.drop("rank").withColumn("final_score", score(F.col("ask"), F.substring("text", 1, 1500))).drop("ask"), limit)

    return run


def boosted(q: DataFrame, c: Corpus, limit: int, overfetch: int) -> DataFrame:
    return filtered_and_ranked(coded_pool(q, c, vector_arm(q, c, overfetch, True)), q, c, limit)


def lexical(q: DataFrame, c: Corpus, limit: int, overfetch: int) -> DataFrame:
    return filtered_and_ranked(coded_pool(q, c, fulltext.search(q.select("query_id", "ask"), c.chunks, overfetch, every=True).join(c.chunks, "chunk_no")), q, c, limit)


def hybrid(q: DataFrame, c: Corpus, limit: int, overfetch: int) -> DataFrame:
    words = fulltext.search(q.select("query_id", "ask"), c.chunks, overfetch, every=True).join(c.chunks, "chunk_no")
    return filtered_and_ranked(coded_pool(q, c, _scored(fusion.rrf(vector_arm(q, c, overfetch, True), words), c)), q, c, limit)


def unioned(other: Callable[[DataFrame, Corpus, int], DataFrame]):
    """A strategy that puts another arm's hits on the vector arm's scale."""

    def run(q: DataFrame, c: Corpus, limit: int, overfetch: int) -> DataFrame:
        pool = fusion.union_pool(vector_arm(q, c, overfetch, True), other(q, c, overfetch))
        return filtered_and_ranked(coded_pool(q, c, _scored(pool, c)), q, c, limit)

    return run


def _any_word(q: DataFrame, c: Corpus, n: int) -> DataFrame:
    return fulltext.search(q.select("query_id", "ask"), c.chunks, n).join(c.chunks, "chunk_no")


#: Strategies by name: (queries, corpus, limit, overfetch) -> hits with rank and final_score. The reranking one needs a model.
STRATEGIES = {
    "vector_raw": raw, "vector_apply": applied, "vector_apply_boost": boosted, "lexical_apply": lexical, "hybrid_rrf_apply": hybrid,
    "union_lexical_apply": unioned(_any_word), "union_literal_apply": unioned(lambda q, c, n: arms.literal_fetch(q.select("query_id", "ask"), c.chunks, n)), "production_search": production,
}
