"""A store of postings behind the lexical, code and connector arms, brought up to date by changed documents only.

Rows are (bucket, kind, term, key, positions), in a table with versions (`sources.snapshots`). A term's bucket is a hash
of kind and term, and buckets are folders, so a batch of questions reads the folders of its terms alone. Places are
written with Parquet's delta encoding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import SnapshotTable
from . import fulltext
from .arms import ranked, small
from .rows import settled

WORD, CODE, CONNECTOR = "word", "code", "connector"
BUCKETS = 64


def _bucket(kind: Column, term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(kind, term), F.lit(buckets)).cast("int")


def terms(chunks: DataFrame, key: str, codes: str | None = "error_codes", text: str = "text") -> DataFrame:
    """kind, term, key and positions: lexemes with their places, and fault codes and connectors (without)."""
    none = F.array().cast("array<int>")
    words = fulltext.postings(chunks, key, text).select(F.lit(WORD).alias("kind"), F.col("lexeme").alias("term"), key, "positions")
    spaced = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?i)F\s*[0-9]\s*E\s*[0-9]"), F.lit(0))
    said = F.transform(spaced, lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))
    own = F.coalesce(F.col(codes), F.array().cast("array<string>")) if codes else F.array().cast("array<string>")
    named = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("(?i)(J[0-9]+)"), F.lit(1)), F.upper)
    both = F.concat(
        F.transform(F.array_distinct(F.concat(own, said)), lambda x: F.struct(F.lit(CODE).alias("kind"), x.alias("term"))),
        F.transform(F.array_distinct(named), lambda x: F.struct(F.lit(CONNECTOR).alias("kind"), x.alias("term"))),
    )
    return words.unionByName(chunks.select(F.inline(both), key).select("kind", "term", key, none.alias("positions")))


class PostingsStore:
    """Postings of a table of chunks with the key column `key` (of type `kind`)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_no", kind: str = "bigint", buckets: int = BUCKETS):
        self.key, self.buckets = key, buckets
        schema = f"kind string, term string, {key} {kind}, positions array<int>, bucket int"
        self.table = SnapshotTable(spark, path, key, schema, "bucket", {"parquet.writer.version": "v2"})

    def update(self, changed: DataFrame, removed: DataFrame | None = None, base: int | None = None, codes: str | None = "error_codes") -> int:
        """Replaces the postings of the chunks `changed` (also where they have none left) and drops those of `removed`. Only these are read."""
        base = self.table.latest() if base is None else base
        rows = terms(changed, self.key, codes).withColumn("bucket", _bucket(F.col("kind"), F.col("term"), self.buckets))
        # one task a bucket and part of its terms, so that a bucket has few files
        rows = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(self.key), F.lit(4)))
        return self.table.commit(self.table.stage(rows, removed, changed.select(self.key), whole=True), base)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The postings of the terms of wanted(kind, term, ...), with the other columns of `wanted`. Folders of other buckets aren't read."""
        asked = wanted.withColumn("bucket", _bucket(F.col("kind"), F.col("term"), self.buckets))
        rows = self.table.read(where=self._within(asked))
        return rows.join(small(asked), ["bucket", "kind", "term"]).drop("bucket")

    def _within(self, asked: DataFrame) -> str:
        held = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # BUCKETS rows at most
        return f"bucket IN ({', '.join(map(str, held))})" if held else "false"

    def search(self, queries: DataFrame, limit: int, every: bool = False, ask: str = "ask") -> DataFrame:
        """As `fulltext.search`, from the store. With `every`, postings are gathered of the keys that may have all of a question's lexemes alone, and rows that were replaced are told among these."""
        asked = settled(fulltext.question_lexemes(queries, ask)).withColumnRenamed("lexeme", "term").withColumn("kind", F.lit(WORD))
        if every:
            rows, newest = self.table.layers(where=self._within(asked.select(_bucket(F.col("kind"), F.col("term"), self.buckets).alias("bucket"))))
            rows = rows.where(F.col("kind") == WORD).withColumnRenamed("term", "lexeme").drop("kind", "bucket")
            return fulltext.all_of(asked.withColumnRenamed("term", "lexeme").drop("kind"), rows, limit, self.key, newest)
        held = self.lookup(asked.select("kind", "term").distinct()).withColumnRenamed("term", "lexeme").drop("kind")
        asked = asked.withColumnRenamed("term", "lexeme").drop("kind")
        found = fulltext.matched(asked, held, self.key, every)
        return ranked(found, limit, F.desc(F.round("score", 9)), F.col(self.key))

    def keys_with(self, queries: DataFrame, column: str, kind: str) -> DataFrame:
        """query_id, key and term: the chunks that have a term of an array column of queries(query_id, ...)."""
        asked = queries.select("query_id", F.explode(column).alias("term")).distinct().withColumn("kind", F.lit(kind))
        return self.lookup(asked).select("query_id", self.key, "term").distinct()
