"""Retrieval arms: each takes queries and chunks and returns hits (query_id, chunk's columns, score, arm_rank).

Chunks have doc_id, chunk_id, chunk_no, text, page, kind, language, publication_number, revision and
error_codes. A rank is over a query's hits; `row_number` under a limit lets Spark keep the first rows of
each partition before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import codes
from .containment import holding
from .rows import reach_workers, settled

# The arms' scores.
CODE, CONNECTOR, NEIGHBOUR, LITERAL, REVISION, REFERENCE = 1.0, 1.0, 0.95, 0.95, 0.88, 0.85
#: A literal in more chunks than this tells nothing.
LITERAL_CHUNKS = 40
#: Query rows beyond which the query side is no longer broadcast.
BROADCAST_QUERIES = 10_000
#: Products of queries and vectors that a worker makes at once.
CELLS = 500_000


def ranked(hits: DataFrame, limit: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first `limit` hits of each query, with their rank."""
    return hits.withColumn("arm_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("arm_rank") <= limit)


def small(queries: DataFrame, bound: int = BROADCAST_QUERIES) -> DataFrame:
    """Queries, marked for broadcast where there are few; a table made of rows of the driver is one."""
    leaves = queries._jdf.queryExecution().optimizedPlan().collectLeaves()
    local = all(leaves.apply(i).nodeName() == "LocalRelation" for i in range(leaves.size()))
    return F.broadcast(queries) if local or queries.limit(bound + 1).count() <= bound else queries


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays of doubles; null if one is empty, null or of length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


class Best:
    """The `limit` best of many (query, key, score) that come in blocks: by score to 12 digits, then key; of equal keys of a query all, or only the best if `once`.

    What can't be among them any more is left out at once; the rest is gathered and folded in when it is more than what is
    held, so that memory is in proportion to queries times `limit`, however many rows come.
    """

    def __init__(self, queries: int, limit: int, once: bool = False):
        self.limit, self.once = limit, once
        self.least = np.full(queries, -np.inf)  # a row needs as much to get in
        self.room = max(queries * limit, CELLS)
        self.q, self.r, self.s, self.keys = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), None
        self.new, self.gathered = [], 0

    def take(self, found: np.ndarray, keys: pa.Array, who: np.ndarray | None = None) -> None:
        """found: queries x keys; `who`: the queries' numbers, if not all."""
        least = self.least if who is None else self.least[who]
        q, at = np.nonzero(found >= least[:, None] - 1e-12)
        if len(q):
            s = found[q, at]
            self._gather(q if who is None else who[q], np.round(s, 12), s, keys.take(pa.array(at)))

    def add(self, q: np.ndarray, r: np.ndarray, s: np.ndarray, keys: pa.Array) -> None:
        """Single rows: the query's number, the score as rows are put in order by, the score, and the key."""
        able = np.flatnonzero(r >= self.least[q])
        if len(able):
            self._gather(q[able], r[able], s[able], keys.take(pa.array(able)))

    def _gather(self, q: np.ndarray, r: np.ndarray, s: np.ndarray, keys: pa.Array) -> None:
        self.new.append((q, r, s, keys))
        self.gathered += len(q)
        if self.gathered > self.room:
            self.fold()

    def fold(self) -> None:
        parts = ([(self.q, self.r, self.s, self.keys)] if self.keys is not None else []) + self.new
        self.new, self.gathered = [], 0
        if not parts:
            return
        q, r, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
        keys = pa.concat_arrays([p[3] for p in parts])
        rank = pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        if self.once:
            order = np.lexsort((-s, rank, q))
            same = np.zeros(len(q), dtype=bool)
            same[1:] = (np.diff(q[order]) == 0) & (np.diff(rank[order].astype(np.int64)) == 0)
            order = order[~same]
            q, r, s, rank, keys = q[order], r[order], s[order], rank[order], keys.take(pa.array(order))
        order = np.lexsort((rank, -r, q))
        own, ordered = q[order], r[order]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
        last = place == self.limit - 1
        self.least[own[last]] = ordered[last]
        order = order[place < self.limit]
        self.q, self.r, self.s, self.keys = q[order], r[order], s[order], keys.take(pa.array(order))

    def batches(self, names: np.ndarray, name_type: pa.DataType, key: str):
        """query_id, key, score and rounded_ of what is held, in batches."""
        self.fold()
        for low in range(0, len(self.q), 50_000):
            cut = slice(low, low + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(names[self.q[cut]].tolist(), name_type), self.keys.slice(low, 50_000), pa.array(self.s[cut]), pa.array(self.r[cut])], names=["query_id", key, "score", "rounded_"])


def nearest(queries: DataFrame, vectors: DataFrame, limit: int, group: str | None = None, cosine: bool = True) -> DataFrame:
    """query_id, id_ (or `group`), score and arm_rank: for each query the nearest of vectors(id_, embedding), exactly, ties by id_.

    queries: query_id, vector. With `group`, the best vector of each group counts. Queries are taken in blocks of
    BROADCAST_QUERIES; a block goes to all workers as a matrix (of that bounded size), which score their vectors by products
    of CELLS numbers at most and pass on each task's best rows.
    """
    asked = queries.where("size(vector) > 0").select(F.col("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = asked.limit(BROADCAST_QUERIES + 1).collect()
    if len(rows) > BROADCAST_QUERIES:
        blocks = -(-asked.count() // (BROADCAST_QUERIES // 2))
        out = None
        for i in range(blocks):
            part = nearest(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), vectors, limit, group, cosine)
            out = part if out is None else out.unionByName(part)
        return out
    key = group or "id_"
    held = vectors.select("id_", *([group] if group else []), F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0")
    kinds = [held.schema[key].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()]
    qtype = to_arrow_type(T._parse_datatype_string(kinds[1]))
    width = max((len(r["vector"]) for r in rows), default=0)
    same = [r for r in rows if len(r["vector"]) == width]
    names, matrix = np.array([r["query_id"] for r in same], dtype=object), np.array([r["vector"] for r in same], dtype=np.float64).reshape(len(same), width)
    names, matrix = _unit_rows(names, matrix) if cosine else (names, matrix)
    reach_workers(queries.sparkSession)

    def score(batches):
        if not len(names):
            return
        best, step = Best(len(names), limit, once=bool(group)), max(1, CELLS // len(names))
        for batch in batches:
            column = batch.column("embedding")
            values, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False)
            fit = np.flatnonzero(np.diff(starts) == width)
            for low in range(0, len(fit), step):
                some = fit[low : low + step]
                v = np.nan_to_num(values[starts[some][:, None] + np.arange(width)])
                some, v = _unit_rows(some, v) if cosine else (some, v)
                if not len(some):
                    continue
                found, keys = matrix @ v.T, batch.column(key).take(pa.array(some))
                if group:  # the best of each group in the block
                    coded = keys.dictionary_encode(null_encoding="encode")
                    codes = coded.indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(codes, kind="stable")
                    found = np.maximum.reduceat(found[:, order], np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0]), axis=1)
                    keys = coded.dictionary
                best.take(found, keys)
        yield from best.batches(names, qtype, key)

    scored = held.mapInArrow(score, f"query_id {kinds[1]}, {key} {kinds[0]}, score double, rounded_ double")
    if group:
        scored = scored.groupBy("query_id", key).agg(F.max("score").alias("score"), F.max("rounded_").alias("rounded_"))
    return ranked(scored, limit, F.desc("rounded_"), F.col(key)).drop("rounded_")


def _unit_rows(names: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at unit length; those of length zero are left out."""
    size = np.linalg.norm(matrix, axis=1)
    return names[size > 0], matrix[size > 0] / size[size > 0, None]


def vector_fetch(queries: DataFrame, chunks: DataFrame, limit: int, include_synthetic: bool = False) -> DataFrame:
    """Exact nearest chunks by cosine. queries: query_id, vector; chunks: with chunk_no and `embedding`, null where there is none."""
    held = chunks.where("embedding is not null")
    if not include_synthetic:
        held = held.where(~F.startswith("doc_id", F.lit("synth-")))
    near = nearest(queries, held.select(F.col("chunk_no").alias("id_"), "embedding"), limit)
    return chunks.drop("embedding").join(near.withColumnRenamed("id_", "chunk_no"), "chunk_no")


def code_fetch(queries: DataFrame, chunks: DataFrame, limit: int = 30) -> DataFrame:
    """Chunks that have one of a query's fault codes, in metadata or text (also with spaces). queries: query_id, codes.

    Articles come first, then chunks with few codes. A hit's codes are its own and all of the query's.
    """
    spaced = F.regexp_extract_all("text", F.lit(r"(?i)F\s*[0-9]\s*E\s*[0-9]"), F.lit(0))
    said = F.transform(spaced, lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))
    each = chunks.withColumn("code", F.explode(F.array_distinct(F.concat(F.coalesce("error_codes", F.array().cast("array<string>")), said))))
    asked = queries.select("query_id", "codes", F.explode("codes").alias("code"))
    keys = each.select("chunk_no", "code").join(small(asked), "code").groupBy("query_id", "chunk_no").agg(F.first("codes").alias("codes"))
    hits = chunks.join(keys, "chunk_no").withColumn("score", F.lit(CODE))
    n = F.size(F.coalesce("error_codes", F.array().cast("array<string>")))
    first = ranked(hits, limit, F.when(F.col("kind") == "article", 0).otherwise(1), n, F.col("doc_id"), F.col("chunk_no"))
    return first.withColumn("error_codes", F.array_sort(F.array_union("error_codes", "codes"))).drop("codes")


def connector_fetch(queries: DataFrame, chunks: DataFrame, limit: int = 20, same_pages: bool = True) -> DataFrame:
    """Chunks that name one of a query's connectors, then longer text beside them. queries: query_id, connectors.

    Neighbours stand on a hit's page of its document; without `same_pages`, on any hit's page of any hit's document.
    """
    named = F.transform(F.regexp_extract_all("text", F.lit("(?i)(J[0-9]+)"), F.lit(1)), F.upper)
    asked = queries.select("query_id", F.explode("connectors").alias("connector"))
    keys = chunks.select("chunk_no", F.explode(F.array_distinct(named)).alias("connector")).join(small(asked), "connector").select("query_id", "chunk_no").distinct()
    seeds = chunks.join(keys, "chunk_no").withColumn("score", F.lit(CONNECTOR))
    parts = F.when(F.col("text").rlike("(?i)motor|stator|harness"), 0).otherwise(1)
    seeds = ranked(seeds, limit, parts, F.desc(F.length("text")), F.col("page"), F.col("doc_id"), F.col("chunk_no")).withColumn("arm_ord", F.lit(0))
    pages = seeds.select("query_id", "doc_id", "page").distinct()
    if not same_pages:
        pages = pages.select("query_id", "doc_id").distinct().join(pages.select("query_id", "page").distinct(), "query_id")
    beside = chunks.where(F.col("kind").isin("heading", "prose", "procedure") & (F.length("text") >= 60) & F.col("text").rlike("(?i)motor|stator|harness|acu"))
    beside = beside.join(pages, ["doc_id", "page"]).withColumn("score", F.lit(NEIGHBOUR))
    beside = ranked(beside, limit, F.desc(F.length("text")), F.col("chunk_no")).withColumn("arm_ord", F.lit(1))
    both = seeds.unionByName(beside)
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "doc_id", "chunk_id").orderBy("arm_ord", "arm_rank"))).where("r = 1").drop("r")
    return ranked(first.withColumnRenamed("arm_rank", "own_rank"), limit, F.col("arm_ord"), F.col("own_rank")).drop("own_rank", "arm_ord")


def reference_fetch(seeds: DataFrame, edges: DataFrame, chunks: DataFrame, installing: DataFrame, limit: int = 8) -> DataFrame:
    """Chunks of the publications that seeds' documents refer to. seeds: query_id, doc_id; installing: query_id, installation."""
    targets = seeds.select("query_id", "doc_id").distinct().join(edges.where("type = 'references'"), "doc_id").select("query_id", F.col("target").alias("publication_number")).distinct()
    hits = chunks.join(targets, "publication_number").join(installing, "query_id").withColumn("score", F.lit(REFERENCE))
    english = F.when(F.coalesce("language", F.lit("en")) == "en", 0).otherwise(1)
    words = F.when(F.col("text").rlike("(?i)shipping|transport bolt|transport bolts|spacer"), 0).when(F.col("installation") & F.col("text").rlike("(?i)shipping|bolt|level|install"), 1).otherwise(2)
    return ranked(hits, limit, english, words, F.col("page"), F.col("chunk_id")).drop("installation")


def manual_revision_fetch(queries: DataFrame, applicable: DataFrame, chunks: DataFrame, limit: int = 12) -> DataFrame:
    """Chunks of applicable service manuals at the revision asked for. queries: query_id, revision, led; applicable: query_id, publication_number."""
    asked = queries.where("revision is not null").withColumnRenamed("revision", "wanted")
    hits = chunks.join(applicable, "publication_number").join(asked, "query_id").where(F.upper("revision") == F.upper("wanted")).withColumn("score", F.lit(REVISION))
    t = F.col("text")
    order = F.when(t.rlike("(?i)status LED"), 0).when(F.col("page") == 44, 1).when(t.rlike("(?i)TEST #1.*ACU Power Check"), 2).when(F.col("led") & t.rlike("(?i)diagnostic led|step 10|blink"), 3).otherwise(4)
    return ranked(hits, limit, order, F.col("page"), F.col("chunk_id")).drop("led", "wanted")


def literal_fetch(queries: DataFrame, chunks: DataFrame, limit: int = 40, rare: int = LITERAL_CHUNKS) -> DataFrame:
    """Chunks that hold a query's literals, those that `rare` chunks at most have. queries: query_id, ask.

    Texts are read once, whatever the number of literals (`containment.holding`).
    """
    asked = queries.select("query_id", F.explode(codes.query_literals(F.col("ask"))).alias("literal"))
    found = settled(holding(chunks.select("chunk_no", F.upper("text").alias("hay")), asked, "chunk_no", "hay", "literal"))
    counts = found.groupBy("literal").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= rare)
    hits = found.join(counts, "literal").join(small(asked), "literal").groupBy("query_id", "chunk_no").agg(F.count(F.lit(1)).alias("n_literals"))
    hits = chunks.join(hits, "chunk_no").withColumn("score", F.lit(LITERAL))
    return ranked(hits, limit, F.col("chunk_no"))


def sibling_fetch(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Table rows of the problems that hits belong to. hits: query_id, doc_id, page, problem_title; chunks: with problem_title."""
    keys = hits.where("problem_title is not null and page is not null").select("query_id", "doc_id", "page", "problem_title").distinct()
    return chunks.where("kind = 'table_row'").join(keys, ["doc_id", "page", "problem_title"])
