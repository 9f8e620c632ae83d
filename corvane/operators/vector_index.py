"""An approximate nearest-neighbour index: inverted lists of a coarse k-means, residual product codes, exact re-ranking.

`fit` learns from a bounded sample of rows, drawn by a hash of their ids: list centres by Lloyd's rounds, whose sums Spark
adds up, and codewords for each of `parts` stretches of the residuals. `build` puts every row into the list of its nearest
centre with one byte a stretch, as a table with a folder for each list. `search` looks into the `probes` lists nearest to a
query: rows of a list are scored, as their codes have them, for all queries that probe it, in blocks of bounded size; the best
`kept` of each query and task go on, and of these the best `kept` of each query to their exact cosines. A folder that no query probes isn't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .arms import CELLS, Best, ranked
from .rows import reach_workers

#: Rows that centres and codewords are learned from at most, and centres at most (a matrix that is broadcast).
SAMPLE, MOST_LISTS = 50_000, 4_096
#: Queries that the lists are searched for at once; a worker holds `kept` rows of each.
BROADCAST_QUERIES = 2_500


@dataclass
class Codebook:
    """Centres of the lists (lists x width) and codewords of the residuals' stretches (parts x 256 x width / parts)."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.words)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return nearest_rows(x, self.centres)

    def encode(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One byte a stretch of each row's residual."""
        rest = (x - self.centres[at]).reshape(len(x), self.parts, -1)
        return np.stack([nearest_rows(rest[:, p], self.words[p]) for p in range(self.parts)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, at: int) -> np.ndarray:
        """The rows of one list as their codes have them."""
        return self.centres[at] + self.words[np.arange(self.parts), codes].reshape(len(codes), -1)


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the lists of `width` entries without nulls, and their places."""
    fit = np.array([i for i, x in enumerate(column.to_pylist()) if x is not None and len(x) == width and None not in x], dtype=np.int64)
    flat = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(np.nan_to_num(flat.reshape(len(fit), width))), fit


def lloyd(rows: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """Centres after some rounds of k-means; a task sums up its rows by centre, and a centre without rows stays where it is."""
    centres = start
    width = start.shape[1]
    for _ in range(rounds):
        now = rows.sparkSession.sparkContext.broadcast(centres)

        def run(batches, now=now):
            c = now.value
            sums, counts = np.zeros_like(c), np.zeros(len(c), dtype=np.int64)
            for batch in batches:
                x, _ = _matrix(batch.column(0), width)
                at = nearest_rows(x, c)
                np.add.at(sums, at, x)
                counts += np.bincount(at, minlength=len(c))
            used = np.flatnonzero(counts)
            i = np.repeat(used, width)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(np.tile(np.arange(width), len(used)), pa.int32()), pa.array(sums[used].ravel()), pa.array(np.repeat(counts[used], width))], names=["c", "d", "s", "n"])

        added = rows.mapInArrow(run, "c int, d int, s double, n long").groupBy("c", "d").agg((F.sum("s") / F.sum("n")).alias("m")).collect()  # lists x width
        centres = centres.copy()
        for r in added:
            centres[r["c"], r["d"]] = r["m"]
    return centres


def fit(vectors: DataFrame, lists: int | None = None, parts: int = 16, rounds: int = 6, sample: int = SAMPLE, seed: int = 7) -> Codebook:
    """A codebook of vectors(id_, embedding), learned from `sample` rows at most. `lists`: the root of the rows' number by default."""
    reach_workers(vectors.sparkSession)
    held = vectors.where("size(embedding) > 0").select("id_", F.col("embedding").cast("array<double>").alias("embedding"))
    n = held.count()
    some = held.orderBy(F.xxhash64(F.lit(seed), F.col("id_"))).limit(sample).select("embedding")
    rows = [r["embedding"] for r in some.collect()]  # `sample` rows
    width = max((len(r) for r in rows), default=0)
    x = unit(np.nan_to_num(np.array([r for r in rows if len(r) == width and None not in r], dtype=np.float64).reshape(-1, width)))
    k = min(MOST_LISTS, len(x), lists or max(1, round(n**0.5)))
    if not k or width % parts:
        raise ValueError(f"{len(x)} vectors of width {width}: the width must be a multiple of {parts}")
    rng = np.random.default_rng(seed)
    centres = lloyd(held.where(F.size("embedding") == width).select("embedding") if n <= sample else some, x[rng.choice(len(x), k, replace=False)], rounds)
    rest = (x - centres[nearest_rows(x, centres)]).reshape(len(x), parts, -1)
    words = np.stack([_codewords(rest[:, p], rng, rounds) for p in range(parts)])
    return Codebook(centres, words)


def _codewords(x: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    c = x[rng.choice(len(x), 256, replace=len(x) < 256)]
    for _ in range(rounds):
        at = nearest_rows(x, c)
        counts = np.bincount(at, minlength=256)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def build(vectors: DataFrame, book: Codebook, path: str) -> None:
    """Writes the index of all of vectors(id_, embedding) that have the book's width: id_, code and list, a folder for each list."""
    held = vectors.sparkSession.sparkContext.broadcast(book)
    width = book.centres.shape[1]
    rows = vectors.where(F.size("embedding") == width).select("id_", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches):
        b = held.value
        for batch in batches:
            x, fit_ = _matrix(batch.column(1), width)
            at = b.assign(x)
            codes = b.encode(x, at) if len(x) else np.zeros((0, b.parts), dtype=np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fit_)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(at, pa.int32())], names=["id_", "code", "list"])

    coded = rows.mapInArrow(run, f"id_ {rows.schema['id_'].dataType.simpleString()}, code binary, list int")
    # a list has a few files; a list of very many rows is dealt to several tasks
    coded.repartition("list", F.pmod(F.xxhash64("id_"), F.lit(4))).write.partitionBy("list").mode("overwrite").parquet(path)


def search(queries: DataFrame, vectors: DataFrame, book: Codebook, path: str, limit: int, probes: int | None = None, kept: int = 200) -> DataFrame:
    """query_id, id_, score (exact cosine) and arm_rank of the nearest rows that the index at `path` finds. queries: query_id, vector.

    By default three in four lists are probed, which finds over nine in ten of the nearest even where vectors have no
    clusters (random directions); where they have, few lists do. Queries are taken in blocks of BROADCAST_QUERIES.
    """
    spark = queries.sparkSession
    reach_workers(spark)
    width = book.centres.shape[1]
    probes = probes or -(-3 * len(book.centres) // 4)
    asked = queries.where(F.size("vector") == width).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    total = asked.count()
    if total > BROADCAST_QUERIES:
        blocks = -(-total // (BROADCAST_QUERIES // 2))
        out = None
        for i in range(blocks):
            part = search(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), vectors, book, path, limit, probes, kept)
            out = part if out is None else out.unionByName(part)
        return out
    rows = asked.collect()
    names = [r["query_id"] for r in rows]
    q = unit(np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), width))
    near = np.argsort(-(q @ book.centres.T - (book.centres**2).sum(axis=1) / 2), axis=1, kind="stable")[:, :probes]
    probing = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
    held = spark.sparkContext.broadcast((book, q, names, probing))
    kinds = asked.schema["query_id"].dataType, vectors.schema["id_"].dataType
    id_type, name_type = to_arrow_type(kinds[1]), to_arrow_type(kinds[0])
    index = spark.read.schema(f"id_ {kinds[1].simpleString()}, code binary, list int").parquet(path).where(F.col("list").isin([int(c) for c in probing]))

    def score(batches):
        b, q, names, probing = held.value
        best = Best(len(names), kept)
        for batch in batches:
            lists = batch.column("list").to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(-1, b.parts)
            for c in np.unique(lists):
                mine, who = np.flatnonzero(lists == c), probing[int(c)]
                for low in range(0, len(mine) if len(who) else 0, max(1, CELLS // max(1, len(who)))):
                    some = mine[low : low + max(1, CELLS // len(who))]
                    best.take(q[who] @ b.decode(codes[some], int(c)).T, batch.column("id_").take(pa.array(some)).cast(id_type), who)
        yield from best.batches(np.array(names, dtype=object), name_type, "id_")

    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("id_", kinds[1]), T.StructField("score", T.DoubleType()), T.StructField("rounded_", T.DoubleType())])
    first = ranked(index.mapInArrow(score, schema), kept, F.desc("rounded_"), F.col("id_")).select("query_id", "id_")
    return ranked(_exact(first, asked, vectors), limit, F.desc(F.round("score", 12)), F.col("id_"))


def _exact(pairs: DataFrame, asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs with their exact cosine."""
    from .arms import cosine

    both = pairs.join(asked, "query_id").join(vectors.select("id_", F.col("embedding").cast("array<double>").alias("embedding")), "id_")
    return both.select("query_id", "id_", cosine("vector", "embedding").alias("score"))


def recall(found: DataFrame, exact: DataFrame, key: str = "id_") -> DataFrame:
    """One row: recall, the share of the exact pairs (query_id, key) that were found."""
    both = exact.select("query_id", key).join(found.select("query_id", key).withColumn("f_", F.lit(1)), ["query_id", key], "left")
    return both.agg((F.count("f_") / F.count(F.lit(1))).alias("recall"))
