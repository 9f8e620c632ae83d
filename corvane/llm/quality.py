"""Operator 1: quality by importance resampling.

Words and word pairs are hashed to `buckets` buckets; a bag-of-hashes model is fitted to raw text (all
documents) and one to target text (rows labelled good). A document's log weight is the sum, over its
n-grams, of the log ratio of the two models. Documents are resampled without replacement, with chances in
proportion to their weights, by taking those with the largest sum of log weight and Gumbel noise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, at_task_end, materialise, require
from .selection import first_k

BUCKETS = 10_000
#: Words whose hashes are kept by a worker, and words handled at once.
CACHE, BLOCK = 500_000, 1 << 17
_words: dict[bytes, int] = {}
at_task_end(_words.clear)


def gram_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray | None:
    """Counts of hashed words and word pairs (A-Z lower-cased, split at white space); None without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return None
    out, last = np.zeros(buckets, dtype=np.int64), None
    for at in range(0, len(tokens), BLOCK):
        part = tokens[at : at + BLOCK]
        if len(_words) + len(part) > CACHE:
            _words.clear()
        for w in set(part):
            if w not in _words:
                _words[w] = xxhash.xxh64_intdigest(w, 1)
        h = np.fromiter(map(_words.__getitem__, part), dtype=np.uint64, count=len(part))
        line = h if last is None else np.concatenate((last, h))
        with np.errstate(over="ignore"):
            pairs = (line[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (line[1:] + np.uint64(0x632BE59BD9B4E019))
            pairs ^= pairs >> np.uint64(29)
        out += np.bincount((np.concatenate((h, pairs)) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        last = h[-1:]
    return out


def fit(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, target_rows: int = 50_000, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of each bucket's probability in target text to that in raw text.

    Raw counts are over all of `docs`; the target is the documents whose id is in `target`, of which
    `target_rows` at most are taken (the first by hash). The driver gets two counts a bucket.
    """
    require(docs, doc_id, text)
    ids = target.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("k")).distinct().orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(target_rows)
    # broadcast: target_rows ids
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text")).join(F.broadcast(ids.withColumn("good", F.lit(True))), "k", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches):
        raw, good = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for x, yes in zip(*(c.to_pylist() for c in batch.columns)):
                if (n := gram_counts(x, buckets)) is not None:
                    raw += n
                    if yes:
                        good += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["b", "raw", "good"])

    got = arrow_map(rows, count, "b int, raw long, good long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for r in got:
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["good"]
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def resample(docs: DataFrame, ratios: np.ndarray, fraction: float, doc_id: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """One row per row of `docs`: doc_id, n_grams, log_weight, gumbel_key, kept.

    `kept` is true of the ceil(fraction * rows) rows with the largest key, exactly; ties are broken by noise, and
    rows with one doc_id and text, which tie even there, by row number. Noise comes from a hash of doc_id, whole text and seed. A null or empty text has no n-grams and
    log weight 0; repeated rows stay and may both be kept; an empty table gives an empty result.
    """
    require(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text)).alias("noise"), F.col(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        r = model.value
        for batch in batches:
            n, w = [], []
            for x in batch.column(2).to_pylist():
                c = gram_counts(x, len(r))
                n.append(0 if c is None else int(c.sum()))
                w.append(0.0 if c is None else float(c @ r))
            u = (np.asarray(batch.column(1)).view(np.uint64) >> np.uint64(11)).astype(np.float64)
            key = np.array(w) - np.log(-np.log((u + 0.5) / (1 << 53)))
            bits = key.view(np.int64)
            order = ~(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))  # largest key first
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(key), pa.array(order), batch.column(1)], names=["doc_id", "n_grams", "log_weight", "gumbel_key", "o_", "t_"])

    scored = arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_grams long, log_weight double, gumbel_key double, o_ long, t_ long")
    scored = materialise(scored.withColumn("rid_", F.monotonically_increasing_id()), "weights")
    k = int(np.ceil(fraction * scored.count()))
    return scored.withColumn("kept", first_k(scored, ["o_", "t_", "rid_"], k)).drop("o_", "t_", "rid_")
