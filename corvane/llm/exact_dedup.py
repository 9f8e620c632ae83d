"""Operator 10: exact duplicates through an extendible-hash index on shared files.

1. Segments. Each map task reads documents batch by batch, normalises texts, and writes index entries to
   files in the shared folder: hash, digest, row number, and, for rows that are the best of their text in the task
   so far, the row itself. So a text that makes up a third of all rows leaves one full entry a task, or a few.
2. Directory. It starts with one bucket. From the full entries' sizes by hash prefix, buckets over `bucket_bytes` are
   split, the directory doubling whenever a bucket needs more bits than it has; while buckets are overfull at the
   prefix's end, longer prefixes of theirs are counted. A bucket that holds one hash only is not split.
3. Owners. Runs of neighbouring buckets of `bucket_bytes` together have one owner task each, so a range of hashes, which
   reads its entries in order of hash. Entries with the same hash are chained: an entry joins the link whose normalised
   bytes equal its own, else it makes a new link. A link keeps the best row; one link is held per different
   text with the same 64-bit hash, so memory doesn't grow with copies. A bucket of one hash that is overfull is first
   dealt to several owners by row, and what they leave is chained once more.
"""

from __future__ import annotations

import hashlib
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, fresh, materialise, require

#: What normalisation deletes: [\x20\x09-\x0D].
WHITE = b" \t\n\x0b\x0c\r"
#: The directory has at most 2 ** MAX_DEPTH slots, and DEEPER bits more than equal buckets would need; buckets that are
#: still overfull there (many texts with one hash, nearly) are read in order of hash like others.
MAX_DEPTH, DEEPER = 24, 10
#: Buckets grow with tables of more than 2 ** MOST_BUCKETS buckets (32 MB each: 4 TB of different texts), so that the
#: directory, its counts on the driver and its broadcast pages don't; they are read in order of hash, so by streaming.
MOST_BUCKETS = 17
#: Bits that a count of entries looks ahead.
AHEAD = 4
#: Texts whose best row a map task remembers; when full, it starts afresh, which leaves some more full entries.
REMEMBERED = 200_000


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


def key_hash(norm: bytes) -> int:
    """The index's hash, as a signed long."""
    x = xxhash.xxh64_intdigest(norm, 42)
    return x - (1 << 64) if x >> 63 else x


class _Names:
    """Names of the index's own columns beside those of the documents."""

    def __init__(self, taken: list[str]):
        self.h, self.sha, self.rid, self.id, self.lead, self.size = fresh(taken, "h_", "sha_", "rid_", "id_", "lead_", "size_")


def _better(a: tuple, b: tuple) -> bool:
    """Whether row a = (code points, doc_id, row number) goes before b: more code points, then the smaller id, none last."""
    return (-a[0], a[1] is None, a[1] if a[1] is not None else 0, a[2]) < (-b[0], b[1] is None, b[1] if b[1] is not None else 0, b[2])


def segments(docs: DataFrame, doc_id: str, text: str, hasher=key_hash) -> tuple[DataFrame, _Names]:
    """Index entries, one per row of `docs`, in files of the shared folder."""
    n = _Names(docs.columns)
    at_id, at_text, fields = docs.columns.index(doc_id), docs.columns.index(text), docs.schema.fields
    own = [
        T.StructField(n.h, T.LongType()), T.StructField(n.sha, T.StringType()), T.StructField(n.rid, T.LongType()),
        T.StructField(n.id, fields[at_id].dataType), T.StructField(n.lead, T.BooleanType()), T.StructField(n.size, T.LongType()),
    ]
    names = [*docs.columns, *(f.name for f in own)]

    def run(batches):
        row = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        best: dict[bytes, tuple] = {}  # of the texts met so far
        for batch in batches:
            ids = batch.column(at_id).to_pylist()
            digests, hashes, sizes = [], [], []
            leads: dict[bytes, int] = {}
            for i, x in enumerate(batch.column(at_text).to_pylist()):
                norm = normalised(x)
                digest = hashlib.sha256(norm)
                digests.append(digest.hexdigest())
                hashes.append(hasher(norm))
                sizes.append(len(norm))
                mine, key = (len(x or ""), ids[i], row + i), digest.digest()
                if key not in best or _better(mine, best[key]):
                    best[key], leads[key] = mine, i
            lead = [False] * len(ids)
            for i in leads.values():
                lead[i] = True
            take = pa.array([i if yes else None for i, yes in enumerate(lead)], type=pa.int64())
            arrays = [c.take(take) for c in batch.columns]
            arrays += [pa.array(hashes, pa.int64()), pa.array(digests), pa.array(range(row, row + len(ids)), pa.int64()), batch.column(at_id), pa.array(lead), pa.array(sizes, pa.int64())]
            row += len(ids)
            if len(best) > REMEMBERED:
                best.clear()
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = [T.StructField(f.name, f.dataType, True) for f in fields]
    return materialise(arrow_map(docs, run, T.StructType([*fields, *own])), "segments"), n


class Directory:
    """2 ** depth slots by the first bits of a hash, each with its bucket. A bucket is (prefix, local depth).

    All slots of a bucket are one run, so the buckets stand for the slots, of which there may be many more.
    """

    def __init__(self):
        self.depth, self.buckets = 0, [(0, 0)]

    def split(self, b: int) -> int:
        """Splits bucket b by one more bit; returns the new one, with the upper half. The directory doubles if b has all its bits."""
        prefix, d = self.buckets[b]
        if d == self.depth:
            self.depth += 1
        self.buckets[b] = (2 * prefix, d + 1)
        self.buckets.append((2 * prefix + 1, d + 1))
        return len(self.buckets) - 1

    def grow(self, todo: list[int], counts: np.ndarray | list[tuple[int, int, int]], depth: int, capacity: int) -> dict[int, tuple[int, int]]:
        """Splits overfull buckets of `todo` as far as counts of (prefix of `depth` bits, bytes, 1 or 2 for several
        hashes), in order, tell. Returns the bytes and hashes (1 or more) of each bucket that comes of them."""
        counts = np.asarray(counts, dtype=np.int64).reshape(-1, 3)
        at = counts[:, 0]
        size, keys = (np.concatenate(([0], np.cumsum(counts[:, k]))) for k in (1, 2))
        todo, held = list(todo), {}
        while todo:
            b = todo.pop()
            prefix, d = self.buckets[b]
            low, high = np.searchsorted(at, [prefix << (depth - d), (prefix + 1) << (depth - d)])
            held[b] = (int(size[high] - size[low]), int(keys[high] - keys[low]))
            if held[b][0] > capacity and held[b][1] > 1 and d < depth:
                todo += [b, self.split(b)]
        return held

    def first_slot(self, b: int) -> int:
        prefix, d = self.buckets[b]
        return prefix << (self.depth - d)

    def in_order(self) -> list[int]:
        """The buckets' numbers in order of hash."""
        return sorted(range(len(self.buckets)), key=self.first_slot)

    @property
    def slots(self) -> np.ndarray:
        """Each slot's bucket, written out."""
        order = self.in_order()
        return np.repeat(np.array(order, dtype=np.int64), [1 << (self.depth - self.buckets[b][1]) for b in order])


def directory(counts: list[tuple[int, int, int]], depth: int, capacity: int) -> list[tuple[int, int]]:
    """The buckets, in order of hash, of a directory grown by counts of prefixes (in order)."""
    d = Directory()
    d.grow([0], counts, depth, capacity)
    return [d.buckets[b] for b in d.in_order()]


def owners(sizes: list[int], hot: list[int], capacity: int) -> tuple[list[int], int]:
    """The first owner of each bucket, and the number of owners: runs of buckets of `capacity` together. `hot`: owners that a bucket needs for itself (0: none)."""
    out, owner, held = [], 0, 0
    for size, several in zip(sizes, hot):
        if held and (several or held + size > capacity):
            owner, held = owner + 1, 0
        out.append(owner)
        if several:
            owner += several
        else:
            held += max(size, 1)
    return out, owner + bool(held)


def total_bytes(entries: DataFrame, n: _Names) -> int:
    return entries.agg(F.sum(F.col(n.size) + 1)).first()[0] or 0


def pages(d: Directory, order: list[int], first: list[int], several: list[int]) -> tuple[pa.Table, int]:
    """The buckets by the first bits of a hash, and the number of these bits: page_, and the first slot, first owner and
    owners (0: one) of each of its buckets in order. A bucket over many pages is in each; there are at most two pages a bucket."""
    bits = min(d.depth, len(order).bit_length())
    starts = np.array([d.first_slot(b) for b in order], dtype=np.int64)
    edges = np.arange((1 << bits) + 1, dtype=np.int64) << (d.depth - bits)
    low, high = np.searchsorted(starts, edges[:-1], "right") - 1, np.searchsorted(starts, edges[1:], "left")
    offsets = np.concatenate(([0], np.cumsum(high - low)))
    each = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - low, high - low)
    lists = {c: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.asarray(v)[each], t)) for c, v, t in (("starts_", starts, pa.int64()), ("first_", first, pa.int32()), ("fan_", several, pa.int32()))}
    return pa.table({"page_": pa.array(np.arange(1 << bits), pa.int64()), **lists}), bits


def build_directory(entries: DataFrame, n: _Names, capacity: int) -> tuple[Directory, dict[int, tuple[int, int]]]:
    """A directory of the entries' hashes, and the bytes and hashes (1 or more) of each bucket.

    The driver gets counts by prefix, three longs each: about `2 ** AHEAD` for each bucket of a directory of even buckets.
    """
    spark, total = entries.sparkSession, total_bytes(entries, n)
    d, held, todo = Directory(), {0: (0, 0)}, [0]
    even = ceil(total / capacity).bit_length()
    depth, deepest = min(MAX_DEPTH, even + AHEAD), min(MAX_DEPTH, even + DEEPER)
    while todo:
        rows = entries.select(F.shiftrightunsigned(F.col(n.h), 64 - depth).alias("slot"), F.col(n.h).alias("h"), F.col(n.size).alias("b"))
        if d.depth:  # entries of the buckets at hand only
            some = spark.createDataFrame([(d.buckets[b][0] << (depth - d.buckets[b][1]), (d.buckets[b][0] + 1) << (depth - d.buckets[b][1])) for b in todo], "low long, high long")
            width = depth - max(d.buckets[b][1] for b in todo)  # buckets that don't fit have all bits that there were
            rows = rows.join(F.broadcast(some.select(F.shiftrightunsigned("low", width).alias("top"))), F.shiftrightunsigned("slot", width) == F.col("top"), "left_semi")
        sums = rows.groupBy("slot").agg(F.sum(F.col("b") + 1).alias("b"), F.when(F.min("h") == F.max("h"), 1).otherwise(2).alias("k"))
        found = sums.toArrow()
        counts = np.stack([found.column(c).cast(pa.int64()).to_numpy() for c in ("slot", "b", "k")], axis=1).reshape(-1, 3)
        held |= d.grow(todo, counts[np.argsort(counts[:, 0])], depth, capacity)
        # overfull buckets of several hashes that have all bits counted
        todo = [b for b, (size, keys) in held.items() if size > capacity and keys > 1 and d.buckets[b][1] == depth < deepest]
        depth = min(deepest, depth + AHEAD)
    return d, held


def index_entries(entries: DataFrame, n: _Names, bucket_bytes: int) -> tuple[DataFrame, bool]:
    """Full entries with their owners, by the directory, in order of hash; and whether some hash has several owners (column hot_)."""
    spark = entries.sparkSession
    bucket_bytes = max(bucket_bytes, total_bytes(entries, n) >> MOST_BUCKETS)
    d, held = build_directory(entries, n, bucket_bytes)
    order = d.in_order()
    sizes = [held.get(b, (0, 0))[0] for b in order]
    several = [-(-size // bucket_bytes) if size > bucket_bytes and held[b][1] == 1 else 0 for b, size in zip(order, sizes)]
    first, tasks = owners(sizes, several, bucket_bytes)
    index, bits = pages(d, order, first, several)  # broadcast: two pages a bucket at most
    slot = F.shiftrightunsigned(F.col(n.h), 64 - d.depth) if d.depth else F.lit(0).cast("long")
    page = F.shiftrightunsigned(F.col(n.h), 64 - bits) if bits else F.lit(0).cast("long")
    routed = entries.join(F.broadcast(spark.createDataFrame(index)), page == F.col("page_"))
    place = F.size(F.filter("starts_", lambda x: x <= slot)) - 1
    routed = routed.select(*[F.col(f"`{c}`") for c in entries.columns], F.get("first_", place).alias("first_"), F.get("fan_", place).alias("fan_"))
    owner = F.col("first_") + F.when(F.col("fan_") > 0, F.pmod(F.xxhash64(n.rid), F.col("fan_"))).otherwise(0).cast("int")
    routed = routed.select(*[F.col(f"`{c}`") for c in entries.columns], (F.col("fan_") > 0).alias("hot_"), owner.alias("owner_"))
    return routed.repartitionById(max(1, tasks), F.col("owner_")).sortWithinPartitions(n.h).drop("owner_"), any(several)


def chained(entries: DataFrame, n: _Names, text: str) -> DataFrame:
    """The best row of each different text, of entries that come in order of hash in each partition."""
    at = {c: entries.columns.index(c) for c in (n.h, n.rid, n.id, text)}

    def own(batches):
        chain: list[list] = []  # of the hash at hand: [bytes, best row's key, its batch, its place there]
        now = None

        def put(kept):
            """Rows of the links in `kept`, batch by batch."""
            by: dict[int, tuple] = {}
            for link in kept:
                by.setdefault(id(link[2]), (link[2], []))[1].append(link[3])
            for batch, rows in by.values():
                yield batch.take(pa.array(rows, pa.int64()))

        for batch in batches:
            done: list[list] = []
            hashes, rids, ids, texts = (batch.column(at[c]).to_pylist() for c in (n.h, n.rid, n.id, text))
            for i, h in enumerate(hashes):
                if h != now:
                    done += chain
                    chain, now = [], h
                norm, mine = normalised(texts[i]), (len(texts[i] or ""), ids[i], rids[i])
                for link in chain:
                    if link[0] == norm:
                        if _better(mine, link[1]):
                            link[1:4] = mine, batch, i
                        break
                else:
                    chain.append([norm, mine, batch, i])
            yield from put(done)
            for link in chain:  # keeps one row, not the whole batch, until the next
                if link[2].num_rows > 1:
                    link[2], link[3] = link[2].take(pa.array([link[3]], pa.int64())), 0
        yield from put(chain)

    return arrow_map(entries, own, entries.schema)


def groups(docs: DataFrame, doc_id: str, text: str, bucket_bytes: int = 32 << 20, hasher=key_hash) -> tuple[DataFrame, DataFrame, _Names]:
    """(entries of all rows, one row per different text with its best row's columns, names of index columns).

    The second has the index's hash, digest, and the best row's row number and id.
    """
    entries, n = segments(docs, doc_id, text, hasher)
    full, hot = index_entries(entries.where(F.col(n.lead)), n, bucket_bytes)
    kept = chained(full, n, text)
    if hot:  # what several owners of one hash have left goes to one
        kept = materialise(kept, "kept")
        again = kept.where("hot_").repartition(F.col(n.h)).sortWithinPartitions(n.h)
        kept = kept.where("not hot_").unionByName(chained(again, n, text))
    return entries, kept.drop("hot_"), n


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = 32 << 20, hasher=key_hash) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal if they are identical without white space; a null text counts as empty, and empty texts
    form one group. Of a group the row with the most code points stays, then the smallest doc_id (rows
    without one come last); of rows that tie even there exactly one is kept. An empty table gives an empty
    result. Other columns are not read.
    """
    require(docs, doc_id, text)
    entries, kept, n = groups(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", bucket_bytes, hasher)
    rows = entries.select(F.col(n.id).alias("doc_id"), F.col(n.h).alias("h"), F.col(n.sha).alias("s"), F.col(n.rid).alias("rid"))
    copies = rows.groupBy("h", "s").agg(F.count(F.lit(1)).alias("group_size"))
    stays = kept.select(F.col(n.h).alias("h"), F.col(n.sha).alias("s"), F.col(n.id).alias("keep_id"), F.col(n.rid).alias("keep")).join(copies.hint("merge"), ["h", "s"])
    stays = materialise(stays, "stays")
    return rows.join(stays.hint("merge"), ["h", "s"]).select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep")).alias("kept"), F.col("s").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = 32 << 20) -> DataFrame:
    """The rows of `docs` that `exact_duplicates` keeps, with all their columns."""
    _, kept, _ = groups(docs, doc_id, text, bucket_bytes)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
