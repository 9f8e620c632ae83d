"""Operator 3: SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; a point of the grid has each segment's number of
set bits. The Manhattan distance of two points never exceeds the Hamming distance of their fingerprints,
since a segment whose counts differ by d has at least d differing bits. In unary coding (0, 01, 11) the
whole point is one long, and Manhattan distance is the bit count of an exclusive or.

The range join under that distance: segments are put in `groups` groups; a distance of at most `bits`
leaves at least `groups - bits` groups without any difference, so two points in range meet in a cell of
one of the C(groups, bits) projections of the grid. Points that meet are held to the Manhattan bound, then
to the exact Hamming distance. Fingerprints are made distinct first, so copies cost one point.

A cell with more than `cell_limit` different fingerprints is not joined with itself. Its fingerprints are
linked exactly by their one-bit neighbourhoods instead: fingerprints at most two bits apart share a value
at most one bit from both, and all that share such a value are at most two bits apart, so linking each to
the smallest of them gives the same components with a number of links in proportion to the rows.

Near copies by Jaccard similarity (`drop_near_duplicates`) differ in about ten bits of 64 at a similarity of 0.8, too
many for the grid, and no number of bits holds for all of them: a shingle that a text repeats counts each time in its
fingerprint and once in its set. So candidates are met there by what sets that are similar enough must share, the first of
their shingles in one order of all (`with_firsts`), and verified exactly on the shingles of whole texts.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, discard, fresh, materialise, require
from .components import connected_components

#: Counts by which shingles are put in order, and how many of them are in a row.
COUNTS, COUNTS_ROW = 1 << 20, 1 << 14
#: Shingles of a crowded cell's rows, on either side, that meet in one task's group.
GROUP_SHINGLES = 1 << 17
#: Shingles whose bits are counted at once; bounds memory for very long texts.
BLOCK = 1 << 15
ODD_BITS = 0x5555555555555555


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of each `words`-word shingle, repeats included, of a text with A-Z lower-cased."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    ends = list(accumulate(len(t) + 1 for t in tokens))
    starts = [0, *ends]
    parts = [line[a : b - 1] for a, b in zip(starts, ends[words - 1 :])]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), dtype=np.uint64, count=len(parts))


def _majority(h: np.ndarray) -> int:
    """The unsigned value whose bits are those set in over half of `h`; none: 0."""
    if not len(h):
        return 0
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), BLOCK):
        count += np.unpackbits(octets[at : at + BLOCK], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * count > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint; a bit is set if it is set in over half the shingles' hashes. No words: 0."""
    return _majority(shingle_hashes(text or "", words, seed))


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42, name: str = "fp") -> DataFrame:
    """`docs` and a column `name` (long; the fingerprint's 64 bits). A null text counts as one without words."""
    require(docs, text)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(x, words, seed) for x in batch.column(at).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], names=[*batch.schema.names, name])

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _counted(h: np.ndarray) -> np.ndarray:
    """The number of the count that each shingle is counted in."""
    return (h >> np.uint64(40)).astype(np.int64) & (COUNTS - 1)


def shingle_counts(rows: DataFrame, text: str, words: int, seed: int) -> np.ndarray:
    """How many texts have a shingle of each of COUNTS counts, where many shingles share a count: enough to tell frequent ones."""
    require(rows, text)

    def run(batches):
        held, new, n = np.zeros(COUNTS, dtype=np.int64), [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                new.append(np.unique(shingle_hashes(x or "", words, seed)))
                n += len(new[-1])
                if n > COUNTS:
                    held += np.bincount(_counted(np.concatenate(new)), minlength=COUNTS)
                    new, n = [], 0
        if new:
            held += np.bincount(_counted(np.concatenate(new)), minlength=COUNTS)
        for part, counts in enumerate(held.reshape(-1, COUNTS_ROW)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["part", "counts"])

    def added(table):
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table["counts"].to_pylist())
        return pa.table([table["part"].combine_chunks()[:1], pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    each = arrow_map(rows.select(text), run, "part int, counts binary")
    out = np.zeros((COUNTS // COUNTS_ROW, COUNTS_ROW), dtype=np.int64)
    for r in each.groupBy("part").applyInArrow(added, "part int, counts binary").collect():  # COUNTS numbers in all
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return np.minimum(out.reshape(-1), 2**32 - 1).astype(np.uint32)


def firsts(h: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """Of a set of shingles those that sets of the similarity can't all lack: the first ones by `counts`, then hash, all but the least overlap, and one. No shingles: zero."""
    if not len(h):
        return np.zeros(1, dtype=np.uint64)
    order = np.lexsort((h, counts[_counted(h)]))
    return h[order[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]]


def with_firsts(rows: DataFrame, counts: np.ndarray, similarity: float, words: int, seed: int) -> DataFrame:
    """`rows(rid, text)` -> k, rid and size: a row for each of the `firsts` of the text's shingles, and the number of its different shingles.

    Two sets with the similarity have so many shingles in common that the first of these, in any order that is the same for
    all, is among the firsts of both. Where rare shingles come first, few others share them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for batch in batches:
            keys, sizes = [], []
            for x in batch.column(1).to_pylist():
                h = np.unique(shingle_hashes(x or "", words, seed))
                keys.append(firsts(h, shared.value, similarity))
                sizes.append(len(h))
            n = np.array([len(k) for k in keys])
            k = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column(0).take(at), pa.array(sizes, pa.int32()).take(at)], names=["k", "rid", "size"])

    return arrow_map(rows.select("rid", "text"), run, "k long, rid long, size int")


def comparable(nu, nv, similarity: float):
    """Whether two rows can have the similarity, by their numbers of shingles."""
    return F.least(nu, nv) >= F.greatest(nu, nv) * similarity - 1e-9


def promising(met: DataFrame, similarity: float) -> DataFrame:
    """`met(u, v, nu, nv)`, a row for each of the `firsts` that two rows share, and their sizes -> (u, v): pairs that share enough of them to have the similarity.

    Of what two sets have in common, all up to the last of the one's firsts is among the other's too; after it come as many
    of its shingles as the least overlap takes, less one.
    """
    each = met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"), F.first("nu").alias("nu"), F.first("nv").alias("nv"))
    least = F.ceil((F.col("nu") + F.col("nv")) * (similarity / (1 + similarity)) - 1e-9)
    return each.where(F.col("n") >= least - F.ceil(F.greatest("nu", "nv") * similarity - 1e-9) + 1).select("u", "v")


def similar(pairs: DataFrame, rows: DataFrame, similarity: float, words: int, seed: int) -> DataFrame:
    """Of `pairs(u, v)`, rids of `rows(rid, text)`, those whose shingle sets have that Jaccard similarity at least."""

    def shingles(x):
        return frozenset(shingle_hashes(x or "", words, seed).tolist())

    def run(batches):
        held, other = None, frozenset()
        for batch in batches:
            keep = []
            for v, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if v != held:  # rows come in order of v
                    held, other = v, shingles(b)
                own = shingles(a)
                both = len(own & other)
                keep.append(both >= similarity * (len(own) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    asked = pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct()
    texts = materialise(rows.select("rid", "text").join(asked, "rid", "left_semi"), "texts")
    side = lambda c: texts.select(F.col("rid").alias(c), F.col("text").alias(f"t{c}")).hint("merge")
    found = materialise(arrow_map(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "tu", "tv"), run, "u long, v long"), "linked")
    discard(texts)
    return found


def across(rows: DataFrame, similarity: float) -> DataFrame:
    """rows(k, rid, c, size) -> (u, v, nu, nv): comparable rows of one cell k and different components c, and their sizes."""
    a, b = (rows.select("k", *[F.col(c).alias(f"{c}_{side}") for c in ("rid", "c", "size")]) for side in "uv")
    met = (F.col("rid_u") > F.col("rid_v")) & (F.col("c_u") != F.col("c_v")) & comparable(F.col("size_u"), F.col("size_v"), similarity)
    return a.withColumnRenamed("k", "k_").join(b.hint("merge"), (F.col("k_") == F.col("k")) & met).select(F.col("rid_u").alias("u"), F.col("rid_v").alias("v"), F.col("size_u").alias("nu"), F.col("size_v").alias("nv"))


def with_sets(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """`texts(rid, text)` -> rid and `set` (binary): the different hashes of the text's shingles, in order."""

    def run(batches):
        for batch in batches:
            made = [np.unique(shingle_hashes(x or "", words, seed)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["rid", "set"])

    return arrow_map(texts.select("rid", "text"), run, "rid long, set binary")


def first_links(rows: pa.Table, similarity: float) -> pa.Table:
    """rows(rid, c, main, asks, set) -> (u, v, cu, cv): links of rows that ask with the others, until no pair of different components is left to compare.

    A set's similarity to all others comes from lists of the rows by shingle. As a row that is similar enough has one of any
    few of a set's shingles (all but the least overlap, and one), those of the rarest are looked up first.
    """
    rows = rows.combine_chunks()
    asks = rows["asks"].to_numpy(zero_copy_only=False)
    rid, main = (rows[c].to_numpy(zero_copy_only=False) for c in ("rid", "main"))
    names, code = np.unique(rows["c"].to_numpy(), return_inverse=True)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["set"].to_pylist()]
    label = np.arange(len(names))  # components that are one by the links found here have one label
    held = np.flatnonzero(~asks)
    size = np.array([len(sets[i]) for i in held])
    all_ = np.concatenate([sets[i] for i in held]) if len(held) else np.empty(0, np.uint64)
    order = np.argsort(all_, kind="stable")
    lists, owner = all_[order], np.repeat(np.arange(len(held)), size)[order]

    def owners(low, high):
        n = high - low
        return owner[np.arange(n.sum()) + np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n)]

    found = []
    for i in np.flatnonzero(asks):
        own, n = sets[i], len(sets[i])
        # of two rows that both ask the larger id does
        open_ = (label[code[held]] != label[code[i]]) & (main[held] | (rid[held] < rid[i])) & (np.minimum(size, n) >= np.maximum(size, n) * similarity - 1e-9)
        if not open_.any():
            continue
        low, high = np.searchsorted(lists, own, "left"), np.searchsorted(lists, own, "right")
        rarest = np.argsort(high - low, kind="stable")[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
        can = np.zeros(len(held), dtype=bool)
        can[owners(low[rarest], high[rarest])] = True
        can &= open_
        if not can.any():
            continue
        both = np.bincount(owners(low, high), minlength=len(held))
        for j in np.flatnonzero(can & (both >= similarity * (n + size - both))):
            a, b = label[code[i]], label[code[held[j]]]
            if a != b:
                found.append((rid[i], rid[held[j]], names[code[i]], names[code[held[j]]]))
                label[label == a] = b
    return pa.table([pa.array(list(x), pa.int64()) for x in (zip(*found) if found else [()] * 4)], names=["u", "v", "cu", "cv"])


def crowd_links(cells: DataFrame, texts: DataFrame, similarity: float, words: int, seed: int, bits: int = 64, room: int = GROUP_SHINGLES) -> DataFrame:
    """`cells(k, rid, c)`, rids of `texts(rid, text, size)` -> (u, v, cu, cv): rows of one cell, comparable, of different components and with the similarity; of pairs that join the same components, one at least. No pair is left out by its fingerprints' `bits`.

    Rows outside a cell's largest component ask all of the cell. Both sides are dealt into blocks of `room` shingles, and each
    two blocks meet in a group of their own, so that neither a cell nor a pair of rows is held or made anywhere: what is
    dealt are rows times blocks. The comparisons are the square of a cell's rows only where they stay apart.
    """
    if bits < 64:
        raise ValueError("no number of bits under 64 keeps all similar pairs")
    sets = materialise(with_sets(texts.join(cells.select("rid").distinct(), "rid", "left_semi"), words, seed), "sets")
    each = cells.join(texts.select("rid", "size").hint("merge"), "rid").groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    blocks = lambda s: F.greatest(F.ceil(s / room), F.lit(1))
    most = F.max_by(F.struct("c", "s"), F.struct("n", "c"))
    dealt = each.groupBy("k").agg(most.alias("most"), F.sum("s").alias("s")).select("k", F.col("most.c").alias("largest"), blocks(F.col("s")).alias("held"), blocks(F.col("s") - F.col("most.s")).alias("asked"))
    rows = cells.join(dealt.hint("merge"), "k").withColumn("main", F.col("c") == F.col("largest"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    at = lambda n, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), n)
    own = ["k", "rid", "c", "main"]
    held = rows.select(*own, at(F.col("held"), 0).alias("i"), spread(F.col("asked")).alias("j"), F.lit(False).alias("asks"))
    asked = rows.where(~F.col("main")).select(*own, spread(F.col("held")).alias("i"), at(F.col("asked"), 1).alias("j"), F.lit(True).alias("asks"))
    met = held.unionByName(asked).join(sets.hint("merge"), "rid")
    return met.groupBy("k", "i", "j").applyInArrow(lambda t: first_links(t, similarity), "u long, v long, cu long, cv long")


def similar_links(rows: DataFrame, similarity: float, words: int, seed: int, cell_limit: int) -> DataFrame:
    """`rows(rid, text)` -> edges `(u, v)`, whose components are those of all pairs with the similarity, by their whole texts.

    The rows that have one shingle among their `firsts` are a cell. First all rows of a cell are compared with its first one,
    so that a group of near copies costs as many comparisons as it has rows. In cells whose rows then still are in several
    components, rows of different components are compared: in cells of over `cell_limit` rows by `crowd_links`, without a
    row for a pair, in smaller ones as pairs. Pairs that share too few of their firsts for it (`promising`) aren't compared;
    one that the first round leaves out by that, as it counts the cells with one lead only, comes again in the second.
    """
    cells = with_firsts(rows, shingle_counts(rows, "text", words, seed), similarity, words, seed)
    cell = Window.partitionBy("k")
    least = F.min(F.struct("rid", "size")).over(cell)
    met = cells.select("k", "rid", "size", F.count(F.lit(1)).over(cell).alias("n"), least.alias("lead")).where("n > 1")
    met = materialise(met.select("k", "rid", "size", "n", F.col("lead.rid").alias("lead"), F.col("lead.size").alias("least")), "met")
    starred = met.where((F.col("rid") != F.col("lead")) & comparable(F.col("size"), F.col("least"), similarity))
    starred = starred.select(F.col("rid").alias("u"), F.col("lead").alias("v"), F.col("size").alias("nu"), F.col("least").alias("nv"))
    starred = materialise(promising(starred, similarity), "pairs")
    first = similar(starred, rows, similarity, words, seed)
    discard(starred)
    labels = connected_components(first).select(F.col("node").alias("rid"), "root")
    named = met.join(labels.hint("merge"), "rid", "left").select("k", "rid", "size", "n", F.coalesce("root", "rid").alias("c"))
    named = materialise(named, "named")
    discard(met, labels)
    several = materialise(named.groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("k"), "several")
    left = materialise(named.join(several.hint("merge"), "k"), "left")
    discard(named, several)
    few = left.where(F.col("n") <= cell_limit).select("k", "rid", "size", "c")
    crowded = left.where(F.col("n") > cell_limit)
    sizes = materialise(crowded.select("rid", "size").distinct(), "sizes")
    texts = materialise(rows.join(sizes, "rid").select("rid", "text", "size"), "texts")
    middle = materialise(crowd_links(crowded.select("k", "rid", "c"), texts, similarity, words, seed), "linked")
    discard(texts, sizes)
    # components of components
    merged = connected_components(middle.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).select(F.col("node").alias("c"), "root")
    merged = materialise(merged, "merged")
    now = few.join(merged.hint("merge"), "c", "left").select("k", "rid", "size", F.coalesce("root", "c").alias("c"))
    shared = now.groupBy("k").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("k")
    # a pair that also shares a crowded cell has been compared there, so the count of the others alone may leave it out
    pairs = materialise(promising(across(now.join(shared.hint("merge"), "k"), similarity), similarity), "pairs")
    discard(left, merged)
    last = similar(pairs, rows, similarity, words, seed)
    discard(pairs)
    return first.unionByName(middle.select("u", "v")).unionByName(last)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp):
    """The grid point of a fingerprint column: 32 two-bit segments' counts of set bits, each in unary."""
    low = fp.bitwiseAND(F.lit(ODD_BITS))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseOR(high))


def within(a, b, bits: int):
    """Whether two fingerprint columns lie within `bits` bits: by the Manhattan distance of their grid points, then exactly."""
    return (F.bit_count(embedding(a).bitwiseXOR(embedding(b))) <= bits) & (F.bit_count(a.bitwiseXOR(b)) <= bits)


def projections(bits: int, groups: int) -> list[int]:
    """Masks over grid points that keep all but `bits` of the groups of segments."""
    cuts = [round(32 * i / groups) for i in range(groups + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [_signed(sum(masks[g] for g in kept)) for kept in combinations(range(groups), groups - bits)]


def links(fps: DataFrame, bits: int = 2, groups: int = 5, cell_limit: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """`fps(fp)`, distinct -> edges `(u, v)` whose components are those of all pairs within `bits` bits.

    With columns `by`, only fingerprints that agree in them are linked, and edges have them too.
    """
    if bits not in (0, 1, 2) or groups <= bits:
        raise ValueError("bits must be 0, 1 or 2, and groups more than bits")
    if bits == 0:
        return fps.select(*by, F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))
    masks = projections(bits, groups)
    point = fps.select(*by, "fp", embedding(F.col("fp")).alias("t"))
    keys = [F.xxhash64(F.lit(p), F.col("t").bitwiseAND(F.lit(m))) for p, m in enumerate(masks)]
    cells = point.select(*by, "fp", F.explode(F.array(*keys)).alias("k"))

    def near(a, b):
        return within(a, b, bits) & (a < b)

    shared = cells.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    shared = materialise(shared, "cells")
    # of a cell's two members the count has already met both; only larger cells are read again
    pairs = shared.where("n = 2").where(near(F.col("u"), F.col("v"))).select(*by, "u", "v")
    met = materialise(cells.join(shared.where("n > 2").select(*by, "k", "n"), [*by, "k"]), "met")
    few = met.where(F.col("n") <= cell_limit).drop("n")
    a, b = few.alias("a"), few.alias("b")
    same = F.col("a.k") == F.col("b.k")
    for c in by:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    found = a.join(b.hint("merge"), same & near(F.col("a.fp"), F.col("b.fp"))).select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    pairs = pairs.unionByName(found)
    many = met.where(F.col("n") > cell_limit).select(*by, "fp").distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]]
    around = many.select(*by, "fp", F.explode(F.array(*flips)).alias("at"))
    if bits == 1:
        crowd = around.join(many.withColumnRenamed("fp", "at"), [*by, "at"], "left_semi").where("fp > at")
        return pairs.unionByName(crowd.select(*by, F.col("fp").alias("u"), F.col("at").alias("v")))
    least = materialise(around.groupBy(*by, "at").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "around")
    crowd = around.join(least.hint("merge"), [*by, "at"]).where("fp <> m").select(*by, F.col("fp").alias("u"), F.col("m").alias("v"))
    return pairs.unionByName(crowd)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, bits: int = 2, groups: int = 5, cell_limit: int = 64) -> DataFrame:
    """One row per row of `docs`: doc_id, fp (long), fingerprint (16 hex digits), component_id, n_links.

    component_id is the smallest non-null doc_id of the rows whose fingerprints are reachable by steps of
    at most `bits` bits; n_links the number of other distinct fingerprints in the component. Null and empty
    texts, and texts of white space, have fingerprint zero and are linked like any other. Repeated rows
    stay. Rows without a doc_id share their fingerprint's component (null if no row there has an id). An
    empty table gives an empty result.
    """
    require(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialise(with_fingerprints(rows, "text", words, seed).drop("text"), "fingerprints")
    return rows.join(classes(rows, bits, groups, cell_limit).hint("merge"), "fp", "left").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def classes(rows: DataFrame, bits: int, groups: int, cell_limit: int) -> DataFrame:
    """`rows(doc_id, fp)` -> one row per fingerprint: fp, component_id, n_links."""
    points = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    found = connected_components(links(points.select("fp"), bits, groups, cell_limit)).withColumnRenamed("node", "fp")
    members = materialise(points.join(found.hint("merge"), "fp"), "members")
    roots = materialise(members.groupBy("root").agg(F.min("least").alias("component_id"), (F.count(F.lit(1)) - 1).alias("n_links")), "roots")
    named = members.join(roots.hint("merge"), "root").select("fp", "component_id", "n_links")
    out = points.join(named.hint("merge"), "fp", "left")
    return materialise(out.select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, seed: int = 42, similarity: float = 0.8, cell_limit: int = 64, exhaustive: bool = True,
) -> DataFrame:
    """`docs` with one row of each component: that with the smallest doc_id (rows without one come last).

    Rows are linked if the Jaccard similarity of their sets of five-word shingles is `similarity` at least, computed from
    whole texts. No such pair is left out (so `exhaustive` can't be False): see `with_firsts` for the rows that are compared,
    and `similar_links` for crowded cells. Columns are those of `docs`. Of rows that tie in doc_id, one stays; texts without
    words are alike.
    """
    if not exhaustive:
        raise ValueError("all similar pairs are found")
    require(docs, doc_id, text)
    (rid,) = fresh(docs.columns, "rid_")
    marked = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "marked")
    found = connected_components(similar_links(marked.select(F.col(rid).alias("rid"), F.col(text).alias("text")), similarity, words, seed, cell_limit))
    own = marked.select(F.col(rid).alias("node"), F.struct(F.col(doc_id).isNull().alias("no"), F.col(doc_id).alias("doc_id"), F.col(rid).alias("rid")).alias("key"))
    keyed = materialise(found.join(own.hint("merge"), "node").select("node", "root", "key"), "members")
    first = materialise(keyed.groupBy("root").agg(F.min("key")["rid"].alias("stays")), "first")
    gone = materialise(keyed.join(first.hint("merge"), "root").where("node <> stays").select(F.col("node").alias(rid)), "gone")
    discard(keyed, first)
    return marked.join(gone, rid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
