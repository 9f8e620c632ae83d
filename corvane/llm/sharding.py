"""Operator 7: shards by a k-d tree over metadata, balanced in bytes.

Every row has a place in each metadata dimension, on a scale of 16 bits. A node of the tree takes its
widest dimension and is split at the weighted median there (bytes are the weight), until leaves reach the
target bytes. Ties are split too: after the dimension come the bits of a hash of id and text, then those
of the row's number, so that a value that holds a third of all rows doesn't end in one leaf.

Medians are found by digits, for all nodes of a level at once: bytes are summed by node and 16-bit digit,
the digit that holds the median is found in the running sums, and only rows with that digit go on to the
next one, until it holds no more bytes than `tolerance` allows or one row. All of it is DataFrame
operations; nodes are a table, never gathered by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, require

DIGIT = 65536
#: Rows of a shard that are numbered by one task, about.
NUMBERED = 50_000


def numeric_dimension(column: Column) -> Column:
    """A place for a number: the logarithm of its size, so that long tails don't take up the whole scale. Numbers of one size and other sign share a place, infinite ones the last. Null and not a number: 0."""
    x = F.log2(1 + F.abs(column.cast("double")))
    return F.coalesce(F.when(F.isnan(x), 0.0).otherwise(F.least(x, F.lit(64.0))) / 64.0, F.lit(0.0))


def category_dimension(column: Column) -> Column:
    """A place for a category, by hash. Null: 0."""
    h = F.shiftrightunsigned(F.xxhash64(column.cast("string")), 11).cast("double") / float(1 << 53)
    return F.when(column.isNull(), 0.0).otherwise(h)


def kd_shards(docs: DataFrame, dimensions: list[Column], n_shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, tolerance: float = 1e-4) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, shard (from 0), slot (from 0, gapless in a shard), and `carry`.

    Size is the text's UTF-8 bytes and 1; a null text has none and the crc of an empty one. Leaves are
    `n_shards`, or as many as it takes for about `target_bytes` each. A split misses its weighted median by
    half a row, or by `tolerance` of a leaf's bytes, whichever is more. Repeated rows are rows of their own;
    null ids and metadata are values like others; an empty table gives an empty result.
    """
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give n_shards or target_bytes")
    require(docs, doc_id, text, *(carry or []))
    spark = docs.sparkSession
    octets = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    size = (F.octet_length(octets) + 1).cast("long")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(octets).alias("text_crc32"),
        F.array(*[d.cast("double") for d in dimensions]).alias("d_"), F.monotonically_increasing_id().alias("rid_"),
        F.struct(*[F.col(c) for c in carry or []]).alias("carry_") if carry else F.lit(None).cast("string").alias("carry_"),
    )
    rows = rows.withColumn("tie_", F.xxhash64(F.col("doc_id").cast("string"), "text_crc32"))
    rows = materialise(rows, "shard-rows")
    m = len(dimensions)
    ends = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), *[F.min(F.col("d_")[i]).alias(f"a{i}") for i in range(m)], *[F.max(F.col("d_")[i]).alias(f"b{i}") for i in range(m)]).first()
    leaves = n_shards if n_shards is not None else max(1, -(-(ends["bytes"] or 0) // target_bytes))
    scaled = [F.least(F.floor((F.col("d_")[i] - ends[f"a{i}"]) / max(ends[f"b{i}"] - ends[f"a{i}"], 1e-300) * DIGIT), F.lit(DIGIT - 1)).cast("int") for i in range(m)] if ends["n"] else [F.lit(0)] * m
    # node: the first of its leaves; k: how many it has
    state = rows.select("doc_id", "size", "text_crc32", "rid_", "tie_", "carry_", F.array(*scaled).alias("d_"), F.lit(0).alias("node"), F.lit(leaves).alias("k"))
    most = leaves
    while most > 1:
        state = materialise(_split_level(state, m, (ends["bytes"] or 0) / leaves * tolerance), "shard-level")
        most = (most + 1) // 2
    return _numbered(state, ends["n"], leaves, carry)


def _split_level(state: DataFrame, m: int, slack: float) -> DataFrame:
    """`state` with each node of more than one leaf split in two."""
    spreads = state.where("k > 1").groupBy("node", "k").agg(
        F.sum("size").alias("bytes"), F.array(*[F.max(F.col("d_")[i]) - F.min(F.col("d_")[i]) for i in range(m)]).alias("width"))
    nodes = spreads.select("node", (F.array_position("width", F.array_max("width")).cast("int") - 1).alias("dim"), (F.col("bytes") * F.floor(F.col("k") / 2) / F.col("k")).alias("need"))
    nodes = materialise(nodes.select("node", "dim", "need", F.lit(None).cast("array<int>").alias("cut"), F.lit(False).alias("done")), "shard-nodes")
    held = state.where("k > 1").select("node", "size", "d_", "tie_", "rid_")
    prefix = F.array().cast("array<int>")
    for level in range(9):
        # rows that share the digits found so far, by their next one
        join = held.join(nodes.where("not done").select("node", "dim", "need", "cut"), "node")
        digits = _digits("dim")
        if level:
            join = join.where(F.slice(digits, 1, level) == F.col("cut"))
        sums = join.groupBy("node", digits[level].alias("digit")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
        upto = Window.partitionBy("node").orderBy("digit")
        sums = sums.withColumn("cum", F.sum("b").over(upto)).withColumn("all", F.sum("b").over(Window.partitionBy("node")))
        sums = sums.where((F.col("cum") >= F.col("need")) | (F.col("cum") == F.col("all")))
        sums = sums.withColumn("r", F.row_number().over(upto)).where("r = 1")
        # what the rows before this digit leave to be found
        rest = F.col("need") - (F.col("cum") - F.col("b"))
        found = sums.select("node", "digit", rest.alias("rest"), ((F.col("b") <= F.lit(slack)) | (F.col("n") == 1)).alias("end"), (rest * 2 >= F.col("b")).alias("whole"))
        at = F.concat(F.coalesce("cut", prefix), F.array("digit"))
        step = nodes.join(found, "node", "left")
        over = F.col("done") | F.col("digit").isNull()
        last = F.lit(level == 8)
        # a digit that ends the search goes left as a whole if that is nearer, else right
        cut = F.when(over, F.col("cut")).when((F.col("end") | last) & ~F.col("whole"), F.concat(F.coalesce("cut", prefix), F.array(F.col("digit") - 1))).otherwise(at)
        nodes = materialise(step.select("node", "dim", F.when(over, F.col("need")).otherwise(F.col("rest")).alias("need"), cut.alias("cut"), (over | F.col("end") | last).alias("done")), "shard-nodes")
        if not nodes.where("not done").limit(1).count():
            break
    parted = state.join(nodes.select("node", "dim", "cut"), "node", "left")
    left = F.slice(_digits("dim"), 1, F.size("cut")) <= F.col("cut")
    half = F.floor(F.col("k") / 2).cast("int")
    goes = F.col("cut").isNotNull()
    return parted.select(
        "doc_id", "size", "text_crc32", "rid_", "tie_", "carry_", "d_",
        F.when(goes & ~left, F.col("node") + half).otherwise(F.col("node")).cast("int").alias("node"),
        F.when(goes & left, half).when(goes, F.col("k") - half).otherwise(F.col("k")).cast("int").alias("k"),
    )


def _digits(dim: str) -> Column:
    """A row's digits under a node: its place in dimension `dim`, then its hash's bits, then its number's."""

    def of(c: str) -> list[Column]:
        return [F.shiftrightunsigned(c, s).bitwiseAND(F.lit(DIGIT - 1)).cast("int") for s in (48, 32, 16, 0)]

    return F.array(F.element_at("d_", F.col(dim) + 1), *of("tie_"), *of("rid_"))


def _numbered(state: DataFrame, n: int, leaves: int, carry: list[str] | None) -> DataFrame:
    """Slots: rows are numbered within parts of a shard, and parts follow each other."""
    parts = max(16, -(-n // (leaves * NUMBERED)))
    state = state.withColumn("part_", F.pmod(F.xxhash64("rid_"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("node").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = state.groupBy("node", "part_").agg(F.count(F.lit(1)).alias("c")).select("node", "part_", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset_"))
    own = Window.partitionBy("node", "part_").orderBy("rid_")
    out = state.withColumn("at_", F.row_number().over(own)).join(offsets, ["node", "part_"])
    slot = (F.col("at_") + F.col("offset_") - 1).cast("long")
    more = [F.col(f"carry_.`{c}`").alias(c) for c in carry or []]
    return out.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), slot.alias("slot"), *more)


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Writes `kd_shards`' rows as Parquet, one folder a shard, in `files_per_shard` files each."""
    part = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    n = partitions(sharded.sparkSession)
    sharded.repartition(n, "shard", part).write.partitionBy("shard").parquet(path)
