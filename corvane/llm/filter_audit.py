"""Operator 12: audit of interacting filters by a Walsh-Hadamard transform.

Each document has a mask, the set of filters that it fails. For each part and label, the 2 ** f signed parity sums

    W[s] = sum over documents of (-1) ** (number of filters in both s and the document's mask)

are aggregated, so that a shuffle holds as many longs a part and task, however many documents there are. The transform is
its own inverse but for the factor 2 ** f, so the sums give the number of documents with each mask exactly. From these
cells each order of the filters is evaluated without another look at documents: a step removes the masks that hold its
filter and none of an earlier one. Summed over all f! orders a document is removed by each of its failures equally often,
f! / (number of its failures) times, which is the Shapley value in closed form.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, require

#: Labels whose losses are counted beside all documents.
ALL, GOOD, TOXIC = "all", "good", "toxic"
WHITE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions of a text by itself (null: empty), by filter: A under 100 words, B under 80 % distinct words, C over 10 % capitals, D markup characters."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, WHITE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    points = F.char_length(t)
    capitals = points - F.char_length(F.translate(t, CAPITALS, ""))
    return {"A": n < 100, "B": distinct * 100 < n * 80, "C": capitals * 100 > points * 10, "D": t.rlike("[#$%&*|]")}


def masked(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """One row per row of `docs`: part_, mask_ (bit i: fails filter i of ABCDE), good_ and toxic_.

    Texts are compared by their SHA-256. The smallest id of each text is found by aggregation, and rows look up by their
    own id whether they are it, so that no text's copies come together in a task.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col(f"`{text}`")).values())]
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id_"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part_"),
        F.unhex(F.sha2(F.encode(t, "utf-8"), 256)).alias("sha_"), sum(bits[1:], bits[0]).cast("int").alias("own_"),
    )
    rows = materialise(rows, "filter-masks")
    known = rows.where(F.col("id_").isNotNull())
    least = known.groupBy("sha_").agg(F.min("id_").alias("id_")).withColumn("first_", F.lit(True))
    held = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id_")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good_"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic_"))
    # both joins go by id, so rows are shuffled once
    found = known.join(held, "id_", "left").join(least, ["id_", "sha_"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = found.select("part_", (F.col("own_") + F.when(F.col("first_").isNull(), 16).otherwise(0)).alias("mask_"), yes("good_").alias("good_"), yes("toxic_").alias("toxic_"))
    return out.unionByName(rows.where(F.col("id_").isNull()).select("part_", F.col("own_").alias("mask_"), F.lit(False).alias("good_"), F.lit(False).alias("toxic_")))


def parity(a: Column, b: Column | int) -> Column:
    """(-1) to the number of bits that both have."""
    return 1 - 2 * F.bit_count(a.bitwiseAND(F.lit(b) if isinstance(b, int) else b)).bitwiseAND(F.lit(1))


def parity_sums(masks: DataFrame, key: list[str], mask: str, filters: int) -> DataFrame:
    """`key` and `w`: the 2 ** filters signed parity sums of the masks under it."""
    sums = [F.sum(parity(F.col(mask), s).cast("long")) for s in range(1 << filters)]
    return masks.groupBy(*key).agg(F.array(*sums).alias("w"))


def cells(w: str | Column, filters: int) -> Column:
    """Documents with each mask, from their parity sums; zeros where there are none."""
    size = 1 << filters
    w = F.coalesce(F.col(w) if isinstance(w, str) else w, F.array_repeat(F.lit(0).cast("long"), size))
    each = F.sequence(F.lit(0), F.lit(size - 1))
    signed = lambda m: F.zip_with(w, each, lambda x, s: x * parity(s, m))
    total = lambda m: F.aggregate(signed(m), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(each, lambda m: F.shiftright(total(m), filters))


def interactions(sums: DataFrame, key: list[str], filters: str, losses: list[str]) -> DataFrame:
    """All orders and steps of `filters` (letters) for each row of `sums`: key, filter_order, step, kept, removed,
    redundant, unique_fails, one `<label>_lost` for each of `losses`, and shapley.

    `sums` has parity sums in the columns `all` and those of `losses` (null: zeros).
    """
    f = len(filters)
    size = 1 << f
    counted = sums.select(*key, *[cells(c, f).alias(c) for c in [ALL, *losses]])
    steps = [{"filter_order": "".join(order), "step": k + 1, "before": sum(1 << filters.index(x) for x in order[:k]), "own": 1 << filters.index(order[k])} for order in permutations(filters) for k in range(f)]
    # f! * f small structs, the same for any table
    table = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,own:int>>")
    each = counted.select(*key, ALL, *losses, F.inline(table))
    masks = F.sequence(F.lit(0), F.lit(size - 1))

    def total(column: str, condition, weight=None) -> Column:
        picked = F.zip_with(F.col(column), masks, lambda n, m: F.when(condition(m), n * (weight(m) if weight else 1)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)

    before, own = F.col("before"), F.col("own")
    has, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    removed = lambda m: has(m) & ~gone(m)
    orders = F.array(*[F.lit(factorial(f) // max(m.bit_count(), 1)).cast("long") for m in range(size)])
    return each.select(
        *key, "filter_order", "step",
        total(ALL, lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"), total(ALL, removed).alias("removed"),
        total(ALL, lambda m: has(m) & gone(m)).alias("redundant"), total(ALL, lambda m: m == own).alias("unique_fails"),
        *[total(c, removed).alias(f"{c}_lost") for c in losses], total(ALL, has, lambda m: F.get(orders, m)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters ABCDE and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters A to D look at a whole text (`conditions`); a document fails E if a smaller doc_id of the table has an
    identical text. Null texts are empty ones, and copies of each other; a null part is the empty string. Rows without a
    doc_id fail no E and make none fail, and have no label. Rows that are equal in id and text are rows of their own, none
    the copy of the other. A document is good or toxic if any row of `labels` (doc_id, quality, toxic) says so. An empty
    table gives an empty result. Other columns are not read.
    """
    require(docs, doc_id, text, part)
    require(labels, "doc_id", "quality", "toxic")
    rows = masked(docs, labels, doc_id, text, part)
    classes = F.concat(F.array(F.lit(ALL)), F.when(F.col("good_"), F.array(F.lit(GOOD))).otherwise(F.array().cast("array<string>")), F.when(F.col("toxic_"), F.array(F.lit(TOXIC))).otherwise(F.array().cast("array<string>")))
    each = rows.select("part_", "mask_", F.explode(classes).alias("label_"))
    sums = parity_sums(each, ["part_", "label_"], "mask_", 5)
    wide = sums.groupBy("part_").agg(*[F.first(F.when(F.col("label_") == c, F.col("w")), ignorenulls=True).alias(c) for c in (ALL, GOOD, TOXIC)])
    return interactions(wide, ["part_"], "ABCDE", [GOOD, TOXIC]).withColumnRenamed("part_", "part")
