"""Evidence: siblings, one hit for a problem, units, and packs that fit a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import settled

#: Parts that a problem's rows are dealt to.
PARTS_OF_PROBLEM = 64


def sibling_order() -> list[Column]:
    """Pointers to tests last, first remedies first, then from the top of the page down."""
    return [F.col("body").rlike(r"(?i)see test\s*#"), ~F.col("body").rlike(r"(?i)first"), F.coalesce("y0", F.lit(1e9)), F.col("chunk_id")]


def expand_siblings(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with all rows of their problems put in, in order, where the problem first appears.

    hits: query_id, rank, score, doc_id, chunk_id, page, problem_title; chunks: doc_id, chunk_id, page,
    problem_title, kind, body, y0. -> query_id, chunk_id, doc_id, page, problem_title, score, place.
    """
    key = ["query_id", "doc_id", "page", "problem_title"]
    listed = chunks.where("kind = 'table_row' and page is not null and problem_title is not null")
    order = Window.partitionBy(*key[1:]).orderBy(*sibling_order())
    # a problem's rows are put in order once, for all queries that have it
    rows = settled(listed.withColumn("own", F.row_number().over(order)).withColumn("copies_", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "chunk_id"))).select(*key[1:], "chunk_id", "own", "copies_"))
    sizes = rows.groupBy(*key[1:]).agg(F.count(F.lit(1)).alias("n_"), F.max("copies_").alias("copies_"))
    grouped = hits.where("problem_title is not null and page is not null").groupBy(*key).agg(F.min("rank").alias("at"), F.max_by("score", -F.col("rank")).alias("score"))
    grouped = grouped.join(sizes, key[1:])
    # a hit that is a row of one of its query's problems has its place there
    inside = hits.select(*key, "chunk_id").distinct().join(rows.select(*key[1:], "chunk_id").distinct(), [*key[1:], "chunk_id"]).withColumn("in_", F.lit(True))
    alone = hits.join(inside, [*key, "chunk_id"], "left").where("in_ is null").select(*key, "chunk_id", F.col("rank").alias("at"), "score", F.lit(0).alias("own"))
    elsewhere = alone.select("query_id", "doc_id", "chunk_id").join(rows.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_semi").select("query_id")
    items = grouped.select(*key, F.lit(None).cast("string").alias("chunk_id"), "at", "score", "n_", "copies_").unionByName(alone.select(*key, "chunk_id", "at", "score", F.lit(1).cast("long").alias("n_"), F.lit(1).cast("long").alias("copies_")))
    # places are sums of sizes unless items tie or rows stand in several of them: queries with such go through the windows
    tied = items.groupBy("query_id", "at").agg(F.count(F.lit(1)).alias("m_"), F.max("copies_").alias("copies_")).where("m_ > 1 or copies_ > 1").select("query_id")
    twice = alone.groupBy("query_id", "doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("m_")).where("m_ > 1").select("query_id")
    hard = tied.unionByName(elsewhere).unionByName(twice).distinct()
    upto = F.sum("n_").over(Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")
    items = items.join(hard, "query_id", "left_anti").withColumn("before", upto)
    # the rows of a problem are dealt by their order, so that a problem of many queries and rows takes many tasks
    dealt = items.where("chunk_id is null").select(*key, "score", "before", F.explode(F.sequence(F.lit(0), F.lit(PARTS_OF_PROBLEM - 1))).alias("part"))
    plain = rows.withColumn("part", F.pmod("own", F.lit(PARTS_OF_PROBLEM)).cast("int")).hint("merge").join(dealt, [*key[1:], "part"])
    columns = ["query_id", "chunk_id", "doc_id", "page", "problem_title", "score"]
    out = plain.select(*columns, (F.col("before") + F.col("own")).cast("int").alias("place"))
    out = out.unionByName(items.where("chunk_id is not null").select(*columns, (F.col("before") + 1).cast("int").alias("place")))
    again = rows.join(grouped.select(*key, "at", "score").join(hard, "query_id", "left_semi"), key[1:]).select(*key, "chunk_id", "at", "score", "own")
    again = again.unionByName(hits.join(hard, "query_id", "left_semi").select(*key, "chunk_id", F.col("rank").alias("at"), "score", F.lit(0).alias("own")))
    first = again.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "doc_id", "chunk_id").orderBy("at", F.desc("own")))).where("r = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "own", "chunk_id"))
    return out.unionByName(first.select(*columns, place.alias("place")))


def coalesce_problems(hits: DataFrame) -> DataFrame:
    """One hit for each problem on a page: joined lines, the best score, the union of boxes, codes in order.

    hits: query_id, place, doc_id, page, chunk_id, problem_title, body, score, x0, y0, x1, y1, error_codes.
    Hits without a problem stay as they are.
    """
    alone = F.col("problem_title").isNull() | F.col("page").isNull()
    key = F.when(alone, F.col("chunk_id")).otherwise(F.lower("problem_title"))
    rows = F.array_sort(F.collect_list(F.struct("place", "chunk_id", F.regexp_replace("body", r"\s+", " ").alias("line"), "error_codes")))
    out = hits.withColumn("key", key).withColumn("alone", alone).groupBy("query_id", "doc_id", "page", "key", "alone").agg(
        F.min("place").alias("at"), F.max("score").alias("score"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.min_by("problem_title", "place").alias("problem_title"), rows.alias("rows"),
    )
    lines = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return out.select(
        "query_id", "doc_id", "page", "score", "x0", "y0", "x1", "y1", F.get("rows", F.lit(0))["chunk_id"].alias("chunk_id"), F.transform("rows", lambda r: r["chunk_id"]).alias("coalesced_chunk_ids"),
        F.array_distinct(F.flatten(F.transform("rows", lambda r: r["error_codes"]))).alias("error_codes"), F.when(F.col("alone") | (F.size("rows") == 1), lines).otherwise(F.concat(F.lit("Problem: "), "problem_title", F.lit("\n"), lines)).alias("text"),
        F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("place"),
    )


def collapse_units(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Hits of one unit become the unit: its best score and rank, its text, and the hits that led to it. hits: query_id, rank, chunk_id, unit_id, score; units: unit_id, source_text."""
    met = hits.where("unit_id is not null").groupBy("query_id", "unit_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("matched_representations"))
    return met.join(units.select("unit_id", "source_text"), "unit_id")


def pack(items: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """Which of a key's items fit into a budget, tried in order: one that doesn't fit is skipped, the first always goes in.

    -> key, order, index (from 1). A key's items are held together: they are a query's few hits.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(items.select(F.array(order)).schema[0].dataType.simpleString()).alias("picked"))

    def step(acc, x):
        fits = (F.size(acc["picked"]) == 0) | (acc["used"] + x["c"] <= budget)
        return F.struct(F.when(fits, acc["used"] + x["c"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["picked"], x["o"])).otherwise(acc["picked"]).alias("picked"))

    picked = items.groupBy(key).agg(F.aggregate(rows, start, step)["picked"].alias("p"))
    return picked.select(key, F.posexplode("p").alias("i", order)).withColumn("index", (F.col("i") + 1).cast("long")).drop("i")


def prefix_within(items: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """Items in order up to the first that passes the budget."""
    upto = F.sum(cost).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("upto", upto).where(F.col("upto") <= budget).drop("upto")


def cited_indexes(answer: Column) -> Column:
    """The [n] of an answer, in order of their first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int")))


def first_ids(rows: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """key and ids: a key's distinct values that aren't blank, by where they first stand. They are a conversation's or an answer's few."""
    x = F.trim(F.col(column))
    first = rows.where(x != "").groupBy(key, x.alias("id_")).agg(F.min(order).alias("at_"))
    ids = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at_", "id_"))), lambda r: r["id_"]).alias("ids"))
    return rows.select(key).distinct().join(ids, key, "left").select(key, F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def pack_order(hits: DataFrame, key: str, rank: str, boxed: str) -> DataFrame:
    """Hits with `place`, the order in which they are tried for a pack: the top one, then those with a box, then the rest."""
    top = F.min(rank).over(Window.partitionBy(key))
    h = hits.withColumn("bucket_", F.when(F.col(rank) == top, 0).when(F.col(boxed), 1).otherwise(2))
    return h.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("bucket_", rank))).drop("bucket_")


def page_images(hits: DataFrame, held: DataFrame, gate: Column, limit: int) -> DataFrame:
    """query_id, doc_id, page and place: the first pages of documents at hand whose hits pass the gate. hits: query_id, doc_id, page, rank; held: doc_id."""
    some = hits.where((F.col("page") >= 1) & gate).join(held.select("doc_id").distinct(), "doc_id", "left_semi")
    first = some.groupBy("query_id", "doc_id", "page").agg(F.min("rank").alias("at_"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at_", "doc_id", "page"))).where(F.col("place") <= limit).drop("at_")


def block_map(blocks: DataFrame, key: str, index: str, text: str) -> DataFrame:
    """key and blocks: a map from an answer's evidence indexes to their texts."""
    return blocks.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(index, text))).alias("blocks"))


#: How part numbers are written, and how many are named.
PART, PARTS = r"\bW\d{8}\b", 8


def related_parts(hits: DataFrame, lists: DataFrame, publications: DataFrame) -> DataFrame:
    """query_id and parts: the first part numbers, in order, that hits of parts lists name and that are no publication. hits: query_id, doc_id, rank, text; lists: doc_id; publications: publication_number."""
    own = hits.join(lists.select("doc_id").distinct(), "doc_id", "left_semi")
    each = own.select("query_id", "rank", F.explode(F.regexp_extract_all("text", F.lit(PART), F.lit(0))).alias("part"))
    new = each.join(publications.select(F.col("publication_number").alias("part")).distinct(), "part", "left_anti")
    first = new.groupBy("query_id", "part").agg(F.min("rank").alias("at_"))
    some = first.withColumn("r_", F.row_number().over(Window.partitionBy("query_id").orderBy("at_", "part"))).where(F.col("r_") <= PARTS)
    return some.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_", "part"))), lambda x: x["part"]).alias("parts"))


def with_layout(hits: DataFrame, layouts: DataFrame) -> DataFrame:
    """Hits with what is known of their chunk's place on the page; null where nothing is. layouts: chunk_id and others."""
    return hits.join(layouts, "chunk_id", "left")
