"""Extracted tables: junk, matrices, context carried down rows, boxes found by text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_matrix(headers: Column) -> Column:
    """Whether headers are those of a troubleshooting matrix: a problem or symptom, and a cause."""
    low = F.lower(F.array_join(headers, "|"))
    return low.rlike("problem|symptom") & low.rlike("cause")


def column_of(headers: Column, *words: str) -> Column:
    """The number, from 0, of the first header that has one of the words; -1 if none does."""
    hit = F.transform(headers, lambda h: F.lower(h).rlike("|".join(words)))
    return (F.array_position(hit, True) - 1).cast("int")


def is_junk(headers: Column, cells: Column) -> Column:
    """Whether a table is artwork: nothing in it, nearly nothing in many slots, mostly character codes, or few tiny cells."""
    filled = F.filter(F.concat(headers, cells), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    slots, n = F.size(headers) + F.size(cells), F.size(filled)
    coded = F.size(F.filter(filled, lambda x: x.rlike(r"(?i)\(cid:[0-9]+\)")))
    tiny = (n <= 4) & F.forall(filled, lambda x: F.length(F.trim(x)) <= 8)
    return (n == 0) | ((slots >= 8) & (n / F.greatest(slots, F.lit(1)) < 0.15)) | ((coded > 0) & (coded >= F.greatest(F.lit(1.0), n * 0.5))) | tiny


def carry_down(rows: DataFrame, table: str, order: str, *columns: str) -> DataFrame:
    """Rows whose empty cells in `columns` have the last filled one above them."""
    w = Window.partitionBy(table).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(F.nullif(F.trim(F.col(c)), F.lit("")), ignorenulls=True).over(w) for c in columns})


def unique_boxes(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the box of the found row of the same key, where the key stands once on either side; else null."""
    once = lambda df: df.withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("n_ = 1").drop("n_")
    return rows.join(once(found).join(once(rows.select(*keys)), keys, "left_semi"), keys, "left")


def row_key(cells: Column) -> Column:
    """A row's cells in lower case, single spaces, joined by bars, empty ones left out."""
    return F.array_join(F.filter(F.transform(cells, lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))), lambda c: c != ""), "|")
