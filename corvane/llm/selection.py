"""Exact selection of the k first rows of an order, by distributed histograms instead of a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16


def digit(column: Column, level: int) -> Column:
    """The `level`-th group of 16 bits of a long, from the top, in the order of signed longs."""
    moved = column.bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(moved, 48 - BITS * level).bitwiseAND(F.lit((1 << BITS) - 1))


def first_k(df: DataFrame, keys: list[str], k: int) -> Column:
    """A condition true of just the k first rows of `df` in ascending order of `keys` (longs, jointly unique).

    Each pass counts rows by 16 bits of a key, among those that share the bits found so far: at most 65,536
    counts reach the driver. `df` is read up to four times for each key, so pass a written table.
    """
    if k <= 0:
        return F.lit(False)
    before: list[Column] = []  # conditions of rows that are surely in
    same = F.lit(True)
    left = k
    for key in keys:
        for level in range(4):
            d = digit(F.col(key), level)
            counts = sorted((r["d"], r["n"]) for r in df.where(same).groupBy(d.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
            for value, n in counts:
                if left < n:
                    before.append(same & (d < value))
                    same = same & (d == value)
                    break
                left -= n
                if left == 0:
                    return _any([*before, same & (d <= value)])
            else:
                return _any([*before, same])
    return _any(before)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
