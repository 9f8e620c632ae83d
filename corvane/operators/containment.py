"""Which of many strings stand anywhere in texts: an Aho-Corasick automaton, in one pass over each text.

The automaton is compiled once, on the driver, and broadcast, while the strings have BLOCK_BYTES at most. More of them
are parted by hash into blocks of about that size, and each block passes over the texts by itself, so that neither the
driver nor a task ever holds more than a block. There is no join of texts with strings, and no shuffle but for `distinct`
strings.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import reach_workers

#: Bytes of the strings of one automaton (it takes some tens of times as much memory).
BLOCK_BYTES = 4 << 20


def compiled(needles: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for n in needles:
        out.add_word(n, n)
    out.make_automaton()
    return out


def _pass(texts: DataFrame, needles: list[str], key: str, text: str, needle: str) -> DataFrame:
    """key and needle for each text that holds one; whoever repeats a key repeats its rows."""
    spark = texts.sparkSession
    reach_workers(spark)
    held = spark.sparkContext.broadcast(compiled(needles)) if needles else None
    rows = texts.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())

    def run(batches):
        if held is None:
            return
        automaton = held.value
        for batch in batches:
            at, found = [], []
            for i, x in enumerate(batch.column(1).to_pylist()):
                mine = {n for _, n in automaton.iter(x)}
                at += [i] * len(mine)
                found += sorted(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[key, needle])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, `{needle}` string")


def holding(texts: DataFrame, needles: DataFrame, key: str, text: str, needle: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key and needle for each row of texts(key, text) and different string of needles(needle) that its text contains.

    Null texts hold nothing; null and empty strings are held by nothing. Compared are code points as they are.
    """
    each = needles.where(F.col(needle).isNotNull() & (F.col(needle) != "")).select(F.col(needle).alias("n_")).distinct()
    size = each.agg(F.sum(F.octet_length("n_")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for i in range(blocks):
        mine = each if blocks == 1 else each.where(F.pmod(F.xxhash64("n_"), F.lit(blocks)) == i)
        part = _pass(texts, [r["n_"] for r in mine.collect()], key, text, needle)  # block_bytes of strings
        out = part if out is None else out.unionByName(part)
    return out
