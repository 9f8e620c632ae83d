"""The filter audit against a walk over all orders and documents."""

import re
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.llm import filter_audit
from corvane.llm.queries import OP12_SQL, op12_filter_audit

DOCS = "doc_id long, text string, lang string"


def slow(docs, labels):
    def fails(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = ("A" if len(words) < 100 else "") + ("B" if 100 * len(set(words)) < 80 * len(words) else "")
        out += ("C" if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else "") + ("D" if re.search("[#$%&*|]", t) else "")
        return out + ("E" if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else "")

    held = [(p or "", fails(i, t or ""), i) for i, t, p in docs]
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {p for p, *_ in held}:
        mine = [(f, i) for p, f, i in held if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, own in enumerate(order):
                gone = [(f, i) for f, i in left if own in f]
                left = [(f, i) for f, i in left if own not in f]
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(own in f for f, _ in mine) - len(gone), sum(f == own for f, _ in mine), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
        for own in "ABCDE":
            at = [(part, "".join(o), o.index(own) + 1) for o in permutations("ABCDE")]
            total = sum(out[a][1] for a in at)
            for a in at:
                out[a].append(total)
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_whole_small_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = found(op12_filter_audit(spark, sf))
    assert got == slow(docs, labels)
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): tuple(r[3:]) for r in c.sql(f"SELECT {', '.join(names)} FROM ({OP12_SQL})").fetchall()} == got


@pytest.fixture(scope="module")
def awkward():
    words = " ".join(f"w{i}" for i in range(100))
    docs = [(1, words, "en"), (2, words, None), (3, words + " #", ""), (4, None, "en"), (5, "", "en"), (None, words, "en"), (None, "", "en"), (2, words, "en"), (6, "A" * 11 + "b" * 99, "de"), (7, "A" * 11 + "b" * 98, "de")]
    docs += [(20 + i, "the same", "en") for i in range(200)] + [(8, words * 400, "en"), (9, "x " * 100 + "\x0b\x1c", "fr"), (10, " ".join(["a"] * 20 + [f"v{i}" for i in range(80)]), "fr")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (4, None, 1), (None, 1, 1), (20, 1, 1), (21, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_awkward_rows(spark, awkward):
    docs, labels = awkward
    df = spark.createDataFrame(docs, DOCS).repartition(7).withColumn("mask_", F.lit("x")).withColumn("GOOD", F.lit(2))
    got = found(filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == slow(docs, labels)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).collect() == []
    got = found(filter_audit.audit(spark.createDataFrame([(1, None, None)], DOCS), labels))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_sums_invert_to_cells(spark):
    rows = [(k, m) for k in range(3) for m in range(32) for _ in range((k * 7 + m * m) % 5)]
    sums = filter_audit.parity_sums(spark.createDataFrame(rows, "k int, m int"), ["k"], "m", 5)
    for r in sums.select("k", filter_audit.cells("w", 5).alias("c")).collect():
        assert r.c == [(r.k * 7 + m * m) % 5 for m in range(32)]
