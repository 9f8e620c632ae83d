"""Strings in texts against looking for each in each, in one automaton and in blocks; the arms that use it."""

import random

import pytest

from corvane.operators import arms, containment, intake
from corvane.plans.base import chunks


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_holding_equals_looking_for_each(spark, block_bytes):
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("abc é😀") for _ in range(n))
    texts = {i: draw(rng.choice([0, 1, 5, 60])) for i in range(120)} | {500: None, 501: "x" * 50_000 + "abcabc"}
    needles = sorted({draw(rng.randint(1, 5)) for _ in range(60)} | {"abcabc", "aaaaaaaaaa"})
    df = spark.createDataFrame(list(texts.items()), "id int, hay string")
    ns = spark.createDataFrame([(n,) for n in [*needles, None, "", needles[0]]], "needle string")
    got = sorted((r.id, r.needle) for r in containment.holding(df, ns, "id", "hay", "needle", block_bytes).collect())
    assert got == sorted((i, n) for i, t in texts.items() if t is not None for n in needles if n in t)
    assert containment.holding(df, ns.limit(0), "id", "hay", "needle").collect() == []


def test_literals_without_a_nested_loop(spark, sf):
    held = chunks(spark, sf)
    asked = spark.createDataFrame([(1, "TEST4 and J3 of abc123 or F5E2"), (2, "no literals here"), (3, "TEST4")], "query_id int, ask string")
    found = arms.literal_fetch(asked, held)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    texts = {r.chunk_no: r.text.upper() for r in held.collect()}
    want = set()
    for q, literals in ((1, ["TEST4", "ABC123", "F5E2"]), (3, ["TEST4"])):
        rare = [x for x in literals if 0 < sum(x in t for t in texts.values()) <= 40]
        hits = sorted(k for k, t in texts.items() if any(x in t for x in rare))
        want |= {(q, k, n) for n, k in enumerate(hits[:40], 1)}
    assert {(r.query_id, r.chunk_no, r.arm_rank) for r in found.collect()} == want


def test_saved_pages_by_address_path_and_title(spark):
    docs = spark.createDataFrame([("A", "https://h.example.org/a/topic-1", "Washers (all)"), ("B", "https://h.example.org/b/topic-2", "How to clean the filter (v2)"), ("C", None, "x")], "doc_id string, source_url string, title string")
    files = [("1.html", "see H.example.org/a/topic-1/ for more", ["h.example.org/zz"]), ("2.html", "HOW TO CLEAN THE FILTER today", []), ("3.html", "nothing", []), ("b=topic-2.html", None, [])]
    rows = intake.archive_matches(spark.createDataFrame(files, "file string, content string, declared array<string>"), docs).collect()
    assert {r.file: r.doc_id for r in rows} == {"1.html": "A", "2.html": "B", "3.html": None, "b=topic-2.html": None}
