"""Items of more words than a long has bits are aligned as one."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import decontamination, exact_dedup


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def masks(item):
    out = []
    for k in range(0, len(item), decontamination.BLOCK):
        m = {}
        for i, w in enumerate(item[k : k + decontamination.BLOCK]):
            m[w] = m.get(w, 0) | 1 << i
        out.append(m)
    return out


def test_common_words_equal_true_subsequences(spark):
    rng = random.Random(5)
    cases = []
    for n in [1, 5, 61, 62, 63, 64, 100, 124, 125, 187, 200]:
        for few in (3, 40, 1000):
            item = [rng.randrange(few) for _ in range(n)]
            for region in (item, item[n // 2 :] + item[: n // 2], [x for x in item if rng.random() < 0.8], [rng.randrange(few) for _ in range(n + 7)], []):
                cases.append((len(cases), item, region, masks(item)))
    rows = spark.createDataFrame(cases, "k int, item array<long>, region array<long>, masks array<map<long,long>>")
    got = {r.k: r.n for r in rows.select("k", decontamination.common_words(F.col("masks"), F.col("region")).alias("n")).collect()}
    assert got == {k: longest(item, region) for k, item, region, _ in cases}


@pytest.mark.parametrize("half", [62, 70])
def test_two_halves_in_the_other_order_are_not_held(spark, half):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(2 * half)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    swapped, whole = " ".join(words[half:] + words[:half]), " ".join(words[: half - 9] + words[half:])
    docs = spark.createDataFrame([(1, swapped), (2, whole), (3, " ".join(words))], "doc_id long, text string")
    got = {r.doc_id: (r.n_found, r.n_words) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {2: (2 * half - 9, 2 * half), 3: (2 * half, 2 * half)}


def test_pages_give_each_slot_its_bucket():
    d = exact_dedup.Directory()
    for b in (0, 1, 1, 0, 3, 5, 5, 6):
        d.split(b)
    order = d.in_order()
    index, bits = exact_dedup.pages(d, order, list(range(len(order))), [0] * len(order))
    rows = index.to_pylist()
    assert len(rows) == 1 << bits <= 2 * len(order)
    for slot, bucket in enumerate(d.slots.tolist()):
        r = rows[slot >> (d.depth - bits)]
        place = sum(x <= slot for x in r["starts_"]) - 1
        assert order[r["first_"][place]] == bucket
