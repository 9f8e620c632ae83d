"""Edited, partial, re-parameterised and reflowed copies of benchmark items."""

import numpy as np
import pytest

from corvane.llm import decontamination

ITEM = "Tom has 3 apples and gives them to Ann Lee. Tom then buys twenty-five pears for 10 days in the garden, because Mary likes fruit"
SHORT = "the river runs below an old stone bridge where seven grey herons stand every morning"


def held_by(spark, texts, items, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, **how).collect()}


def test_short_items_with_one_word_changed_inserted_or_removed(spark):
    w = SHORT.split()
    texts = [" ".join(["before", *x, "after"]) for x in ([*w[:7], "wooden", *w[8:]], [*w[:7], "very", *w[7:]], [*w[:7], *w[8:]], w[:11])]
    assert held_by(spark, [*texts, "a river under a bridge and herons on every morning of the year"], [SHORT]) == {(i, 0) for i in range(4)}


def test_two_edits_in_items_of_median_length(spark):
    rng = np.random.default_rng(3)
    items, texts = [], []
    for _ in range(30):
        w = [f"q{chr(97 + i % 26)}{chr(97 + i // 26)}z" for i in rng.integers(0, 600, 38)]
        items.append(" ".join(w))
        for i in rng.choice(np.arange(6, 32), 2, replace=False):
            w[i] = "edited"
        texts.append(" ".join(w))
    assert held_by(spark, texts, items) >= {(i, i) for i in range(30)}


@pytest.mark.parametrize("change", [str.upper, str.lower, lambda x: x.replace(" ", "\n"), lambda x: x.replace(" ", "  ")])
def test_copies_whatever_their_case_and_spacing(spark, change):
    assert held_by(spark, ["so " + change(ITEM)], [ITEM]) == {(0, 0)}


def test_other_names_and_numbers_of_any_number_of_words(spark):
    other = ITEM.replace("Tom", "Bob Roy").replace("Ann Lee", "Eve").replace("twenty-five", "forty").replace("Mary", "Joan of")
    other = other.replace("Joan of", "Joan")
    assert held_by(spark, ["Here it is. " + other], [ITEM], coverage=0.8) == {(0, 0)}


def test_items_of_more_words_than_a_block(spark):
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)]
    half = [x if i % 10 else "other" for i, x in enumerate(w)]
    assert held_by(spark, [" ".join(w), " ".join(half), " ".join(w[:40])], [" ".join(w)], coverage=0.8) == {(0, 0), (1, 0)}
