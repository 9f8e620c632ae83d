"""The near-dedup stage against exact five-word Jaccard similarity."""

from itertools import combinations

import numpy as np
import pytest

from corvane.llm import simhash


def jaccard(a, b):
    a, b = (set(simhash.shingle_hashes(x, 5, 42).tolist()) for x in (a, b))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def texts():
    """60 groups of a text and a copy with 2 to 12 edited words: similarities from 0.6 to 0.96."""
    rng = np.random.default_rng(9)
    out = {}
    for g in range(60):
        base = [f"w{i}" for i in rng.integers(0, 3000, 240)]
        out[2 * g] = " ".join(base)
        for i in rng.choice(240, 2 + g % 11, replace=False):
            base[i] = "edited"
        out[2 * g + 1] = " ".join(base)
    return out


def kept(spark, texts, **how):
    return {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **how).collect()}


def test_near_copies_from_similarity_0_8_go_and_others_stay(spark, texts):
    want = {i for i in texts if i % 2 == 0 or jaccard(texts[i - 1], texts[i]) < 0.8}
    assert 70 < len(want) < 110
    assert kept(spark, texts) == want


@pytest.mark.parametrize("limit", [1, 8])
def test_groups_past_the_cell_limit(spark, texts, limit):
    words, some = texts[0].split(), {}
    for i in range(40):
        some[i] = " ".join([*words[: 5 * i], "edited", *words[5 * i + 1 :]])
    assert all(jaccard(some[a], some[b]) >= 0.8 for a, b in combinations(some, 2))
    assert kept(spark, some | {i + 100: t for i, t in texts.items() if i > 1}, cell_limit=limit) == {0} | {i + 100 for i in texts if i > 1 and (i % 2 == 0 or jaccard(texts[i - 1], texts[i]) < 0.8)}


def test_rows_of_a_table(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts = {i: t for i, t in texts.items() if t.split()}
    label = {i: i for i in texts}
    near = [(a, b) for a, b in combinations(sorted(texts), 2) if jaccard(texts[a], texts[b]) >= 0.8]
    for _ in texts:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert kept(spark, texts) == {i for i in texts if label[i] == i}


def test_crowded_cells_lose_no_pair(spark):
    """A long passage that all share puts them into the same cells; pairs of near copies among them are found, as if nothing else was there."""
    rng = np.random.default_rng(21)
    passage, texts = [f"p{i}" for i in range(60)], {}
    for g in range(150):
        own = [f"w{i}" for i in rng.integers(0, 10**6, 90)]
        texts[2 * g] = " ".join([*passage, *own])
        for i in rng.choice(90, 1 + g % 6, replace=False):
            own[i] = "edited"
        texts[2 * g + 1] = " ".join([*passage, *own])
    label = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        if (a // 2 == b // 2 or (a + b) % 50 == 0) and jaccard(texts[a], texts[b]) >= 0.8:
            label[b] = label[a]
    want = {i for i in texts if label[i] == i}
    assert 150 < len(want) < 290
    for limit in (2, 64):
        assert kept(spark, texts, cell_limit=limit, exhaustive=True) == want
    assert len(kept(spark, texts) ^ want) <= 2


def test_short_texts_are_compared_whatever_their_fingerprints(spark):
    words = [f"s{i}" for i in range(30)]
    texts = {0: " ".join(words), 1: " ".join([*words, "more"]), 2: " ".join([*words[:-1], "x"]), 3: " ".join([*words, "a", "b"]), 4: "s0 s1"}
    assert kept(spark, texts) == {i for i in texts if not any(j < i and jaccard(texts[j], texts[i]) >= 0.8 for j in texts)}


def test_a_crowd_about_the_threshold_loses_no_pair(spark):
    """Copies of one text, each edited elsewhere, so that similarities lie about 0.8 and no few rows stand for the others."""
    rng = np.random.default_rng(4)
    base, texts = [f"w{i}" for i in range(240)], {}
    for i in range(260):
        own = list(base)
        for at in rng.choice(240, 3 + i % 3, replace=False):
            own[at] = f"e{i}-{at}"
        texts[i] = " ".join(own)
    sets = {i: set(simhash.shingle_hashes(t, 5, 42).tolist()) for i, t in texts.items()}
    near = [(a, b) for a, b in combinations(texts, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = {i: i for i in texts}
    for _ in texts:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    want = {i for i in texts if label[i] == i}
    assert 20 < len(want) < 240
    assert kept(spark, texts) == want
    # any cells and components in small blocks: the same components as by all pairs
    rows = spark.createDataFrame([(i, t, simhash._signed(simhash.fingerprint(t, 5)), len(sets[i])) for i, t in texts.items()], "rid long, text string, fp long, size int")
    cells = spark.createDataFrame([(1, i, i - i % 4) for i in texts] + [(2, i, i - i % 4) for i in range(0, 260, 3)], "k long, rid long, c long")
    links = simhash.crowd_links(cells, rows, 0.8, 5, 42, 64, room=5_000)
    found = {(r.u, r.v) for r in links.collect()}
    assert found <= {(b, a) for a, b in near} | set(near) and len(found) < len(near)

    def components(pairs):
        label = {i: i - i % 4 for i in texts}
        for _ in range(260):
            held = dict(label)
            for a, b in pairs:
                one, other = sorted((label[a], label[b]))
                label |= {i: one for i in label if label[i] == other}
            if held == label:
                return label

    assert components(found) == components(near)
