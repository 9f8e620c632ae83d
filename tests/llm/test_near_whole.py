"""The near-dedup stage leaves no similar pair out: not by fingerprints, not by a chance to miss it."""

from itertools import combinations

import numpy as np

from corvane.llm import simhash


def shingles(text):
    return set(simhash.shingle_hashes(text, 5, 42).tolist())


def test_a_repeated_shingle_that_rules_the_fingerprint(spark):
    """A shingle that is repeated counts once in the set that similarity is of, whatever it does to the fingerprint."""
    texts = {}
    for g in range(20):
        own = " ".join(f"g{g}w{i}" for i in range(100))
        texts |= {3 * g: own, 3 * g + 1: own + f" z{g}" * 400, 3 * g + 2: own + f" y{g}" * (30 + g)}
    sets = {i: shingles(t) for i, t in texts.items()}
    assert all((len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])) == (a // 3 == b // 3) for a, b in combinations(texts, 2))
    assert bin(simhash.fingerprint(texts[0], 5) ^ simhash.fingerprint(texts[1], 5)).count("1") > 20
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(rows).collect()} == {3 * g for g in range(20)}


def test_firsts_of_similar_sets_share_a_shingle():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 4, simhash.COUNTS).astype(np.uint32)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        one = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        kept = rng.permutation(one)[: len(one) - int(rng.integers(0, max(1, len(one) // 5) + 1))]
        other = np.unique(np.r_[kept, rng.integers(0, 2**64, int(rng.integers(0, len(one) // 5 + 1)), dtype=np.uint64)])
        both = len(np.intersect1d(one, other))
        if both and both >= 0.8 * (len(one) + len(other) - both):
            met += 1
            assert len(np.intersect1d(simhash.firsts(one, counts, 0.8), simhash.firsts(other, counts, 0.8)))
    assert met > 500


def test_counts_are_of_texts(spark):
    texts = ["a b c d e f", "a b c d e a b c d e", "", None, "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = np.bincount(np.concatenate([simhash._counted(np.unique(simhash.shingle_hashes(t or "", 5, 42))) for t in texts]), minlength=simhash.COUNTS)
    assert (simhash.shingle_counts(rows, "text", 5, 42) == want).all()
