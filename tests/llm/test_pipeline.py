"""The pipeline's rows against a slow version of all its stages that shares no code with them.

Near-duplicates are held to what the stage is for, a Jaccard similarity of five-word shingles of 0.8 or more.
"""

import re
from itertools import combinations

from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm.queries import tokenizer_path
from test_brute_force import slow_holds, slow_vector, unit


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_against_brute_force(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    left = {i: r.text for i, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    # none of them resembles no language
    prototypes = {}
    short = {i: unit(slow_vector(t)) for i, t in left.items() if len(t) < 2500}
    for i, v in short.items():
        prototypes[docs[i].lang] = prototypes.get(docs[i].lang, 0) + v
    assert all(max(float(unit(p) @ v) for p in prototypes.values()) > 0.05 for v in short.values())
    best = {}
    for i in sorted(left):
        key = re.sub("[\x20\x09-\x0d]", "", left[i])
        if key not in best or len(left[i]) > len(left[best[key]]):
            best[key] = i
    left = {i: left[i] for i in best.values()}
    sets = {i: shingles(t) for i, t in left.items()}
    near = [(a, b) for a, b in combinations(sorted(left), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = {i: i for i in left}
    for _ in left:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    left = {i: t for i, t in left.items() if label[i] == i}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(slow_holds(t, x) for x in items)}
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(left)
    library = Tokenizer.from_file(tokenizer_path())
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in left.items()}
