"""The licence scan against a slow version, and rules against texts that they describe."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corvane.llm import license_rules, license_scan
from corvane.llm.queries import op13_license_scan

RULES = license_rules.parse()


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(text, rules=RULES):
    """(start, stop, rule) of all matches that stay, without keywords and with all pairs of detections."""
    line = " " + " ".join(words_of(text)) + " "
    met = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
            met.append((line[: m.start()].count(" ") - 1, line[: m.end()].count(" "), k))
    def better(a, b):  # a holds b and is better
        ra, rb = rules[a[2]].rank, rules[b[2]].rank
        return a != b and a[0] <= b[0] and a[1] >= b[1] and (ra, a[0] - a[1], a[2]) < (rb, b[0] - b[1], b[2])
    return sorted((d for d in met if rules[d[2]].base or not any(better(e, d) for e in met)), key=lambda d: (d[0], -d[1], rules[d[2]].rank, d[2]))


def found(df, rules=None):
    return {r.doc_id: [(d.start, d.stop, d.rule) for d in r.detections] for r in license_scan.scan(df, rules).collect()}


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "This library is free software under the GNU Lesser General Public License, version 2.1 or any later version.",
    "GNU General Public License, version 3. See the GNU General Public License for more details!",
    "Released under CC BY-NC 4.0, cc by CC BY cc-by-sa; all rights reserved. All Rights Reserved",
    "MIT License\n\nCopyright (c) 2019-2021 Someone. Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "SPDX-License-Identifier: BSD-3-Clause", "under the mit licence and the Eupl 1.2", "Alle Rechte vorbehalten. Tous droits réservés", "cc by is one word; ccby cc bye",
    "", None, "no words of that kind here", "... --- ...", "mit dem Programm", "general public licenses", "x general public license", "ſpdx license K",
]


def test_hand_cases_equal_the_slow_version(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = found(df)
    assert got == {i: slow(t) for i, t in enumerate(TEXTS)}
    labels = {i: {RULES[d[2]].label for d in ds} for i, ds in got.items()}
    assert labels[0] == {"apache-2.0"} and labels[1] == {"lgpl-2.1-or-later", "gpl"} and labels[2] == {"gpl-3.0", "gpl"}
    assert {"cc-by", "cc-by-nc", "cc-by-sa", "reserved"} <= labels[3] and {"mit", "copyright"} == labels[4] and labels[13] == set()


def sample(rng, parsed):
    """A random string that a parsed pattern describes."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += "w" if str(kind) == "CATEGORY" else chr(rng.randint(*value)) if str(kind) == "RANGE" else chr(value)
        elif name == "MAX_REPEAT":
            low, high, inner = arg
            out += "".join(sample(rng, inner) for _ in range(rng.randint(low, min(high, low + 3))))
        elif name == "SUBPATTERN":
            out += sample(rng, arg[3])
        elif name == "BRANCH":
            out += sample(rng, rng.choice(arg[1]))
        else:
            raise AssertionError(name)
    return out


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(9)
    return [(k, sample(rng, re._parser.parse(r.pattern))) for k, r in enumerate(RULES) for _ in range(12)]


def test_keywords_are_words_of_every_match(samples):
    assert len(RULES) > 200 and {r.pattern: r.label for r in RULES if r.base} == license_rules.BASE
    for k, text in samples:
        assert re.fullmatch(RULES[k].pattern, text)
        words = {"license" if w == "licence" else w for w in text.split(" ")}
        assert set(RULES[k].keywords) <= words, (RULES[k], text)


def test_samples_of_all_rules_equal_the_slow_version(spark, samples):
    rng = random.Random(2)
    texts = [t for _, t in samples]
    docs = [(i, rng.choice(["", "so ", "The work: "]) + rng.choice([" ", ". ", " and "]).join(rng.sample(texts, rng.randint(1, 5)))) for i in range(400)]
    assert found(spark.createDataFrame(docs, "doc_id int, text string")) == {i: slow(t) for i, t in docs}


def test_random_intervals_are_suppressed_alike(spark):
    rng = random.Random(4)
    rules = license_rules.parse("\n".join(f"l{i % 5} | {rng.randrange(5)} | {w[0]} | {w}" for i, w in enumerate(["a", "b", "a b", "b a", "a b a", "b b", "a(?: b)*", "b a b a", "a a", "a b b"])), {"a b": "l2"})
    docs = [(i, " ".join(rng.choice("aabc") for _ in range(rng.choice([1, 5, 40, 700])))) for i in range(60)]
    assert found(spark.createDataFrame(docs, "doc_id int, text string"), rules) == {i: slow(t, rules) for i, t in docs}


def test_query_on_the_small_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op13_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        kept = slow(texts[r.doc_id])
        base = [d for d in kept if RULES[d[2]].base]
        starts = [d[0] for d in base]
        join = lambda ds: ",".join(sorted({RULES[d[2]].label for d in ds}))
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (len(words_of(texts[r.doc_id])), len(base), join(base), join(kept))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(kept)


def test_very_many_matches_and_clashing_names(spark):
    text = "cc by all rights reserved " * 20_000
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string").withColumn("W_", F.lit(1)).withColumn("keywords", F.lit("x"))
    began = time.perf_counter()
    rows = {r.doc_id: r for r in license_scan.scan(df).select("doc_id", "n_words", "W_", F.size("detections").alias("n"), F.try_element_at("detections", F.lit(-1)).alias("last")).collect()}
    assert time.perf_counter() - began < 60
    assert (rows[1].n_words, rows[1].n, rows[1].last.start, rows[1].W_) == (100_000, 40_000, 99_997, 1) and rows[2].n == 0
    with pytest.raises(ValueError):
        license_scan.scan(df.withColumn("detections", F.lit(1)))
    assert license_scan.scan(df.limit(0)).collect() == []
