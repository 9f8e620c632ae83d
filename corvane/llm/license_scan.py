"""Operator 13: licence scan by ordered signature rules.

A text's words (lower case A-Z; other characters than letters, digits and those beyond ASCII part words) are written with
single spaces between them. The keywords among them gate hundreds of signature rules (`license_rules`), so that a text
without any is not searched at all and others for few rules each. A rule's matches are intervals of words. Of
overlapping detections one is suppressed if its interval lies in that of another of a better class, or of the same class
and longer, or of the same interval by an earlier rule; base phrases stay in any case. DataFrame functions only, and no
shuffle: each text is read once, in place.

Both running sums (where a match starts) and suppression (the farthest end of each class so far, with detections in order
of start) are folds over arrays in blocks, so that a text with very many matches takes time in proportion to them, about.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, require
from .license_rules import CONFIDENCE, Rule, parse

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Entries that a fold appends to one array before it starts the next.
BLOCK = 256
DETECTION = "struct<start:int,stop:int,rank:int,rule:int,label:string,base:boolean,confidence:double>"


def words_of(text: Column) -> Column:
    """A text's words, in lower case, with a space before, between and after them; a null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(low, BETWEEN, " ")), F.lit(" "))


def spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def scanned(items: Column, state: Column, kind: str, step: Callable, emit: Callable) -> Column:
    """emit(state, item) for each item, with the state that `step` has made of the items before. `kind`: type of what is emitted."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    none = F.array().cast(f"array<{kind}>")

    def block(start, xs):
        return F.aggregate(xs, F.struct(start.alias("state"), none.alias("out")), lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x).cast(kind))).alias("out")))

    done = F.aggregate(blocks, F.array(F.struct(state.alias("state"), none.alias("out"))), lambda a, xs: F.concat(a, F.array(block(F.element_at(a, -1)["state"], xs))))
    return F.when(F.size(items) > 0, F.flatten(F.transform(done, lambda b: b["out"]))).otherwise(none)


def gated(words: Column, rules: list[Rule]) -> Column:
    """The rules all of whose keywords are among the words; empty without going through the rules where there is no keyword."""
    known = sorted({k for r in rules for k in r.keywords} | {"licence"})
    lines = [{"rule": i, "rank": r.rank, "label": r.label, "base": r.base, "keywords": list(r.keywords), "pattern": f"(?<= )(?:{r.pattern})(?= )"} for i, r in enumerate(rules)]
    table = F.from_json(F.lit(json.dumps(lines)), "array<struct<rule:int,rank:int,label:string,base:boolean,keywords:array<string>,pattern:string>>")
    found = F.transform(F.array_intersect(F.split(words, " "), F.split(F.lit(" ".join(known)), " ")), lambda w: F.when(w == "licence", "license").otherwise(w))
    # bound once, then looked up by each rule
    return F.flatten(F.transform(F.array(found), lambda ws: F.when(F.size(ws) > 0, F.filter(table, lambda r: F.forall(r["keywords"], lambda k: F.array_contains(ws, k)))).otherwise(F.slice(table, 1, 0))))


def matches(words: Column, rules: Column) -> Column:
    """All matches of the rules, as detections in no particular order. A rule's own matches don't overlap."""
    hit = F.filter(F.transform(rules, lambda r: F.struct(r.alias("r"), F.regexp_extract_all(words, r["pattern"], F.lit(0)).alias("hits"))), lambda x: F.size(x["hits"]) > 0)

    def of(x):
        r = x["r"]
        pieces = F.split(words, r["pattern"], -1)
        # before a match stand as many words as spaces, but for the first one
        both = F.zip_with(pieces, x["hits"], lambda p, h: F.struct(spaces(p).alias("before"), spaces(h).alias("inside"), h.isNotNull().alias("real")))
        real = F.filter(both, lambda b: b["real"])
        starts = scanned(real, F.lit(-1), "struct<start:int,stop:int>", lambda at, b: at + b["before"] + b["inside"], lambda at, b: F.struct((at + b["before"]).alias("start"), (at + b["before"] + b["inside"] + 1).alias("stop")))
        confidence = F.get(F.array(*map(F.lit, CONFIDENCE)), r["rank"])
        return F.transform(starts, lambda s: F.struct(s["start"], s["stop"], r["rank"], r["rule"], r["label"], r["base"], confidence.alias("confidence")).cast(DETECTION))

    return F.flatten(F.transform(hit, of))


def unsuppressed(detections: Column) -> Column:
    """Detections in order of start, without those whose interval a better one holds."""
    order = F.array_sort(F.transform(detections, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), d["rank"].alias("rank"), d["rule"].alias("rule"), d.alias("d"))))
    ends = F.array_repeat(F.lit(-1), len(CONFIDENCE))

    def step(state, x):
        return F.transform(state, lambda e, k: F.when((k == x["rank"]) & (e < x["d"]["stop"]), x["d"]["stop"]).otherwise(e))

    def emit(state, x):
        held = F.array_max(F.slice(state, F.lit(1), x["rank"] + 1)) >= x["d"]["stop"]
        return F.struct(x["d"].alias("d"), (held & ~x["d"]["base"]).alias("out"))

    return F.transform(F.filter(scanned(order, ends, f"struct<d:{DETECTION},out:boolean>", step, emit), lambda x: ~x["out"]), lambda x: x["d"])


def scan(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", names: tuple[str, str] = ("n_words", "detections")) -> DataFrame:
    """The rows and columns of `docs` with the number of words and the detections of their texts.

    A detection is (start, stop, rank, rule, label, base, confidence): words from 0, stop exclusive; rule counts from 0 in
    `rules` (the module's own where none are given). They are in order of start, the longer one of two that start together
    first. A null or empty text, or one without a word, has 0 words and no detections; whole texts are searched; repeated
    rows stay; an empty table gives an empty result. `names` must not be columns of `docs`.
    """
    require(docs, text)
    if set(map(str.lower, names)) & set(map(str.lower, docs.columns)):
        raise ValueError(f"{names} clash with the columns {docs.columns}")
    w, g, m = fresh([*docs.columns, *names], "w_", "g_", "m_")
    held = [F.col(f"`{c}`") for c in docs.columns]
    words = F.col(w)
    rows = docs.select(*held, words_of(F.col(f"`{text}`")).alias(w))
    rows = rows.select(*held, w, F.when(words == "  ", 0).otherwise(spaces(words) - 1).cast("long").alias(names[0]), gated(words, rules if rules is not None else parse()).alias(g))
    rows = rows.select(*held, names[0], F.when(F.size(g) > 0, matches(words, F.col(g))).otherwise(F.array().cast(f"array<{DETECTION}>")).alias(m))
    return rows.select(*held, names[0], F.when(F.size(m) > 0, unsuppressed(F.col(m))).otherwise(F.col(m)).alias(names[1]))


def labels_of(detections: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def license_digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and labels of `scan`'s result: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 less the chance that no label is right, the best confidence of each)."""
    d = F.col("detections")
    base = F.filter(d, lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    doubts = F.transform(F.array_distinct(F.transform(d, lambda x: x["label"])), lambda name: 1 - F.array_max(F.transform(F.filter(d, lambda x: x["label"] == name), lambda x: x["confidence"])))
    return found.select(
        F.col(f"`{doc_id}`").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels_of(base).alias("base_labels"), labels_of(d).alias("labels"), F.round(1 - F.aggregate(doubts, F.lit(1.0), lambda a, x: a * x), 6).alias("score"),
    )
