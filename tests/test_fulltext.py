"""English full text: stems, hits against all pairs, covers by hand; the store of postings against a scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import english
from corvane.operators import fulltext, postings
from corvane.plans import retrieval
from corvane.plans.base import chunks

STEMS = """consigned consign consignment consign consistency consist consolatory consolatori constancy constanc knackeries knackeri knavish knavish kneeling kneel knitted knit
knives knive happy happi cried cri by by say say ties tie tied tie gas gas this this kiwis kiwi gaps gap hopping hop hoping hope luxuriated luxuri generation generat general general communism communism
relational relat national nation vietnamization vietnam hopefulness hope electricity electr formalize formal adjustable adjust irritant irrit replacement replac adoption adopt decision decis
controlling control roll roll rate rate sized size filing file failing fail fizzed fizz agreed agre feed feed plastered plaster bled bled sing sing conflated conflat troubled troubl hissing hiss
skies sky news news proceeding proceed succeeded succeed youth youth boyish boyish enjoyed enjoy analogously analog allowance allow defensible defens activate activ homologous homolog bowdlerize bowdler
doors door unlocking unlock violently violent early earli herring herring arsenal arsenal""".split()


def test_stems():
    for word, want in zip(STEMS[::2], STEMS[1::2]):
        assert english.stem(word) == want, word
    assert len(english.STOP) == 127


def words(text):
    """(place, lexeme) of a text's words that aren't stop words."""
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return [(i, english.stem(w)) for i, w in enumerate(found, 1) if w not in english.STOP]


def covers(entries, wanted):
    """All stretches with every lexeme that hold no shorter one, by looking at each start and end."""
    full = [(a, b) for a in range(len(entries)) for b in range(a, len(entries)) if {x for _, x in entries[a : b + 1]} >= wanted]
    return [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]


def rank(text, ask, every):
    wanted = {x for _, x in words(ask)}
    entries = [e for e in words(text) if e[1] in wanted]
    if not every:
        return 0.1 * len(entries)
    if not wanted or {x for _, x in entries} != wanted:
        return 0.0
    return sum(0.1 / (1 + entries[b][0] - entries[a][0] - (b - a)) for a, b in covers(entries, wanted))


def slow(texts, asks, every, limit):
    out = set()
    for q, ask in asks.items():
        scored = sorted((-round(s, 9), k) for k, t in texts.items() if (s := rank(t, ask, every)) > 0)
        out |= {(q, k, n, -s) for n, (s, k) in enumerate(scored[:limit], 1)}
    return out


def found(df, key="chunk_no"):
    return {(r.query_id, r[key], r.arm_rank, round(r.score, 9)) for r in df.collect()}


def test_covers_by_hand(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["door", "doors", "lock", "locked", "the", "seal", "x"]) for _ in range(rng.choice([0, 3, 9, 25]))) for i in range(80)} | {900: None, 901: "", 902: "Door-lock: SEAL!", 903: "dooré lock seal"}
    asks = {1: "locking the doors", 2: "door", 3: "the", 4: "seals doors locks", 5: "absent door", 6: "", 7: "lock lock"}
    df, q = spark.createDataFrame(list(texts.items()), "chunk_no int, text string"), spark.createDataFrame(list(asks.items()), "query_id int, ask string")
    for every in (True, False):
        assert found(fulltext.search(q, df, 7, every)) == slow(texts, asks, every, 7)


@pytest.mark.parametrize("name", ["lexical_and", "lexical_or", "postings_search"])
def test_plans_equal_all_pairs(spark, sf, name):
    texts = {r.chunk_no: r.text for r in chunks(spark, sf).collect()}
    every = name != "lexical_or"
    asked = (retrieval.document_asks if every else retrieval.turn_asks)(spark, sf)
    asks = {r.query_id: r.ask for r in asked.collect()}
    got = found(getattr(retrieval, name)(spark, sf))
    assert len(asks) > 3 and got
    if every:  # covers of whole documents: hits and order by score; scores of the short ones by looking at all stretches
        wanted = {q: {x for _, x in words(a)} for q, a in asks.items()}
        hits = {(q, k) for q in asks for k, t in texts.items() if wanted[q] and wanted[q] <= {x for _, x in words(t)}}
        assert {(q, k) for q, k, *_ in got} == hits
        few = {q: a for q, a in asks.items() if len(words(a)) < 120}
        assert {g for g in got if g[0] in few and len(words(texts[g[1]])) < 150} <= slow({k: t for k, t in texts.items() if len(words(t)) < 150}, few, True, 20) or not few
    else:
        assert got == slow(texts, asks, False, 20)


def test_store_reads_its_terms_buckets_and_equals_a_rebuild(spark, sf, tmp_path):
    held = chunks(spark, sf)
    store = postings.PostingsStore(spark, str(tmp_path / "a"), buckets=16)
    store.update(held.where("chunk_no % 3 <> 1"))
    store.update(held.where("chunk_no % 3 = 0").withColumn("text", F.lit("nothing of it")))
    store.update(held.where("chunk_no % 3 <> 2"), removed=held.where("chunk_no % 10 = 2").select("chunk_no"))
    whole = postings.PostingsStore(spark, str(tmp_path / "b"), buckets=16)
    whole.update(held.where("chunk_no % 10 <> 2 OR chunk_no % 3 <> 2"))
    rows = lambda s: sorted((r.kind, r.term, r.chunk_no, tuple(r.positions)) for r in s.table.read().collect())
    assert rows(store) == rows(whole)
    store.table.compact()
    assert rows(store) == rows(whole) and len(store.table.version().segments) == 1
    wanted = spark.createDataFrame([("code", "F5E2")], "kind string, term string")
    plan = store.lookup(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    got = {(r.query_id, r.chunk_no, r.term) for r in store.keys_with(spark.createDataFrame([(1, ["F5E2", "F0E0"])], "query_id int, codes array<string>"), "codes", postings.CODE).collect()}
    want = set()
    for r in held.where("chunk_no % 10 <> 2 OR chunk_no % 3 <> 2").collect():
        said = {re.sub(r"\s", "", x).upper() for x in re.findall(r"(?i)F\s*[0-9]\s*E\s*[0-9]", r.text)} | set(r.error_codes or [])
        want |= {(1, r.chunk_no, c) for c in said & {"F5E2", "F0E0"}}
    assert got == want and want
