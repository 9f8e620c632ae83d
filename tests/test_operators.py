"""Operators over small tables, with the cases that plain plans get wrong."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import arms, chunking, dialogue, evidence, fusion, policy, ranking, safety, sessions, versions
from corvane.streaming import sessions as streams


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, doc_id string, chunk_id string, arm_rank int, score double")


def test_merge_takes_the_first_list(spark):
    a = hits(spark, [(1, "d", "x", 1, 1.0), (1, "d", "y", 2, 1.0)])
    b = hits(spark, [(1, "d", "y", 1, 0.5), (1, "d", "z", 2, 0.4)])
    got = [(r.chunk_id, r.score) for r in fusion.merge_hits(a, b).orderBy("merge_ord").collect()]
    assert got == [("x", 1.0), ("y", 1.0), ("z", 0.4)]


def test_restrict_only_if_something_is_left(spark):
    h = hits(spark, [(1, "a", "x", 1, 1.0), (1, "b", "y", 2, 1.0), (2, "b", "z", 1, 1.0)])
    assert sorted(r.chunk_id for r in fusion.restrict(h, F.col("doc_id") == "a").collect()) == ["x", "z"]
    assert fusion.restrict(h, F.col("doc_id") == "a", False).count() == 3


def test_union_pool_maps_onto_the_vector_band(spark):
    v, o = hits(spark, [(1, "d", "x", 1, 0.8), (1, "d", "y", 2, 0.4)]), hits(spark, [(1, "d", "y", 1, 10.0), (1, "d", "z", 2, 5.0)])
    got = {r.chunk_id: round(r.score, 6) for r in fusion.union_pool(v, o).collect()}
    assert got == {"x": 0.8, "y": 0.8, "z": 0.6}
    assert {r.chunk_id for r in fusion.union_pool(v, o.where("false")).collect()} == {"x", "y"}


def test_diverse_top(spark):
    rows = [(1, "a", f"a{i}", 1.0 - i / 10, i) for i in range(4)] + [(1, "b", "b0", 0.1, 9)] + [(2, "a", f"c{i}", 1.0, i) for i in range(4)]
    h = spark.createDataFrame(rows, "query_id int, doc_id string, chunk_id string, final_score double, merge_ord int")
    top = ranking.diverse_top(h, 3)
    assert [r.chunk_id for r in top.where("query_id = 1").orderBy("rank").collect()] == ["a0", "a1", "b0"]
    assert [r.chunk_id for r in top.where("query_id = 2").orderBy("rank").collect()] == ["c0", "c1", "c2"]  # one document only
    what = {r.chunk_id: r.disposition for r in ranking.dispositions(h, 3).where("query_id = 1").collect()}
    assert what == {"a0": "kept", "a1": "kept", "a2": "max_per_doc", "a3": "max_per_doc", "b0": "kept"}


def test_vector_fetch_without_vectors(spark):
    c = spark.createDataFrame([(1, "d", None), (2, "synth-x", [1.0, 0.0]), (3, "d", [0.0, 1.0]), (4, "d", [1.0, 1.0])], "chunk_no int, doc_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [])], "query_id int, vector array<double>")
    assert [r.chunk_no for r in arms.vector_fetch(q, c, 5).orderBy("arm_rank").collect()] == [4, 3]
    assert [r.chunk_no for r in arms.vector_fetch(q, c, 1, include_synthetic=True).collect()] == [2]


def test_pack_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([(1, 1, 900), (1, 2, 50), (2, 1, 300), (2, 2, 400), (2, 3, 250)], "q int, r int, c int")
    got = sorted((r.q, r.r, r["index"]) for r in evidence.pack(items, "q", "r", "c", 600).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 3, 2)]


def test_activate_keeps_one_active_version(spark):
    v = spark.createDataFrame([("a", 1, "active"), ("a", 2, "ready"), ("b", 1, "active"), ("b", 2, "abandoned")], "doc_id string, version int, status string")
    want = spark.createDataFrame([("a", 2), ("b", 2)], "doc_id string, version int")
    got = {(r.doc_id, r.version): r.status for r in versions.activate(v, want).collect()}
    assert got == {("a", 1): "superseded", ("a", 2): "active", ("b", 1): "active", ("b", 2): "abandoned"}


def test_spans(spark):
    s = spark.createDataFrame([(1, 0, 1, 2, 0.0, 1.0), (1, 1, 2, 3, 0.5, 1.0), (1, 2, 9, 9, 0.0, 1.0), (1, 3, 3, 3, 0.9, 0.1), (1, 4, 1, 2, 0.0, 1.0), (2, 0, 2, 2, 0.0, 1.0)], "version int, idx int, start_page int, end_page int, start_y double, end_y double")
    w = spark.createDataFrame([(1, 1, 5), (2, 1, 3), (3, 1, 2)], "version int, first int, last int")
    got = {(r.version, r.code) for r in versions.validate_spans(s, w).collect()}
    assert got == {(1, "overlapping_units"), (1, "unknown_page"), (1, "reversed_boundary"), (1, "duplicate_unit"), (1, "coverage_gap"), (2, "coverage_gap"), (3, "no_units")}
    grown = versions.absorb_gaps(s.where("version = 2"), w).collect()[0]
    assert (grown.start_page, grown.end_page, grown.start_y, grown.end_y) == (1, 3, 0.0, 1.0)


def test_split_prose(spark):
    p = spark.createDataFrame([(1, "intro\nTEST #4: x\nbody\nTEST #5: y ..... 3-1\nSECTION 2\nend"), (2, "SECTION 1\na"), (3, " \n ")], "k int, text string")
    got = {(r.k, r.piece): r.text for r in chunking.split_prose(p, "k").collect()}
    assert got == {(1, 1): "intro", (1, 2): "TEST #4: x\nbody\nTEST #5: y ..... 3-1", (1, 3): "SECTION 2\nend", (2, 1): "SECTION 1\na"}


def test_audit_and_improve(spark):
    rows = [("d", "t", "table_row", "F1E1 | fix it", "F1E1 | fix it", ["Code", "Fix"], ["F1E1"], "d", None, None), ("d", "p", "prose", "see F1E1", "see F1E1", [], ["F1E1"], "d", None, None)]
    c = spark.createDataFrame(rows, "doc_id string, chunk_id string, kind string, text string, body string, headers array<string>, error_codes array<string>, label string, section string, proposal string")
    after, left, why = chunking.audit_and_improve(c)
    assert [r.chunk_id for r in after.collect()] == ["t"] and after.collect()[0].text == "[d] Code | Fix F1E1 | fix it"
    assert left.where("repairable").count() == 0 and why.collect()[0].stop_reason == "after_one_repair"


def test_policy(spark):
    domains = {"a": ("bool", [True, False]), "n": ("int", [-1, 0, 3])}
    rules = {"r": "(=> a (>= n 0))"}
    cases = spark.createDataFrame([(1, "premise", "a", "true"), (1, "claim", "n", "-1"), (2, "claim", "a", "true"), (3, "premise", "n", "-1"), (3, "claim", "a", "false")], "case_id int, role string, name string, value string")
    assert {r.case_id: r.outcome for r in policy.check(cases, spark, domains, rules).collect()} == {1: "invalid", 2: "satisfiable", 3: "valid"}
    with pytest.raises(ValueError):
        policy.parse("(and a")
    with pytest.raises(ValueError):
        policy.assignments(spark, {f"v{i}": ("bool", [True, False]) for i in range(30)})


def test_assessment_takes_the_highest_then_the_first(spark):
    r = spark.createDataFrame([(1, "owner", "unplug it, remove the rear panel and measure live voltage"), (2, "technician", "bypass the lock"), (3, "owner", None)], "request_id int, audience string, question string")
    assert {x.request_id: (x.action, x.rule_id) for x in safety.assess(r).collect()} == {1: ("escalate", "live-voltage"), 2: ("block", "bypass-interlock"), 3: ("allow", "empty")}


def test_sessionize_gap_is_strict(spark):
    e = spark.sql("select 1 as user_id, * from values (1, timestamp_ntz'2024-01-01 00:00:00'), (2, timestamp_ntz'2024-01-01 00:30:00'), (3, timestamp_ntz'2024-01-01 01:00:01') as v(event_id, ts)")
    assert [r.session_no for r in sessions.sessionize(e, 1800).orderBy("event_id").collect()] == [1, 1, 2]


def test_session_query_returns_to_the_symptom(spark):
    t = spark.createDataFrame([(1, 1, "user", "it leaks F5 E2"), (1, 2, "assistant", "check"), (1, 3, "user", "ok, done".replace(", done", "")), (2, 1, "user", "a"), (2, 2, "user", "b"), (2, 3, "user", "c"), (2, 4, "user", "d")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.query for r in sessions.session_query(t).collect()} == {1: "F5E2 it leaks F5 E2", 2: "b c d"}


def test_gate_stream_stops_at_a_hazard(spark, tmp_path):
    pieces = [("a", 0, "Open the lid. ", False), ("a", 1, "Then bypass the door lock. ", False), ("a", 2, "Done.", True), ("b", 0, "All is well ", False), ("b", 1, "here.", True)]
    spark.createDataFrame(pieces, "answer_id string, n int, piece string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("answer_id string, n int, piece string, last boolean").parquet(str(tmp_path / "in"))
    q = streams.gate_stream(src, hold_back=5, ttl_ms=None).writeStream.format("memory").queryName("gated").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.answer_id: (r.released, r.stopped) for r in spark.table("gated").collect()} == {"a": ("", True), "b": ("All is well here.", False)}


def test_operators_over_nothing(spark):
    h = hits(spark, [(1, "a", "x", 1, 1.0)]).where("false")
    assert fusion.merge_hits(h, h).count() == 0 and fusion.rrf(h, h).count() == 0 and fusion.union_pool(h, h).count() == 0 and fusion.restrict(h, F.lit(True)).count() == 0
    ranked = h.withColumn("final_score", F.col("score")).withColumn("merge_ord", F.col("arm_rank"))
    assert ranking.diverse_top(ranked, 3).count() == 0 and ranking.dispositions(ranked, 3).count() == 0
    turns = spark.createDataFrame([(1, 1, "user", None)], "conv_id long, turn long, role string, text string")
    assert sessions.session_query(turns.where("false")).count() == 0 and dialogue.fold_boards(turns.where("false")).count() == 0
    assert chunking.fixed_windows(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "k int, text string"), "k").count() == 0


def test_document_applies_reasons(spark):
    asked = spark.createDataFrame([(1, "WFW5620HW0", "CF81600001", 2018), (2, "WFW5620HW0", None, 2018), (3, "ABC", None, None), (4, "WFW5620HW0", "bad", 2018)], "query_id int, model string, serial string, introduced int")
    pats = spark.createDataFrame([("d1", "WFW*"), ("d2", "WFW5620HW0"), ("d3", "wfw5620hw*")], "doc_id string, pattern string")
    rng = spark.createDataFrame([("d1", "range", None, "CF81500000", "CF820xxxx"), ("d2", "all", None, None, None)], "doc_id string, scope string, model string, first string, last string")
    docs = spark.createDataFrame([("d1", "2018"), ("d2", "2018-05"), ("d3", None)], "doc_id string, published string")
    got = {(r.query_id, r.doc_id): r.reason for r in ranking.document_applies(asked, pats, rng, docs).collect()}
    assert got[1, "d1"] == "serial in a range" and got[2, "d1"] == "serial number missing" and got[4, "d1"] == "serial malformed"
    assert {got[q, "d2"] for q in (1, 2, 4)} == {"all serial numbers"} and {got[q, "d3"] for q in (1, 2, 4)} == {"no serial restriction"}
    assert {got[3, d] for d in ("d1", "d2", "d3")} == {"model not listed"}
