"""Replies, boards and what is shown of them."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import replies
from corvane.operators import answers, dialogue, grading


def said(spark, *texts):
    return spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")


@pytest.mark.parametrize(("text", "ack", "progress"), [("checked. those look good", True, True), ("still facing the issue", False, True), ("the washer is dripping", False, False), ("", False, False), (None, False, False)])
def test_replies(spark, text, ack, progress):
    r = said(spark, text).select(replies.is_ack(F.col("text")), replies.is_progress(F.col("text"))).collect()[0]
    assert (bool(r[0]), bool(r[1])) == (ack, progress)


def turns(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "conv_id int, turn int, role string, text string, label string, diagnostic string")


def fold(spark, *rows):
    return dialogue.fold_boards(turns(spark, *rows)).collect()[0]


def test_listed_checks_are_cleared_by_an_ack_and_kept_else(spark):
    asked = ("assistant", "Try this:\n1. Check the drain hose [1]\n2. See TEST #4 [2]", None, None)
    good = fold(spark, ("user", "It will not drain", "new_symptom", None), asked, ("user", "checked. those look good", "ack", None))
    assert good.symptom_anchor == "It will not drain" and good.step == 2
    assert "Check the drain hose" in good.ruled_out and "test #4" in " ".join(good.ruled_out).lower()
    other = fold(spark, ("user", "It will not drain", "new_symptom", None), asked, ("user", "what is a drain hose?", None, None))
    assert other.ruled_out == []


def test_a_new_symptom_freezes_what_was_cleared(spark):
    asked = ("assistant", "1. Check the drain hose [1]\n2. Check the filter [1]", None, None)
    b = fold(spark, ("user", "It will not drain", "new_symptom", None), asked, ("user", "checked, all good", "ack", None), ("user", "now it stops mid wash", "mid_cycle_stop", None))
    assert [p.text for p in b.symptom_path] == ["It will not drain", "now it stops mid wash"]
    assert b.symptom_path[0].frozen_cleared and not b.symptom_path[1].frozen_cleared


def test_a_report_is_read_and_broken_ones_are_left_out(spark):
    report = json.dumps({"phase": "causes", "hypotheses": ["Blocked hose", "Blocked hose", " "], "next_check": "Check the pump"})
    b = fold(spark, ("user", "It will not drain", None, report), ("assistant", "Look.", None, None), ("user", "and now?", None, "{"))
    assert b.phase in dialogue.PHASES and b.hypotheses == ["Blocked hose"]
    assert dialogue.Board.read(None) == dialogue.Board() and dialogue.Board.read({"phase": "odd", "observations": [3, "x"]}).phase == "symptoms"


def test_listed_checks():
    assert dialogue.listed_checks("1. **Check** the hose [1]\n2. Clean it.") == ["Check the hose", "Clean it"]
    assert dialogue.listed_checks("First 1. check the hose 2. clean it") == ["check the hose", "clean it"]
    assert dialogue.listed_checks("1. one line in text") == ["one line in text"] and dialogue.listed_checks(None) == [] and dialogue.listed_checks("See 1. alone") == []


def test_output_of_models():
    read = answers.read_output
    assert read("")["abstained"] and read("ABSTAIN: no")["abstain_reason"] == "no"
    fenced = read('```json\n{"answer": "Do it [1].", "claims": [{"text": "Do it", "evidence_index": 1}]}\n```')
    assert fenced["answer"] == "Do it [1]." and not fenced["abstained"]
    assert [c["evidence_index"] for c in read("Do it [2]. Then wait.")["claims"]] == [2, None]


def test_grades(spark):
    rows = [(1, "See the lock [1]", ["D1"], False, ["D1"], None), (2, "See the lock", [], False, ["D1"], ["bypass"]), (3, "bypass it", ["D1"], False, ["D1"], ["bypass"]), (4, "ABSTAIN: none", [], True, None, ["bypass"])]
    d = spark.createDataFrame(rows, "i int, answer string, citations array<string>, abstained boolean, must_cite array<string>, fails_if_contains array<string>")
    none = F.lit(None).cast("array<string>")
    d = d.withColumns({"expect_contains": none, "expect_abstain": F.lit(False), "phase": F.lit(None).cast("string"), "ruled_out": none, "hypotheses": none})
    got = {r.i: r.passed for r in grading.graded(d).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
