"""Units under edits, versions, representations, proposals, and answers under a policy."""

import json

import pytest

from corvane.operators import curation, release, review


def units(n):
    board = review.UnitBoard([], {p: f"Page {p}" for p in range(1, n + 1)})
    for p in range(1, n + 1):
        board.apply({"action": "add", "start_page": p, "end_page": p, "title": f"Unit {p}", "unit_type": "procedure"})
    return board


def spans(board):
    return [(u.title, u.start, u.end) for u in board.in_order()]


def test_split_merge_move():
    b = units(3)
    keys = [u.unit_key for u in b.in_order()]
    b.apply({"action": "merge", "unit_key": keys[1], "other_key": keys[0]})
    assert spans(b)[0] == ("Unit 1", (1, 0.0), (2, 1.0)) and b.removed == [keys[1]] and b.get(keys[0]).source_text == "Page 1\nPage 2"
    b.apply({"action": "split", "unit_key": keys[0], "at_page": 2, "at_y": 0.0, "title": "Second"})
    assert [s[1:] for s in spans(b)[:2]] == [((1, 0.0), (1, 1.0)), ((2, 0.0), (2, 1.0))]
    b.apply({"action": "move_boundary", "unit_key": keys[2], "start_page": 2, "start_y": 0.5})
    assert spans(b)[-1][1] == (2, 0.5) and b.get(keys[2]).review_status == review.EDITED
    b.apply({"action": "set_review_status", "unit_key": keys[2], "status": review.APPROVED})
    assert b.get(keys[2]).review_status == review.APPROVED and len(b.get(keys[2]).edits) >= 2


def test_resizing_pushes_and_absorbs():
    b = units(4)
    keys = [u.unit_key for u in b.in_order()]
    b.apply({"action": "resize_push", "unit_key": keys[0], "end_page": 3, "end_y": 0.5})
    assert spans(b) == [("Unit 1", (1, 0.0), (3, 0.5)), ("Unit 3", (3, 0.5), (3, 1.0)), ("Unit 4", (4, 0.0), (4, 1.0))] and b.removed == [keys[1]]


@pytest.mark.parametrize("edit", [
    {"action": "split", "unit_key": "x"}, {"action": "remove", "unit_key": "nope"}, {"action": "dance"}, {"action": "split", "unit_key": "002-unit-1", "at_page": 9},
    {"action": "set_review_status", "unit_key": "002-unit-1", "status": "odd"}, {"action": "move_boundary", "unit_key": "002-unit-1", "start_page": 5, "end_page": 1},
])
def test_edits_that_units_do_not_allow(edit):
    b = units(2)
    before = spans(b)
    edit = edit | ({"unit_key": b.in_order()[0].unit_key} if edit.get("unit_key") == "002-unit-1" else {})
    with pytest.raises(review.EditError):
        b.apply(edit)
    assert spans(b) == before


def test_proposals():
    good = curation.read_proposal(json.dumps({"units": [{"start_page": 1, "end_page": 2, "title": "Intro", "unit_type": "overview"}]}))
    assert [(u["start_page"], u["end_page"], u["title"], u.get("error")) for u in good] == [(1, 2, "Intro", None)]
    for bad in (None, "", "no", "[]", "{}", '{"units": 3}'):
        assert curation.read_proposal(bad)[0]["error"]


def test_only_ready_and_earlier_versions_are_activated(spark):
    rows = [("A", 1, "structured", "active"), ("A", 2, "semantic_llm", "ready"), ("B", 1, "structured", "active"), ("B", 2, "semantic_llm", "candidate"), ("C", 1, "structured", "superseded"), ("C", 2, "structured", "active")]
    v = spark.createDataFrame([(*r, "fp", None, None) for r in rows], "doc_id string, version int, strategy string, status string, source_fingerprint string, superseded_by int, forked_from int")
    w = spark.createDataFrame([("A", 2), ("B", 2), ("C", 1), ("D", 1)], "doc_id string, version int")
    after, refused = curation.activated(v, w)
    got = {(r.doc_id, r.version): (r.status, r.superseded_by) for r in after.collect()}
    assert got == {("A", 1): ("superseded", 2), ("A", 2): ("active", None), ("B", 1): ("active", None), ("B", 2): ("candidate", None), ("C", 1): ("active", None), ("C", 2): ("superseded", 1)}
    assert {(r.doc_id, r.reason) for r in refused.collect()} == {("B", "is candidate"), ("D", "does not exist")}


VARS = [{"name": "open", "role": "fact", "type": "bool"}, {"name": "code", "role": "fact", "type": "enum", "values": ["none", "f5e2"]}, {"name": "bypass", "role": "claim", "type": "bool", "requires": "open"}]


def test_formalizations(spark):
    raw = [
        '{"premises": [{"name": "open", "value": "true"}], "claims": [{"name": "bypass", "value": "true", "text": "bypass it"}]}', '{"premises": [], "claims": [{"name": "bypass", "value": "true", "text": "bypass it"}]}',
        '{"premises": [{"name": "code", "value": "f9"}]}', '{"premises": [{"name": "what", "value": "1"}]}', "nonsense", None, '{"premises": [], "ambiguous": ["code", "bypass"]}',
    ]
    f = {r.i: r for r in release.formalizations(spark.createDataFrame(list(enumerate(raw)), "i int, raw string"), ["i"], VARS).collect()}
    assert (f[0].premises, f[0].claims, f[0].ambiguous) == ({"open": "true"}, {"bypass": "true"}, False)
    assert (f[1].claims, f[1].untranslated) == ({}, ["bypass it"])
    assert [f[i].ambiguous for i in range(2, 7)] == [True] * 5 and f[6].reason == "model_ambiguous:code"
