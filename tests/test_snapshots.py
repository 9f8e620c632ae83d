"""Tables with versions: atomic publishing, conflicts, failing documents, earlier versions."""

import threading

import pytest
from pyspark.sql import functions as F

from corvane.sources import snapshots

SCHEMA = "doc string, n int, text string"


@pytest.fixture
def held(spark, tmp_path):
    return snapshots.SnapshotTable(spark, str(tmp_path / "t"), "doc", SCHEMA)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(held, number=None):
    return sorted(map(tuple, held.read(number).collect()), key=str)


def test_later_rows_replace_those_of_their_keys(spark, held):
    assert rows(held) == [] and held.latest() == 0
    assert held.replace(frame(spark, ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "none"))) == 1
    assert held.replace(frame(spark, ("a", 9, "new"), (None, 2, "none"))) == 2
    assert held.replace(frame(spark, ("c", 1, "c")), removed=frame(spark, ("b", 0, ""))) == 3
    assert rows(held) == sorted([("a", 9, "new"), (None, 2, "none"), ("c", 1, "c")], key=str)
    assert len(rows(held, 1)) == 4 and len(rows(held, 2)) == 3
    before = rows(held)
    assert held.compact() == 4 and rows(held) == before and len(held.version().segments) == 1
    assert held.revert(1) == 5 and rows(held) == rows(held, 1)


def test_two_writers_of_one_key_one_wins(spark, held):
    base = held.replace(frame(spark, ("a", 0, ""), ("b", 0, "")))
    one, two, other = (held.stage(frame(spark, r)) for r in (("a", 1, "one"), ("a", 2, "two"), ("b", 3, "other")))
    won, lost = [], []

    def write(folder):
        try:
            won.append((folder, held.commit(folder, base)))
        except snapshots.Conflict:
            lost.append(folder)

    threads = [threading.Thread(target=write, args=(f,)) for f in (one, two, other)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(lost) == 1 and lost[0] in (one, two) and sorted(n for _, n in won) == [base + 1, base + 2]
    kept = "one" if two in lost else "two"
    assert [(d, t) for d, _, t in rows(held)] == [("a", kept), ("b", "other")]


def test_a_number_is_given_once(held, spark):
    held.replace(frame(spark, ("a", 0, "")))
    v = snapshots.Version(2, held.version().segments, "mine")
    assert held._publish(v) and not held._publish(snapshots.Version(2, [], "theirs"))
    assert held.version().note == "mine" and held.latest() == 2


def test_readers_see_no_staged_segment(spark, held):
    held.replace(frame(spark, ("a", 0, "")))
    held.stage(frame(spark, ("a", 1, ""), ("b", 1, "")))
    assert rows(held) == [("a", 0, "")]


def test_a_failed_document_leaves_the_others_committed(spark, held):
    held.replace(frame(spark, ("a", 0, "old"), ("b", 0, "old")))
    new = frame(spark, ("a", 1, "new"), ("b", 1, "new"), ("b", 2, None), ("c", 1, "new"))
    number, report = snapshots.publish_documents(held, new, new.where("text is null").select("doc", F.lit("no text").alias("reason")))
    assert number == 2 and sorted(map(tuple, report.collect())) == [("a", True, None), ("b", False, "no text"), ("c", True, None)]
    assert rows(held) == [("a", 1, "new"), ("b", 0, "old"), ("c", 1, "new")]


def test_a_conflict_with_what_a_compaction_has_taken_in(spark, held):
    held.replace(frame(spark, ("a", 0, ""), ("b", 0, "")))
    staged = held.stage(frame(spark, ("b", 5, "late")))
    held.replace(frame(spark), removed=frame(spark, ("b", 0, "")))
    held.compact()
    with pytest.raises(snapshots.Conflict):
        held.commit(staged, 1)
