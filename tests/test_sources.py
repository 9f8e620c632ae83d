"""Readers and writers, over files made for the test."""

import hashlib
import json

import pytest

from corvane.operators import tables
from corvane.sources import readers, writers
from corvane.streaming import sessions as streams


def test_chunks_round_trip(spark, tmp_path):
    c = spark.createDataFrame([("a", "c1", "text", 1), ("b", "c2", "more", 2)], "doc_id string, chunk_id string, text string, page int")
    writers.parsed(c, str(tmp_path / "parsed"))
    folder = tmp_path / "flat" / "a"
    folder.mkdir(parents=True)
    (folder / "chunks.jsonl").write_text(json.dumps({"chunk_id": "c1", "text": "t", "page": 1, "error_codes": ["F1E1"], "metadata": {"k": "v"}}) + "\n")
    (folder / "other.jsonl").write_text("{}\n")
    rows = readers.parsed_chunks(spark, str(tmp_path / "flat")).collect()
    assert [(r.chunk_id, r.error_codes, r.metadata) for r in rows] == [("c1", ["F1E1"], {"k": "v"})]
    assert rows[0].source_file.endswith("a/chunks.jsonl")
    assert {r.doc_id for r in spark.read.json(str(tmp_path / "parsed")).collect()} == {"a", "b"}


def test_manifest_of_json_files(spark, tmp_path):
    doc = {"doc_id": "d1", "publication_number": "W10000001", "authority": {"tier": "t"}, "relationships": [{"type": "supersedes", "target": "W10000002"}, {"type": "references", "target": "W10000003"}]}
    (tmp_path / "one.json").write_text(json.dumps(doc))
    (tmp_path / "_draft.json").write_text(json.dumps(doc | {"doc_id": "d2"}))
    docs = readers.manifest(spark, str(tmp_path))
    assert [r.doc_id for r in docs.collect()] == ["d1"]
    assert [(r.ord, r.type, r.target) for r in readers.edges_of(docs).orderBy("ord").collect()] == [(0, "supersedes", "W10000002"), (1, "references", "W10000003")]


MIME = b"""From: saved\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="x"\r\n\r\n--x\r\nContent-Type: text/html; charset="utf-8"\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<html><p class=3D"a">caf=C3=A9 and a lo=\r\nng line</p></html>\r\n--x--\r\n"""


@pytest.mark.parametrize(("raw", "found"), [(MIME, '<p class="a">café and a long line</p>'), (b"junk <html><p>plain</p></html>", "<html><p>plain</p></html>"), (b"x <html a=3D1>b=C3=A9</html>", "<html a=1>bé</html>")])
def test_saved_pages(raw, found):
    assert found in readers.mhtml_to_html(raw)


def test_archives_and_identities(spark, tmp_path):
    (tmp_path / "a.mhtml").write_bytes(MIME)
    (tmp_path / "b.txt").write_bytes(b"one\ftwo")
    assert [r.html.startswith("<html>") for r in readers.archives(spark, str(tmp_path)).collect()] == [True]
    got = {r.name: (r.bytes, r.sha256) for r in readers.file_identities(spark, str(tmp_path)).collect()}
    assert got["b.txt"] == (7, hashlib.sha256(b"one\ftwo").hexdigest())
    pages = readers.extracted_pages(spark, str(tmp_path), "text", "*.txt").orderBy("page").collect()
    assert [(r.page, r.text) for r in pages] == [(1, "one"), (2, "two")]


def test_trace_records_of_two_shapes(spark):
    raw = spark.createDataFrame([('{"id": "a", "input": {"question": "q"}, "output": {"answer": "x"}}',), ('{"traceId": "b", "question": "r", "answer": "y", "version": "abc1234"}',), ("no json",)], "value string")
    assert {(r.trace_id, r.question, r.answer, r.git_sha) for r in readers.trace_records(raw).collect()} == {("a", "q", "x", None), ("b", "r", "y", "abc1234"), (None, None, None, None)}


def test_carry_down_and_unique_boxes(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, "b"), (1, 4, None), (2, 1, "")], "t int, r int, c string")
    assert [(r.t, r.r, r.c) for r in tables.carry_down(rows, "t", "r", "c").orderBy("t", "r").collect()] == [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "b"), (2, 1, None)]
    keyed = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "z")], "id int, k string")
    found = spark.createDataFrame([("x", 10), ("y", 20), ("z", 30), ("z", 31)], "k string, box int")
    assert {r.id: r.box for r in tables.unique_boxes(keyed, found, ["k"]).collect()} == {1: 10, 2: None, 3: None, 4: None}


def test_boards_survive_batches(spark, tmp_path):
    ddl = "conv_id long, turn long, role string, text string"
    source = tmp_path / "in"
    spark.createDataFrame([(1, 1, "user", "it leaks")], ddl).coalesce(1).write.parquet(str(source))
    q = streams.fold_boards(spark.readStream.schema(ddl).parquet(str(source)), ttl_ms=None).writeStream.format("memory").queryName("boards").outputMode("update").start()
    try:
        q.processAllAvailable()
        spark.createDataFrame([(1, 2, "assistant", "where?"), (1, 3, "user", "at the  door")], ddl).coalesce(1).write.mode("append").parquet(str(source))
        q.processAllAvailable()
    finally:
        q.stop()
    got = [(r.step, r.symptom_anchor, [o.text for o in r.observations]) for r in spark.table("boards").orderBy("step").collect()]
    assert got == [(1, "it leaks", ["it leaks"]), (2, "it leaks", ["it leaks", "at the door"])]


def test_over_capacity(spark):
    s = spark.createDataFrame([(1, 5), (2, 9), (3, 7)], "user_id int, end int")
    assert [r.user_id for r in streams.over_capacity(s, 2).collect()] == [1]


def test_dataset_description(spark):
    d = spark.createDataFrame([("d", "p", "manual")], "doc_id string, publication_number string, doc_type string")
    rows = {r.kind: json.loads(r.json) for r in writers.dataset_description(d, "n").collect()}
    assert rows["dataset"]["size"] == 1 and rows["file"]["@id"] == "d"
