"""The manifest's checks, files against their pins, and golden assertions."""

from pyspark.sql import functions as F

from corvane.functions import layout
from corvane.operators import corpus, golden


def test_problems_of_a_manifest(spark):
    d = spark.createDataFrame([("a", "P1", "A", "open"), ("b", "P1", "A", "open"), ("c", "P2", None, "odd"), ("c", "P3", None, None)], "doc_id string, publication_number string, revision string, license string")
    e = spark.createDataFrame([("a", "references", "P2"), ("a", "references", "P9"), ("b", "references", "X1")], "doc_id string, type string, target string")
    x = spark.createDataFrame([("X1",)], "publication_number string")
    got = {(r.doc_id, r.problem) for r in corpus.problems(d, e, x, ["open"]).collect()}
    assert got == {("a", "duplicate edition"), ("b", "duplicate edition"), ("c", "licence not allowed"), ("c", "duplicate doc_id"), ("a", "dangling target P9")}


def test_files_against_their_pins(spark):
    d = spark.createDataFrame([("a", ["1"], False), ("b", ["1"], False), ("c", ["1"], True), ("d", [], False), ("e", None, None), ("f", ["1"], False)], "file string, pinned array<string>, volatile boolean")
    f = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "1"), ("e", "1"), ("g", "1")], "file string, sha256 string")
    assert {r.file: r.state for r in corpus.verified(d, f).collect()} == {"a": "ok", "b": "mismatch", "c": "drift", "d": "unpinned", "e": "unpinned", "f": "missing", "g": "unexpected"}


def test_drift(spark):
    d = spark.createDataFrame([("a", "P1", "2019", None), ("b", "P1", "2020-02", "see P7"), ("c", "P7", "2018", ""), ("d", "P8", "2021-01-05", "replaces P7")], "doc_id string, publication_number string, published string, blob string")
    e = spark.createDataFrame([("d", "supersedes", "P7")], "doc_id string, type string, target string")
    assert {tuple(r) for r in corpus.drift(d, e).collect()} == {("editions without precedence", "a", "b"), ("names an older document", "b", "c")}


def test_vectors_of_other_models(spark):
    r = spark.createDataFrame([(1, [1.0], "m"), (2, [1.0], None), (3, [1.0], "n"), (4, None, "n")], "k int, embedding array<double>, embedding_model string")
    assert {x.k: (x.embedding, x.embedding_model) for x in corpus.cleared(r, "m").collect()} == {1: ([1.0], "m"), 2: (None, None), 3: (None, None), 4: (None, "n")}


def test_layout_assertions(spark):
    c = spark.createDataFrame([("d", 1, 1, "Won’t start", None, "table_row", ["S"]), ("d", 1, 2, "Figure", "It's here", "prose", ["S", "Contents"])], "doc_id string, page int, place int, text string, body string, kind string, section_path array<string>")
    cases = [("phrase_present", ["won't start", "its here"], None, 0.0), ("phrase_present", ["gone"], None, 0.0), ("phrase_absent", ["FIGURE"], None, 0.0), ("section_not_like", None, "^cont", 0.0), ("section_not_like", None, "^x", 0.0),
             ("min_table_rows", None, None, 1.0), ("max_prose_chunks", None, None, 0.0), ("expect_class", ["matrix"], None, 0.0), ("odd", None, None, 0.0)]
    rules = spark.createDataFrame([("d", 1, "p", i, *x) for i, x in enumerate(cases)] + [("e", 1, "q", 0, "phrase_absent", ["x"], None, 0.0)], "doc_id string, page int, page_id string, ord int, type string, texts array<string>, pattern string, number double")
    kinds = spark.createDataFrame([("d", 1, "matrix")], "doc_id string, page int, layout_kind string")
    judged = golden.layout_asserts(rules, golden.page_facts(c), kinds)
    assert [r.passed for r in judged.where("doc_id = 'd'").orderBy("ord").collect()] == [True, False, False, False, True, True, False, True, False]
    assert {r.page_id: r.passed for r in golden.layout_run(judged).collect()} == {"p": False, "q": True}


def test_document_assertions(spark):
    p = spark.createDataFrame([("d", 1, "1. One \n2. Two", "en"), ("d", 2, "Three", "fr")], "doc_id string, page int, text string, language string")
    c = spark.createDataFrame([("d", "F1E2 Check the LOCK", ["F1E2"]), ("d", "see F3E4", [])], "doc_id string, text string, error_codes array<string>")
    cases = [("codes_present", ["F1E2", "F3E4"], None, None, None), ("codes_present", ["F1E2", "F9E9"], None, None, None), ("codes_present", ["F1E2", "F9E9"], None, 0.5, None), ("codes_bound", ["the lock"], None, None, "F1E2"),
             ("codes_bound", ["see"], None, None, "F3E4"), ("languages_present", ["en", "fr"], None, None, None), ("phrase_present", ["three"], None, None, None), ("phrase_order_monotonic", ["Two", "One"], 1, None, None),
             ("numbered_steps_present", ["1", "2"], 1, None, None), ("numbered_steps_present", ["1", "3"], 1, None, None), ("pua_mapped", None, None, 0.01, None)]
    rules = spark.createDataFrame([("d", i, *x) for i, x in enumerate(cases)], "doc_id string, ord int, type string, texts array<string>, page int, number double, code string")
    judged = golden.parse_asserts(rules, golden.document_facts(p, c), layout.map_private)
    assert [r.passed for r in judged.orderBy("ord").collect()] == [True, False, True, True, False, True, True, False, True, False, True]
    same = golden.same_pages(spark.createDataFrame([("d", "e", 1), ("d", "e", 2)], "a string, b string, page int"), p.unionByName(spark.createDataFrame([("e", 1, "1. One  2. Two", "en"), ("e", 2, "Four", "fr")], p.schema)), c.withColumns({"page": F.lit(9), "content_hash": F.lit("h")}))
    assert {r.page: r.passed for r in same.collect()} == {1: True, 2: False}
