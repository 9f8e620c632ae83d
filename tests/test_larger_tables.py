"""What showed only in larger tables: letters with accents beside words, tables in folders, numbers beyond those of small tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane import plans
from corvane.operators import arms, evidence, fulltext, metrics
from corvane.plans import registry

plans.load()


def test_procedural_words_end_at_accented_letters_as_in_sql(spark):
    said = ["dañvac one two three four", "vacuum one two three four", "Vac one two three four", "é_vac one two three four"]
    rows = spark.createDataFrame([(i, x, None, None) for i, x in enumerate(said)], "n int, claim string, cited int, evidence string")
    got = [r["checked"] for r in metrics.groundedness(rows).orderBy("n").collect()]
    want = duckdb.execute(r"SELECT list_transform(?, lambda x: regexp_matches(x, '(?i)\b(test|vac)\b'))", [said]).fetchone()[0]
    assert got == want == [True, False, True, False]


def test_editions_whose_manifest_edge_goes_astray_are_linked_as_in_sql(spark, tmp_path):
    spark.range(1, 1001).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = {tuple(r) for r in registry.PLANS["precedence_drift"](spark, str(tmp_path)).collect()}
    assert got == set(duck.sql(registry.SQL["precedence_drift"]).fetchall())


def test_streams_read_tables_that_are_folders(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/conversations.parquet").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = (sorted(map(tuple, registry.PLANS["stream_board_fold"](spark, x).collect())) for x in (str(tmp_path), sf))
    assert got == want and got


@pytest.mark.parametrize("group", [None, "g"])
def test_nearest_in_small_blocks_with_many_ties(spark, monkeypatch, group):
    monkeypatch.setattr(arms, "CELLS", 40)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 1)
    x[50:200] = x[0]  # copies
    rows = spark.createDataFrame([(f"k{int(i):03d}", f"g{int(i) % 17}", v.tolist()) for i, v in zip(rng.permutation(300), x)], "id_ string, g string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(12)], "query_id int, vector array<double>")
    c = arms.cosine("vector", "embedding")
    both = asked.crossJoin(rows).where(c.isNotNull()).select("query_id", group or "id_", c.alias("score"))
    both = both.groupBy("query_id", group).agg(F.max("score").alias("score")) if group else both
    want = arms.ranked(both, 7, F.desc(F.round("score", 12)), F.col(group or "id_"))
    got = arms.nearest(asked, rows, 7, group)
    key = lambda df: sorted((r["query_id"], r["arm_rank"], r[group or "id_"]) for r in df.collect())
    assert key(got) == key(want)
    best = arms.Best(12, 7)  # what is held doesn't grow with what comes
    for _ in range(400):
        best.take(rng.normal(size=(12, 50)), pa.array(rng.integers(0, 9999, 50)))
        assert len(best.q) <= 84 and best.gathered <= best.room + 600
    assert best.room <= 4 * 40 + 84


def test_texts_with_any_lexeme_in_blocks_equal_the_join(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "CELLS", 30)
    monkeypatch.setattr(fulltext, "BROADCAST_QUERIES", 5)
    rng = np.random.default_rng(5)
    words = "door lock washer drum pump valve hose filter cycle rinse".split()
    texts = spark.createDataFrame([(int(i), None if i % 9 == 0 else " ".join(rng.choice(words, rng.integers(0, 9)))) for i in range(150)], "chunk_no long, text string").repartition(3)
    asks = spark.createDataFrame([(i, " ".join(rng.choice([*words, "unknown", "the"], 3))) for i in range(12)], "query_id long, ask string")
    held = fulltext.postings(texts, "chunk_no")
    want = arms.ranked(fulltext.matched(fulltext.question_lexemes(asks), held, "chunk_no", False), 6, F.desc(F.round("score", 9)), F.col("chunk_no"))
    got = fulltext.search(asks, texts, 6)
    key = lambda df: sorted((r["query_id"], r["arm_rank"], r["chunk_no"], round(r["score"], 9)) for r in df.collect())
    assert key(got) == key(want) and got.columns == want.columns
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row for a pair


def test_siblings_by_sums_of_sizes_equal_the_windows(spark):
    rng = np.random.default_rng(9)
    name = lambda v: [str(x) if rng.random() > 0.15 else None for x in v]
    n = 160
    chunks = spark.createDataFrame(
        [(f"d{a}", f"c{b}", int(p) if p else None, t, "table_row" if k else "prose", x, float(y)) for a, b, p, t, k, x, y in zip(rng.integers(0, 2, n), rng.integers(0, 300, n), rng.integers(0, 3, n), name(rng.integers(0, 2, n)), rng.random(n) > 0.1, rng.choice(["see test #1", "first", "x"], n), rng.integers(0, 5, n))],
        "doc_id string, chunk_id string, page int, problem_title string, kind string, body string, y0 double",
    ).distinct()
    some = [r for r in chunks.collect()]
    hits = []
    for q in range(40):
        for rank in range(int(rng.integers(1, 5))):
            r = some[rng.integers(len(some))]
            hits.append((q, rank // 2 if q % 5 == 0 else rank, float(rng.random()), r.doc_id, r.chunk_id if q % 3 else f"h{q}-{rank}", r.page, r.problem_title))
    hits += [(99, r, 0.5, "d9", "lone", None, None) for r in range(3)]  # one hit again and again
    hits = spark.createDataFrame(hits, "query_id int, rank int, score double, doc_id string, chunk_id string, page int, problem_title string")
    key = ["query_id", "doc_id", "page", "problem_title"]
    grouped = hits.where("problem_title is not null and page is not null").groupBy(*key).agg(F.min("rank").alias("at"))
    rows = chunks.where("kind = 'table_row'").join(grouped, key[1:]).select(*key, "chunk_id", "at", F.row_number().over(Window.partitionBy(*key).orderBy(*evidence.sibling_order())).alias("own"))
    both = rows.unionByName(hits.select(*key, "chunk_id", F.col("rank").alias("at"), F.lit(0).alias("own")))
    first = both.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "doc_id", "chunk_id").orderBy("at", F.desc("own")))).where("r = 1")
    want = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "own", "chunk_id")))
    read = lambda df: sorted((r["query_id"], r["place"], r["chunk_id"], r["doc_id"]) for r in df.collect())
    assert read(evidence.expand_siblings(hits, chunks)) == read(want)
    plan = evidence.expand_siblings(hits, chunks)._jdf.queryExecution().optimizedPlan().toString()
    assert "part#" in plan  # rows dealt out, not sorted again for each query


def test_equal_boards_are_edited_once(spark):
    from corvane.operators import review

    unit = lambda i: {"unit_key": f"u{i}", "ordinal": i, "title": f"Line {i}", "unit_type": "other", "page_start": i, "page_end": i, "start_y": 0.0, "end_y": 1.0}
    todo = [{"action": "resize_push", "unit_key": "u1", "end_page": 2}, {"action": "remove", "unit_key": "u9"}]
    rows = [(v, [unit(i) for i in range(1, 2 + v % 3)] if v % 7 else None, [{"page": 1, "text": "a"}, {"page": 2, "text": None}] if v % 2 else None, todo if v % 5 else None) for v in range(300)]
    boards = spark.createDataFrame(rows, f"version long, units array<{review.UNIT}>, pages {review.PAGES}, todo array<{review.EDIT}>")
    got = review.edit_units(boards)
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()  # what was edited is joined, each different board once
    rows = {r.version: r for r in got.collect()}
    assert len(rows) == 300 and got.columns == ["version", "units", "changed", "removed", "errors"]
    for v, r in rows.items():
        n = (1 + v % 3) if v % 7 else 0
        assert len(r.errors) == (0 if v % 5 == 0 else 2 if n == 0 else 1)
        keys = [f"u{i}" for i in range(1, n + 1) if i != 2 or v % 5 == 0]
        assert [u.unit_key for u in r.units] == keys and r.removed == (["u2"] if v % 5 and n >= 2 else [])
        if v % 5 and n:
            assert r.units[0].page_end == 2 and r.units[0].source_text == ("a" if v % 2 else "")


def test_texts_with_all_lexemes_in_blocks_equal_the_joins(spark, monkeypatch, tmp_path):
    from corvane.operators import postings

    monkeypatch.setattr(fulltext, "SOUGHT", 12)
    rng = np.random.default_rng(6)
    words = "door lock washer drum pump valve hose filter cycle rinse".split()
    texts = spark.createDataFrame([(int(i), None if i % 9 == 0 else " ".join(rng.choice(words, rng.integers(0, 14))), None) for i in range(150)], "chunk_no long, text string, error_codes array<string>").repartition(3)
    asks = [(i, " ".join(rng.choice([*words, "the"], 1 + i % 4))) for i in range(14)] + [(20, "unknown door"), (21, "the"), (22, "rinse doors"), (23, "door door rinsing"), (24, None)]
    asks = spark.createDataFrame(asks, "query_id long, ask string")
    held = fulltext.postings(texts, "chunk_no")
    want = arms.ranked(fulltext.matched(fulltext.question_lexemes(asks), held, "chunk_no", True), 6, F.desc(F.round("score", 9)), F.col("chunk_no"))
    store = postings.PostingsStore(spark, str(tmp_path))
    store.update(texts)
    key = lambda df: sorted((r["query_id"], r["arm_rank"], r["chunk_no"], r["score"]) for r in df.collect())
    for got in (fulltext.search(asks, texts, 6, every=True), store.search(asks, 6, every=True)):
        assert key(got) == key(want) and got.columns == want.columns
        assert {22, 23} <= {r["query_id"] for r in got.collect()}
    plan = fulltext.search(asks, texts, 6, every=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "lexeme" not in plan.split("MapInArrow")[0]  # no row for a pair, joined are alike questions only


def test_pages_in_columns_equal_word_by_word(spark):
    from corvane.operators import boxes

    rng = np.random.default_rng(11)

    def page(n, width):
        at = rng.choice([20.0, 100.0, 286.0, 326.4, 400.0, width], n)
        return [{"text": f"w{i}", "x0": float(a), "y0": float(b), "x1": float(a) + 9, "y1": float(b) + 9} for i, (a, b) in enumerate(zip(at, rng.choice([0.25, 0.15, 3.15, 3.25, 6.3, 12.0, 15.0, 15.04, 18.04], n)))]

    rule = {"x0": 300.0, "x1": 301.0, "top": 0.0, "bottom": 90.0}
    rows = [(i, page(n, w or 612.0) if n else None, w, [rule | {"x0": 10.0, "x1": 10.0}, rule] if i % 3 == 0 else None) for i, (n, w) in enumerate([(0, 612.0), (39, 612.0), (40, None), (80, 0.0), (200, 612.0), (90, 900.0), (300, 612.0)])]
    pages = spark.createDataFrame(rows, f"k int, words array<{boxes.WORD}>, page_width double, rules array<struct<x0:double,x1:double,top:double,bottom:double>>")

    def lines(words):
        out = []
        for w in sorted(words, key=lambda w: (round(w["y0"], 1), w["x0"])):
            if out and abs(w["y0"] - out[-1][0]["y0"]) <= boxes.LINE:
                out[-1].append(w)
            else:
                out.append([w])
        return [" ".join(w["text"] for w in sorted(x, key=lambda w: w["x0"])) for x in out]

    got = {r.k: r for r in boxes.reading_order(pages, ["k"]).collect()}
    parted = {r.k: r.partition_x for r in boxes.columns_of(pages, ["k"]).collect()}
    assert any(parted.values()) and not all(parted.values())
    for k, words, width, rules in rows:
        at = boxes.partition_x(words or [], width, rules)
        sides = [lines(words or [])] if at is None else [lines([w for w in words if (w["x0"] < at - boxes.GUTTER) == s]) for s in (True, False)]
        want = "\n".join(sides[0]) if at is None else "\n".join(sides[0] + ([""] if all(sides) else []) + sides[1])
        assert (got[k].text, got[k].reordered, got[k].partition_x, parted[k]) == (want, at is not None, at, at)
    plan = boxes.columns_of(pages, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # no word goes to Python


def test_boxes_of_long_pages_make_no_object_of_a_word(spark, monkeypatch):
    from corvane.operators import boxes, structured

    tokens = [f"w{i}" if i % 50 else "" for i in range(400)]
    words = [{"text": t, "x0": i % 10 * 55.0, "y0": i // 10 * 12.0, "x1": i % 10 * 55.0 + 40, "y1": i // 10 * 12.0 + 10} for i, t in enumerate(tokens)]
    body = " ".join(t for t in tokens[11:39] if t)
    page = {"page": 1, "text": body + "\nTEST #4: Valve\n" + " ".join(tokens[61:79]), "language": None, "drawn": False, "tables": [], "words": words, "page_width": 612.0, "page_height": 792.0, "layout_kind": "default"}
    documents = spark.createDataFrame([(1, "A", [page, page | {"page": 2, "words": None}]), (2, "B", None), (3, "C", [page | {"page": 3, "words": words[:30]}])], f"doc_id int, label string, pages array<{structured.PAGE}>")
    want = {(d, c["page"], c["body"]): c["bbox"] for d, label, pages in [(1, "A", [page, page | {"page": 2, "words": None}]), (3, "C", [page | {"page": 3, "words": words[:30]}])] for c in structured.Chunker(label).run(pages)}
    assert want[1, 1, body] == {"x0": 0.0, "y0": 12.0, "x1": 535.0, "y1": 46.0}
    plan = structured.chunk_documents(documents)
    assert {(r.doc_id, r.page, r.body): r.bbox.asDict() if r.bbox else None for r in plan.collect()} == want
    lists = boxes.words_of(pa.array([words, None, [], words[:2]]))
    assert [len(w) for w in lists] == [400, 0, 0, 2]
    monkeypatch.setattr(boxes.Words, "of", None)  # rows of words are never asked for
    held = boxes.PageWords(lists[0], 612.0, "default")
    assert "_tokens" not in vars(held) and held.box("no words") is None and "_tokens" not in vars(held)  # too short to be looked for
    assert held.box(body) == want[1, 1, body]
    one = documents.select("doc_id", "pages", "label")
    assert structured.canonical_nodes(one).count() > 3


def test_store_gathers_postings_of_keys_that_may_answer_alone(spark, monkeypatch, tmp_path):
    from corvane.operators import postings

    read, block = [], fulltext._block
    monkeypatch.setattr(fulltext, "_block", lambda asked, rows, *more: read.append([r["chunk_no"] for r in rows.collect()]) or block(asked, rows, *more))
    monkeypatch.setattr(fulltext, "SOUGHT", 6)
    rows = lambda x: spark.createDataFrame([(i, t, None) for i, t in x], "chunk_no long, text string, error_codes array<string>")
    texts = [(i, f"doors lock bit{i} pump part{i % 100}") for i in range(300)]
    store = postings.PostingsStore(spark, str(tmp_path))
    store.update(rows([(i, "door bit7" if i == 30 else "an earlier lock" if i % 3 == 0 and i != 108 else t) for i, t in texts]))
    store.update(rows([(i, t) for i, t in texts if i % 3 == 0 and i != 108]), removed=rows([(108, None)]).select("chunk_no"))
    asks = spark.createDataFrame([(1, "door bit7"), (2, "locked bit12 doors"), (3, "pump part8"), (4, "bit8 part9"), (5, "unknown door"), (6, "bit7 the doors")], "query_id long, ask string")
    want = [(1, 1, 7), (2, 1, 12), (3, 1, 8), (3, 2, 208), (6, 1, 7)]
    assert sorted((r["query_id"], r["arm_rank"], r["chunk_no"]) for r in store.search(asks, 6, every=True).collect()) == want
    assert len(read) > 1 and sorted(set(sum(read, []))) == [7, 8, 12, 30, 208]  # 30 for its earlier text; before: every key that has a lexeme of a question, in each block
    assert fulltext.search(asks, rows(texts), 6, every=True).count() == 6  # 108 too
    assert sorted(set(sum(read, []))) == [7, 8, 12, 30, 108, 208]


def test_postings_equal_positions_whatever_is_put_in_order_at_once(spark, monkeypatch):
    from corvane.functions import english

    rng = np.random.default_rng(11)
    words = "door doors lock Washing the of running ran dooré F5E2 x 12".split()
    texts = [(i, None if i % 7 == 0 else " ".join(rng.choice(words, rng.integers(0, 12))) + f" word{i}") for i in range(60)] + [(100, ""), (101, "the of"), (None, "door lock door")]
    want = sorted((i or -1, t, p) for i, x in texts if x is not None for t, p in english.positions(x, english.Stems()).items())
    for most in (1, 30, 10**6):
        monkeypatch.setattr(fulltext, "WORDS", most)
        monkeypatch.setattr(fulltext, "LEARNED", most)
        got = fulltext.postings(spark.createDataFrame(texts, "k long, text string").repartition(2), "k")
        assert got.columns == ["k", "lexeme", "positions"]
        assert sorted((r["k"] or -1, r["lexeme"], r["positions"]) for r in got.collect()) == want
