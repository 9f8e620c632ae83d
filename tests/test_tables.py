"""Matrices in tables and in running text, chunks and boxes."""

from pyspark.sql import functions as F

from corvane.operators import boxes, intake, matrix, pageaudit, structured, traces
from corvane.plans.inputs import GUIDES, HEADERS, TABLES


def test_problem_spans_the_rows_below_it():
    rows = matrix.rows_in_context(*TABLES[0])
    assert [(r["problem_title"], r["cells"][1]) for r in rows] == [("WON'T POWER UP", "Control lock is activated."), ("WON'T POWER UP", "No power to washer."), ("WON'T POWER UP", "ACU problem.")]
    assert rows[0]["problem_detail"] and matrix.layout_of(*TABLES[0]) == matrix.SPANNED


def test_group_is_no_row_of_its_own():
    rows = matrix.rows_in_context(*TABLES[1])
    assert [r["role"] for r in rows] == ["group_header", "data", "data"]
    assert {r["group_title"] for r in rows} == {"POOR WASH PERFORMANCE"} and rows[1]["group_note"] == "Please refer Use & Care Guide."


def test_code_tables_and_others_are_no_matrix():
    assert matrix.rows_in_context(*TABLES[2]) == [] and matrix.rows_in_context(*TABLES[3]) == [] and matrix.rows_in_context([], []) == []


def test_running_text_of_both_layouts():
    rows = matrix.prose_rows(GUIDES[1])
    assert [r["cells"][0] for r in rows if r["role"] == "data"] == ["Oversuds.", "Load not rinsed.", "Not cleaning clothes."]
    assert {r["group_title"] for r in rows} == {"POOR WASH PERFORMANCE"}
    starts = matrix.prose_rows(GUIDES[4])
    assert starts and all(r["problem_title"] for r in starts) and {"WON'T START CYCLE", "NO BUTTON SOUND"} >= {r["problem_title"] for r in starts}
    assert matrix.prose_rows("") == [] and matrix.prose_rows("Nothing of the kind.") == []


def page(text, tables=(), **more):
    return {"page": 1, "text": text, "language": "en", "drawn": False, "tables": [{"headers": h, "rows": r} for h, r in tables], "words": [], "page_width": None, "page_height": None, "layout_kind": None} | more


def test_chunker():
    found = list(structured.Chunker("W1").run([page(GUIDES[2], [TABLES[0]])]))
    rows = [c for c in found if c["kind"] == "table_row"]
    assert [c["problem_title"] for c in rows] == ["WON'T POWER UP"] * 3 and all(c["text"].startswith("[W1]") for c in found)
    assert len({c["chunk_id"] for c in found}) == len(found) and any("Unplug the washer" in c["text"] for c in found)
    assert list(structured.Chunker("W1").run([page(None), page("")])) == []


def words(columns, lines, gap=0):
    return [{"text": f"w{c}-{r}", "x0": 20.0 + 55 * c + (gap if c >= columns // 2 else 0), "y0": 12.0 * r, "x1": 60.0 + 55 * c + (gap if c >= columns // 2 else 0), "y1": 12.0 * r + 10} for r in range(lines) for c in range(columns)]


def test_columns_are_read_one_after_the_other():
    text, moved, at = boxes.reordered(words(10, 12), 612.0)
    assert moved and at == 306.0 and text.index("w0-11") < text.index("w6-0")
    text, moved, at = boxes.reordered(words(4, 3), 612.0)
    assert not moved and at is None and text.splitlines()[0] == "w0-0 w1-0 w2-0 w3-0"
    assert boxes.reordered([], None) == ("", False, None)


def test_boxes_only_of_what_stands_there_once():
    w = [{"text": t, "x0": 10.0 + 30 * i, "y0": 5.0, "x1": 35.0 + 30 * i, "y1": 15.0} for i, t in enumerate("remove the four screws that hold the outer panel".split())]
    held = boxes.PageWords(w, 612.0, "default")
    box = held.box("Remove the four screws that hold the outer panel")
    assert box is None or (box["x0"], box["x1"]) == (10.0, 275.0)
    exact = held.box("remove the four screws that hold the outer panel")
    assert exact["x0"] == 10.0 and exact["x1"] == 275.0
    twice = boxes.PageWords(w + [x | {"y0": 25.0, "y1": 35.0} for x in w], 612.0, "default")
    assert twice.box("remove the four screws that hold the outer panel") is None
    assert boxes.PageWords(w, 612.0, "figure").box("remove the four screws that hold the outer panel") is None


def test_page_audit(spark):
    tables = "array<struct<headers:array<string>,rows:array<array<string>>>>"
    rows = [(1, GUIDES[2], [], "multi_column", "column_reorder"), (2, "1. a\n2. b\n3. c\n4. d\n5. e\n6. f", [], "multi_column", "column_reorder"), (3, "text", [(HEADERS, [["", "", ""]])], "default", "pdfplumber"), (4, None, [], None, None)]
    p = spark.createDataFrame(rows, f"k int, text string, tables {tables}, layout_kind string, prose_source string")
    p = p.withColumns({"markers": F.lit(None).cast("array<string>"), "steps": F.lit(None).cast("array<int>")})
    assert {r.k: r.flags for r in pageaudit.audit(p, ["k"]).collect()} == {1: ["reading_order_suspect"], 2: [], 3: ["matrix_no_data_rows"], 4: []}


def test_intake(spark):
    d = spark.createDataFrame([("W10000001-rev-b.pdf", "", None), ("W10000001A.pdf", "", None), ("scan.pdf", "see W10000002", None), ("x.pdf", "nothing", None), ("both W10000001 W10000002.pdf", None, None), ("a.html", None, "Content-Location: https://h.example.org/a/b/\r\n")], "file string, sample string, content string")
    m = spark.createDataFrame([("D1", "W10000001", "A", "W10000001 Rev A", True, None, "One"), ("D2", "W10000002", None, "W10000002", True, None, "Two"), ("D3", None, None, "A3", False, "https://h.example.org/a/b", "Three")], "doc_id string, publication_number string, revision string, citation string, is_pdf boolean, source_url string, title string")
    e = spark.createDataFrame([("D2", "corrects", "W10000001")], "doc_id string, type string, target string")
    got = {r.file: (r.doc_id, r.revision_conflict) for r in intake.plan(d, m, e).collect()}
    assert got["W10000001-rev-b.pdf"] == (None, True) and got["W10000001A.pdf"] == ("D1", False) and got["scan.pdf"] == ("D2", False)
    assert got["x.pdf"] == (None, False) and got["a.html"] == ("D3", False)


def test_traces(spark):
    raw = ['{"id": "t1", "name": "ask", "timestamp": "2024-01-01", "input": {"question": "Why?"}, "output": "ABSTAIN: no"}', "not json", "[]", None]
    t = traces.normalised(spark.createDataFrame([(x,) for x in raw], "value string")).collect()
    assert [(r.trace_id, r.question) for r in t] == [("t1", "Why?")]
    now = F.to_timestamp(F.lit("2024-01-08 12:00:00"))
    got = spark.range(1).select(*[traces.since(F.lit(x), now).cast("string") for x in ("7d", "24h", "30m", "soon")]).collect()[0]
    assert list(got) == ["2024-01-01 12:00:00", "2024-01-07 12:00:00", "2024-01-08 11:30:00", None]


def test_lines_are_gathered_into_blocks():
    body = "NO BUTTON SOUND Button sound is off. See User Guide.\n• All pads\nINCORRECT WATER\nTEMPERATURE\nHoses crossed. Check the hoses.\nPOOR WASH\nPERFORMANCE Oversuds. Check detergent.\nPlease refer to Use & Care Guide. Load not rinsed. 1. Check water.\nmore of it"
    kinds = [[x.kind for x in b] for b in matrix.blocks(body)]
    assert kinds == [["problem", "text"], ["problem", "part", "symptom"], ["part"], ["tail"], ["symptom"], ["aside"], ["symptom", "text"]]
    rows = matrix.unified_rows(body)
    assert [(r["problem_title"] or r["cells"][0], r["cells"][1], r["cells"][2], r["group_title"], r["problem_detail"]) for r in rows] == [
        ("NO BUTTON SOUND", "Button sound is off.", "See User Guide.", "", "• All pads"), ("INCORRECT WATER TEMPERATURE", "Hoses crossed.", "Check the hoses.", "", ""),
        ("Oversuds.", "", "Check detergent.", "POOR WASH PERFORMANCE", ""), ("Load not rinsed.", "", "1. Check water. more of it", "POOR WASH PERFORMANCE", ""),
    ]
    assert [r["group_note"] for r in rows[2:]] == ["", "Please refer to Use & Care Guide."]


def test_a_title_takes_all_of_its_words_in_capitals():
    assert matrix.ANCHOR_ROW.match("NO BUTTON SOUND Button sound is off.").groups() == ("NO BUTTON SOUND ", "Button sound is off.")
    assert matrix.ANCHOR_ROW.match("Door is open.") is None
