"""Functions over columns, by tables of cases."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import codes, intent, layout, parsing, serials, texts


def values(spark, column, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


@pytest.mark.parametrize(
    ("text", "found"),
    [("F5E2", ["F5E2"]), ("f5 e2 and F 3 E1", ["F3E1", "F5E2"]), ("XF5E2", []), ("F5E22", []), (None, []), ("F5E2 F5 E2", ["F5E2"])],
)
def test_error_codes(spark, text, found):
    assert values(spark, codes.error_codes(F.col("t")), [(text,)], "t string") == [found]


@pytest.mark.parametrize(
    ("key", "needle", "match"),
    [
        ("W11169652", "W11169652", True), ("W11169652 Rev B", "W11169652", True), ("W11169652", "W11169652 Rev B", False), ("W11169652 Rev B", "W11169652B", True), ("W11169652 Rev A", "W11169652B", False),
        ("doc-one", "doc", True), ("doc", "doc-one", False), ("service-manual-w11169652-revb", "W11169652", True), ("W11169653", "W11169652", False),
    ],
)
def test_matches_citation(spark, key, needle, match):
    assert values(spark, codes.matches_citation(F.col("k"), F.col("n")), [(key, needle)], "k string, n string") == [match]


@pytest.mark.parametrize(
    ("serial", "parts"),
    [
        ("CF81500000", ("CF", "8", 15, "00000")), ("CX10xxxx", ("C", "X", 10, "XXXX")), ("CX090000", ("C", "X", 9, "0000")), ("CC01xxxxx", ("C", "C", 1, "XXXXX")), ("12345", None), ("CX990000", None), (" cf 81500000 ", ("CF", "8", 15, "00000")),
        ("CX10", None), ("CX101234567", ("CX", "1", 1, "234567")), (None, None),
    ],
)
def test_serial_parts(spark, serial, parts):
    assert [tuple(x) if x else None for x in values(spark, serials.serial_parts(F.col("s")), [(serial,)], "s string")] == [parts]


@pytest.mark.parametrize(("code", "reference", "year"), [("X", 1990, 1990), ("X", 1991, 2020), ("C", 2018, 2023), ("9", 2045, 2049), ("X", 2040, 2020)])
def test_resolve_year(spark, code, reference, year):
    assert values(spark, serials.resolve_year(F.col("c"), F.col("r")), [(code, reference)], "c string, r int") == [year]


@pytest.mark.parametrize(("serial", "inside"), [("CX101234", True), ("CX270000", True), ("CX28", False), ("CX090000", False), ("DX150000", False), ("CX27999999", False)])
def test_serial_in_range(spark, serial, inside):
    low, high = serials.serial_parts(F.lit("CX10xxxx")), serials.serial_parts(F.lit("CX27xxxx"))
    assert values(spark, serials.serial_in_range(serials.serial_parts(F.col("s")), low, high, F.lit(2018)), [(serial,)], "s string") == [inside]


@pytest.mark.parametrize(
    ("pattern", "model", "match"),
    [("WFW5620HW*", "WFW5620HW0", True), ("WFW5620HW*", "WFW5622HW0", False), ("WFW5620HW0", "WFW5620HW3", False), (" wfw* ", "WFW1", True), ("W-1", "W-1", None), ("*", "A", None), ("WFW", "", None)],
)
def test_model_matches(spark, pattern, model, match):
    assert values(spark, serials.model_matches(F.col("p"), F.col("m")), [(pattern, model)], "p string, m string") == [match]


@pytest.mark.parametrize(
    ("text", "polarity"),
    [("door won't unlock", "unlock"), ("door doesnt open", "unlock"), ("it wont lock", "lock"), ("failed to latch", "lock"), ("won't lock and won't open", None), ("is not locked", None), ("", None), (None, None)],
)
def test_door_polarity(spark, text, polarity):
    assert values(spark, intent.door_polarity(F.col("t")), [(text,)], "t string") == [polarity]


@pytest.mark.parametrize(
    ("claim", "evidence", "ok"),
    [("", "x", True), ("valve leaks", "", False), ("the valve leaks water", "Here the valve leaks water now", True), ("pump motor", "pump motor runs", True), ("pump motor belt", "pump motor", False), ("pump motor belt hose seal", "pump motor belt", True), ("pump motor belt hose seal", "pump motor", False)],
)
def test_claim_supported(spark, claim, evidence, ok):
    assert values(spark, texts.claim_supported(F.col("c"), F.col("e")), [(claim, evidence)], "c string, e string") == [ok]


@pytest.mark.parametrize(
    ("text", "verdict"),
    [('{"verdict": "pass"}', "pass"), ('x ```json\n{"verdict": "FAIL"}\n``` y', "fail"), ('{"abstained": true}', "abstain"), ("no", "invalid"), ('{"passed": false}', "fail"), ('a {"passed": true} b', "pass"), ('{"verdict": "hm"}', "invalid")],
)
def test_verdict(spark, text, verdict):
    assert values(spark, parsing.verdict(F.col("t")), [(text,)], "t string") == [verdict]


def test_private_use_characters(spark):
    rows = [("\uf0d8 a\uf06eb\x00 JJ366--11",)]
    assert values(spark, layout.map_private(F.col("t")), rows, "t string") == ["• a•b J36-1"]


def test_missing_steps(spark):
    rows = [("1. a\n2. b\n3. c\n5. d\n6. e",), ("1. a\n2. b",), ("9. a\n10. b\n11. c\n12. d\n13. e",)]
    assert values(spark, layout.missing_steps(F.col("t")), rows, "t string") == [[4], None, None]
