"""The corpus that plans run on, made of a folder's tables, with the same rows in SQL.

`documents` plays manual chunks (its sources play manuals), `embeddings` their vectors, `conversations`
sessions, `events` a trace log, and lists below small dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

KINDS = ("table_row", "article", "prose", "procedure", "heading")
DOC_TYPES = ("service_manual", "knowledge_article", "tech_sheet", "owners_manual", "installation_instructions", "technical_service_pointer")

#: query_id, text, model, serial, year introduced, audience
ASKS = [
    (1, "F5E2 door won't unlock, what should I check", "WFW5620HW0", "CF81600001", 2018, "technician"),
    (2, "Which service manual covers a W10000003 revision B", "WFW5622HW1", None, 2018, "technician"),
    (3, "The new washer is shaking violently after shipping bolts", "WFW9999", "CX090000", None, "owner"),
    (4, "part number W10000004 for J33 and J3 harness", "WTW4816FW3", "CD050123", 2020, "owner"),
    (5, "ACU status LED blinks F 3 E 1 then f3e1", "WFW5620HW0", "C8991234", 2019, "owner"),
    (6, "dont know why the door doesnt open and will not lock", "WFW5620HW2", "12345", 2018, "owner"),
    (7, "it failed to latch; TEST # 4 says measure", "ABC1", "CX201234", 2021, "technician"),
    (8, "How do I clean the filter?", "WFW5620HW0", None, None, "owner"),
    (9, "F9E6 F0E0 abc123 X9 error W10000005", "WTW4816FW", "AA011234", 2001, None),
    (10, "door can't be opened, it isn't locked", "WFW5620HW0", "CF81499999", 2018, "owner"),
]
ASKS_DDL = "query_id int, ask string, model string, serial string, introduced int, audience string"


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of the same rows."""
    lines = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {lines}) AS v({columns}))"


ASKS_SQL = values_sql("asks", "query_id, ask, model, serial, introduced, audience", ASKS)


def asks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKS, ASKS_DDL)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    n = F.col("doc_id")
    kinds = F.array(*map(F.lit, KINDS))
    codes = F.when(n % 12 == 0, F.array(F.concat(F.lit("F"), n % 10, F.lit("E"), n % 7), F.lit("F5E2"))).when(n % 6 == 0, F.array(F.concat(F.lit("F"), n % 10, F.lit("E"), n % 7))).otherwise(F.array().cast("array<string>"))
    # every tenth has its code in the text alone, with spaces
    tag = F.when(n % 10 == 3, F.concat(F.lit("Error F"), n % 9, F.lit(" E"), n % 6, F.lit(" at J"), n % 50, F.lit(" motor harness. "))).when(n % 10 == 4, F.concat(F.lit("Door will not unlock, TEST #"), n % 9, F.lit(". "))).otherwise(F.lit(""))
    return d.select(
        n.alias("chunk_no"), F.concat(F.lit("D"), F.lpad(F.substring("source", 4, 9), 4, "0")).alias("doc_id"), F.concat(F.lit("c"), F.lpad(n.cast("string"), 8, "0")).alias("chunk_id"),
        F.concat(tag, "text").alias("text"), F.when(n % 7 != 0, F.col("lang")).alias("language"), (F.floor(n / 7) % 40 + 1).cast("int").alias("page"), F.element_at(kinds, (n % 5 + 1).cast("int")).alias("kind"),
        F.concat(F.lit("W1"), F.lpad(F.substring("source", 4, 9), 7, "0")).alias("publication_number"), F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").alias("revision"), codes.alias("error_codes"),
    )


CHUNKS_SQL = """chunks AS (
  SELECT doc_id AS chunk_no, 'D' || lpad(substr(source, 4), 4, '0') AS doc_id, 'c' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS chunk_id,
    CASE WHEN doc_id % 10 = 3 THEN 'Error F' || doc_id % 9 || ' E' || doc_id % 6 || ' at J' || doc_id % 50 || ' motor harness. ' WHEN doc_id % 10 = 4 THEN 'Door will not unlock, TEST #' || doc_id % 9 || '. ' ELSE '' END || text AS text,
    CASE WHEN doc_id % 7 <> 0 THEN lang END AS language, CAST(doc_id // 7 % 40 + 1 AS INTEGER) AS page,
    ['table_row', 'article', 'prose', 'procedure', 'heading'][CAST(doc_id % 5 + 1 AS INTEGER)] AS kind,
    'W1' || lpad(substr(source, 4), 7, '0') AS publication_number, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS revision,
    CASE WHEN doc_id % 12 = 0 THEN ['F' || doc_id % 10 || 'E' || doc_id % 7, 'F5E2'] WHEN doc_id % 6 = 0 THEN ['F' || doc_id % 10 || 'E' || doc_id % 7] ELSE CAST([] AS VARCHAR[]) END AS error_codes
  FROM documents)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_no, embedding as doubles."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_no"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


#: Manuals: one for each source number. doc_id, publication_number, doc_type, tier, published
MANUALS = [(f"D{i:04d}", f"W1{i:07d}", DOC_TYPES[i % 6], ("service_literature", "consumer", "technical_service_pointer")[i % 3], f"{2015 + i % 8}-{i % 12 + 1:02d}" if i % 5 else f"{2015 + i % 8}") for i in range(20)]
MANUALS_SQL = values_sql("manuals", "doc_id, publication_number, doc_type, tier, published", MANUALS)
#: Edges between manuals: doc_id, type, target publication
EDGES = [("D0001", "references", "W10000004"), ("D0007", "references", "W10000010"), ("D0002", "supersedes", "W10000003"), ("D0003", "superseded_by", "W10000002"), ("D0005", "corrects", "W10000006"), ("D0011", "overrides", "W10000012"), ("D0001", "references", "W10000016")]
EDGES_SQL = values_sql("edges", "doc_id, type, target", EDGES)
#: Model patterns of manuals: doc_id, pattern
MODELS = [(f"D{i:04d}", ("WFW5620HW*", "WFW*", "WTW4816FW*", "WFW5622HW1", "ABC1")[i % 5]) for i in range(20)] + [("D0004", "WFW5620HW0"), ("D0009", "WFW9*")]
MODELS_SQL = values_sql("models", "doc_id, pattern", MODELS)
#: Serial ranges of manuals: doc_id, scope, model, start, end
RANGES = [("D0000", "range", None, "CF81500000", "CF820xxxx"), ("D0001", "all", None, None, None), ("D0004", "range", "WFW5620HW*", "CX10xxxx", "CX27xxxx"), ("D0005", "range", None, "CF81400000", "CF81499999"), ("D0005", "range", None, "CF8160xxxx", "CF8170xxxx"), ("D0006", "range", "WTW4816FW*", "CC01xxxxx", "CC05xxxxx"), ("D0010", "range", None, "CD05xxxxx", "CD06xxxxx")]
RANGES_SQL = values_sql("ranges", "doc_id, scope, model, first, last", RANGES)


def manuals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANUALS, "doc_id string, publication_number string, doc_type string, tier string, published string")


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "doc_id string, type string, target string")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "doc_id string, pattern string")


def ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RANGES, "doc_id string, scope string, model string, first string, last string")


def sql(body: str, *parts: str) -> str:
    """`body` after common table expressions."""
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body
