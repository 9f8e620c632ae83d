"""Pages to chunks: windows, headings, sections, rows; audits and repairs of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What starts a heading, and what a heading can't be.
HEADING = r"(?i)^(TABLE OF CONTENTS|SECTION\s+\d+\b|FOR SERVICE TECHNICIAN|DIAGNOSTIC|TEST #\d|ERROR CODE|IMPORTANT|WARNING|ABBREVIATIONS|TECHNICAL SERVICE POINTER|FAULT/?\s*ERROR CODES?|MANUALLY UNLOCKING|MEASURED VALUES|COMPONENT (?:LOCATION|TESTING)|WIRE HARNESS|SENSOR|THERMISTOR|RESISTANCE)"
BANNER = r"(?i)^(TABLE OF CONTENTS|SECTION\s+\d+|TEST #\d|DIAGNOSTICS\b|DIAGNOSTIC MODE|ACTIVATING SERVICE DIAGNOSTIC|COMPONENT (?:LOCATION|TESTING)|FAULT)"
CONTENTS_ROW = r"\.{4,}\s*\d+(?:-\d+)?\s*$"
NOT_HEADING = r"(?i)^FOR SERVICE TECHNICIAN|^(WARNING|DANGER|IMPORTANT):?$|^diagnostic voltage\b"
NOTE = r"(?i)\b(will|should|must|may|turn off|disconnect|prior to|otherwise|the appliance|continue to step)\b"
RUNNING = r"(?i)^(TABLE OF CONTENTS|DIAGNOSTICS\s*&\s*TROUBLESHOOTING|COMPONENT TESTING|COMPONENT ACCESS|CONNECTIVITY|GENERAL INFORMATION|SECTION\s+\d+)\b"


def is_heading(line: Column) -> Column:
    """Whether a line is the heading of a section, rather than a row of contents or a sentence."""
    x = F.trim(F.coalesce(line, F.lit("")))
    no = (x == "") | x.rlike(CONTENTS_ROW) | x.rlike(NOT_HEADING) | ~x.rlike(HEADING)
    long = F.contains(x, F.lit(".")) & (F.length(x) > 40)
    return F.when(no, False).when(x.rlike(BANNER), True).when(x.rlike(NOTE) | long, False).otherwise(F.length(x) <= 90)


def page_banner(text: Column) -> Column:
    """The running header among a page's first eight lines, or null."""
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 8), lambda x: F.trim(x))
    return F.nullif(F.regexp_extract(F.get(F.filter(lines, lambda x: x.rlike(RUNNING)), F.lit(0)), RUNNING, 0), F.lit(""))


def fixed_windows(pages: DataFrame, key: str, text: str = "text", size: int = 200) -> DataFrame:
    """key, pos (from 0) and window: consecutive pieces of `size` characters, blank ones left out."""
    n = F.greatest(F.char_length(F.coalesce(F.col(text), F.lit(""))), F.lit(1))
    each = pages.select(key, F.col(text).alias("t_"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("pos"))
    return each.select(key, "pos", F.substring("t_", F.col("pos") + 1, F.lit(size)).alias("window")).where(F.col("window").rlike(r"\S"))


def split_prose(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, piece (from 1) and text: a page cut before each heading line. A page's lines are held together, as its text is."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    starts = F.sum(is_heading(F.col("line")).cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    first = F.max(F.when(F.col("pos") == 0, is_heading(F.col("line")).cast("int"))).over(Window.partitionBy(key))
    pieces = lines.withColumn("piece", starts).withColumn("first", first).groupBy(key, (F.col("piece") - F.col("first")).alias("piece"))
    out = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    out = out.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    return out.withColumn("piece", F.row_number().over(Window.partitionBy(key).orderBy("piece")))


def carry_section(lines: DataFrame, key: str, order: list[str], line: str = "line") -> DataFrame:
    """Lines with the last heading at or before them."""
    head = F.when(is_heading(F.col(line)), F.trim(F.col(line)))
    return lines.withColumn("section", F.last(head, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def contextual_text(label: Column, section: Column, headers: Column, cells: Column) -> Column:
    """[label] Section: ... and the cells by their headers, of a row."""
    pairs = F.filter(F.zip_with(headers, cells, lambda h, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat_ws(": ", F.nullif(F.trim(h), F.lit("")), F.trim(c)))), lambda x: x.isNotNull())
    return F.concat_ws(" ", F.concat(F.lit("["), label, F.lit("]")), F.concat(F.lit("Section: "), section, F.lit(".")), F.array_join(pairs, " | "))


def strip_table_cells(lines: Column, cells: Column) -> Column:
    """Lines that are neither a cell nor a row of cells joined by bars."""
    parts = lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda x: F.trim(x)), lambda p: p != "")
    row = lambda x: F.contains(x, F.lit(" | ")) & F.forall(parts(x), lambda p: F.array_contains(cells, p))
    return F.filter(lines, lambda x: ~((F.trim(x) != "") & (F.array_contains(cells, F.trim(x)) | row(F.trim(x)))))


def prefer_tables(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks without short prose whose codes all stand in table rows of the document."""
    rows = F.flatten(F.collect_set(F.when(F.col("kind") == "table_row", F.col("error_codes")).otherwise(F.array().cast("array<string>"))).over(Window.partitionBy(key)))
    c = chunks.withColumn("rows_", rows)
    covered = (F.col("kind") != "table_row") & (F.size("error_codes") > 0) & (F.size(F.array_except("error_codes", "rows_")) == 0) & (F.char_length("text") < 120)
    return c.where(~covered).drop("rows_")


def audit(chunks: DataFrame) -> DataFrame:
    """Findings: chunk_id, code, severity, repairable.

    chunks: doc_id, chunk_id, kind, text, body, headers (array), error_codes, label, section, proposal.
    """
    col = F.col
    text, body = F.coalesce("text", F.lit("")), F.coalesce("body", F.lit(""))
    row = col("kind") == "table_row"
    filled = F.filter("headers", lambda h: F.trim(h) != "")
    garbage = (F.size("headers") == 0) | F.forall("headers", lambda h: F.trim(h).rlike(r"(?i)^(|col(umn)?\s*[0-9]*|[0-9]+|-+)$"))
    unlabelled = (F.size(filled) > 0) & F.exists(filled, lambda h: ~F.contains(text, h))
    rows = F.flatten(F.collect_set(F.when(row, col("error_codes")).otherwise(F.array().cast("array<string>"))).over(Window.partitionBy("doc_id")))
    cells = F.filter(F.transform(F.split(body, r"\|"), lambda x: F.trim(x)), lambda p: p != "")
    has = F.size("error_codes") > 0
    rules = [
        ("empty_or_garbage_headers", row & garbage, "warning", False), ("headers_in_meta_not_text", row & ~garbage & unlabelled, "warning", True),
        ("opaque_numeric_row", row & is_opaque(text), "warning", ~garbage), ("error_code_unbound", row & has & ((F.size(cells) < 2) | F.array_contains("error_codes", F.trim(body))), "critical", False),
        ("missing_section_path", col("kind").isin("prose", "procedure", "table_row") & col("section").isNull() & col("proposal").isNotNull(), "warning", True),
        ("missing_doc_context", (col("kind") != "article") & col("label").isNotNull() & ~F.contains(text, col("label")), "info", True),
        ("duplicate_table_as_prose", ~row & has & (F.size(F.array_except("error_codes", "rows_")) == 0) & (F.char_length(body) < 120), "warning", True),
        ("oversized_prose", col("kind").isin("prose", "procedure") & (F.char_length(body) > 4000), "info", False),
    ]
    found = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("code"), F.lit(s).alias("severity"), (r if isinstance(r, Column) else F.lit(r)).alias("repairable"))) for n, c, s, r in rules]
    return chunks.withColumn("rows_", rows).select("doc_id", "chunk_id", F.inline(F.array_compact(F.array(*found))))


def repair(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """Chunks after one repair: duplicates of table rows dropped, other repairable ones' text rebuilt with label, section and headers."""
    fix = findings.where("repairable").groupBy("chunk_id").agg(F.bool_or(F.col("code") == "duplicate_table_as_prose").alias("gone"), F.bool_or(F.col("code") != "duplicate_table_as_prose").alias("rebuild"))
    c = chunks.join(fix, "chunk_id", "left").where("not coalesce(gone, false)")
    section = F.coalesce("section", "proposal")
    made = F.concat_ws(" ", F.concat(F.lit("["), F.col("label"), F.lit("]")), F.concat(F.lit("Section: "), section, F.lit(".")), F.array_join("headers", " | "), F.col("body"))
    return c.withColumn("text", F.when(F.col("rebuild"), made).otherwise(F.col("text"))).withColumn("section", F.when(F.col("rebuild"), section).otherwise(F.col("section"))).drop("gone", "rebuild")


def audit_and_improve(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks after one repair at most, findings left, and per document why it stopped)."""
    before = audit(chunks)
    after = repair(chunks, before)
    left = audit(after)
    tried = before.where("repairable").select("doc_id", "chunk_id", "code")
    still = left.where("repairable").select("doc_id", "chunk_id", "code").join(tried, ["doc_id", "chunk_id", "code"], "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("still"))
    counts = before.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("repairable").alias("r"))
    docs = chunks.select("doc_id").distinct().join(counts, "doc_id", "left").join(still, "doc_id", "left")
    reason = F.when(F.col("n").isNull(), "clean").when(F.col("r") == 0, "no_repairable").when(F.col("still") > 0, "repair_ineffective").otherwise("after_one_repair")
    return after, left, docs.select("doc_id", reason.alias("stop_reason"))


def row_line(cells: Column) -> Column:
    """A row's cells that aren't blank, joined by bars."""
    return F.array_join(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), " | ")


def is_opaque(body: Column) -> Column:
    """Whether a row has numbers and next to no letters."""
    return body.rlike("[0-9]") & (F.length(F.regexp_replace(body, "[^A-Za-z]", "")) < 8)
