"""Words on a page: columns and reading order, and the boxes of text found among them.

A page's words are an array of structs (text, x0, y0, x1, y1), y from the top. A box is given only where the text is
unique on the page, so that no wrong place is ever shown.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import layout
from .rows import map_rows, reach_workers

# What makes a page one of two columns, in points and words.
LEAST_WORDS, LEAST_SIDE, MIDDLE, GUTTER, LINE = 40, 30, 20.0, 5.0, 3.0
RULE_LENGTH, RULE_SLANT, PAGE_WIDTH = 80.0, 2.0, 612.0
# The shortest text that is looked for, the widest gap within a column, and pages that are left out.
LEAST_TOKENS, LEAST_CHARS, GAP = 8, 40, 0.25
CELL_TOKENS, CELL_CHARS = 2, 8
SKIPPED = ("figure", "schematic", "toc")
SPACE = "pdfplumber_pt"
PLACE = ("x0", "y0", "x1", "y1")

WORD = "struct<text:string,x0:double,y0:double,x1:double,y1:double>"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def clean_words(words: Column) -> Column:
    """Words with private-use marks mapped, trimmed; blank ones and those without an area are left out."""
    fields = ("x0", "y0", "x1", "y1")
    made = F.transform(words, lambda w: F.struct(F.trim(layout.map_private(F.coalesce(w["text"], F.lit("")))).alias("text"), *[w[f].cast("double").alias(f) for f in fields]))
    return F.filter(made, lambda w: (w["text"] != "") & F.coalesce((w["x1"] > w["x0"]) & (w["y1"] > w["y0"]), F.lit(False)))


def partition_x(words: list[dict], width: float | None, rules: list[dict] | None = None) -> float | None:
    """Where a page's columns part: a vertical rule near its middle, or the middle itself where both halves are full; None for one column."""
    width = width or PAGE_WIDTH
    if len(words) < LEAST_WORDS:
        return None
    upright = (r for r in rules or [] if abs(r["x0"] - r["x1"]) < RULE_SLANT and r["bottom"] - r["top"] > RULE_LENGTH)
    found = next((r["x0"] for r in upright if width * 0.25 < r["x0"] < width * 0.75), None)
    if found is not None:
        return float(found)
    left, right = sum(w["x0"] < width / 2 - MIDDLE for w in words), sum(w["x0"] > width / 2 + MIDDLE for w in words)
    return width / 2 if min(left, right) >= LEAST_SIDE else None


def parting(words: Column, width: Column, rules: Column | None = None) -> Column:
    """`partition_x` of columns."""
    width = F.coalesce(F.nullif(width, F.lit(0.0)), F.lit(PAGE_WIDTH))
    x = lambda w: F.nanvl(w["x0"], F.lit(None).cast("double"))
    side = lambda test: F.size(F.filter(words, lambda w: F.coalesce(test(x(w)), F.lit(False))))
    left, right = side(lambda x: x < width / 2 - MIDDLE), side(lambda x: x > width / 2 + MIDDLE)
    at = F.when(F.least(left, right) >= LEAST_SIDE, width / 2)
    if rules is not None:
        upright = lambda r: (F.abs(r["x0"] - r["x1"]) < RULE_SLANT) & (r["bottom"] - r["top"] > RULE_LENGTH) & (width * 0.25 < r["x0"]) & (r["x0"] < width * 0.75)
        at = F.coalesce(F.get(F.filter(rules, upright), F.lit(0))["x0"].cast("double"), at)
    return F.when(F.size(words) >= LEAST_WORDS, at)


def lines_of(texts: list[str], x: np.ndarray, y: np.ndarray, joiner: str = " ") -> list[str]:
    """Words (or characters) as lines from the top, each from the left. A line's height is that of its first word."""
    heights, which = np.unique(y, return_inverse=True)
    order = np.lexsort((x, np.array([round(h, 1) for h in heights.tolist()])[which]))
    y, starts, i = y[order], [], 0
    top = np.maximum.accumulate(y)
    while i < len(y):
        starts.append(i)
        end = max(int(np.searchsorted(top, y[i] + LINE, side="right")), i + 1)
        while end > i + 1 and abs(y[end - 1] - y[i]) > LINE:
            end -= 1
        while end < len(y) and abs(y[end] - y[i]) <= LINE:
            end += 1
        i = end
    line = np.zeros(len(y), dtype=np.int64)
    line[starts[1:]] = 1
    order = order[np.lexsort((x[order], np.cumsum(line)))].tolist()
    return [joiner.join([texts[i] for i in order[a:b]]) for a, b in zip(starts, [*starts[1:], len(y)])]


def _in_columns(texts: list[str], x: np.ndarray, y: np.ndarray, at: float | None) -> str:
    if at is None:
        return "\n".join(lines_of(texts, x, y))
    left = x < at - GUTTER
    left, right = (lines_of([texts[i] for i in np.flatnonzero(side)], x[side], y[side]) for side in (left, ~left))
    return "\n".join(left + ([""] if left and right else []) + right)


def reordered(words: list[dict], width: float | None, rules: list[dict] | None = None) -> tuple[str, bool, float | None]:
    """(text, whether it was reordered, where columns part): the left column, a blank line, the right one; else the lines across."""
    at = partition_x(words, width, rules)
    x, y = (np.array([w[c] for w in words], dtype=np.float64) for c in ("x0", "y0"))
    return _in_columns([w["text"] for w in words], x, y, at), at is not None, at


def _types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def columns_of(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys and partition_x of pages(keys, words, page_width, and optionally rules with x0, x1, top, bottom)."""
    return pages.select(*keys, parting(F.col("words"), F.col("page_width"), F.col("rules") if "rules" in pages.columns else None).alias("partition_x"))


def reading_order(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, reordered and partition_x of pages as `columns_of` takes them. A page's words stay columns of texts and places."""
    at = parting(F.col("words"), F.col("page_width"), F.col("rules") if "rules" in pages.columns else None)
    field = lambda name, kind: F.coalesce(F.transform("words", lambda w: w[name].cast(kind)), F.array().cast(f"array<{kind}>"))
    rows = pages.select(*keys, field("text", "string").alias("texts_"), field("x0", "double").alias("x_"), field("y0", "double").alias("y_"), at.alias("at_"))
    reach_workers(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts, x, y = (batch.column(c).flatten() for c in ("texts_", "x_", "y_"))
            x, y = (v.to_numpy(zero_copy_only=False) for v in (x, y))
            ends, out = np.cumsum(pc.list_value_length(batch.column("x_")).to_numpy()).tolist(), []
            for low, high, at in zip([0, *ends[:-1]], ends, batch.column("at_").to_pylist()):
                out.append(_in_columns(texts.slice(low, high - low).to_pylist(), x[low:high], y[low:high], at))
            held = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*held, pa.array(out, pa.string()), batch.column("at_").is_valid(), batch.column("at_")], names=[*keys, "text", "reordered", "partition_x"])

    return rows.mapInArrow(run, f"{_types(pages, keys)}, text string, reordered boolean, partition_x double")


class Words:
    """A page's words as columns; of a long page few become objects of their own."""

    def __init__(self, texts: list[str] | pa.Array, places: list[np.ndarray]):
        """places: x0, y0, x1 and y1."""
        self.texts, self.places = texts, places

    @classmethod
    def of(cls, words: list[dict]) -> Words:
        return cls([w["text"] for w in words], [np.array([w[c] for w in words], dtype=np.float64) for c in PLACE])

    def __len__(self) -> int:
        return len(self.texts)


def words_of(column: pa.Array) -> list[Words]:
    """The words of each row of an array of lists of words; none for null."""
    flat, ends = column.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()).tolist()
    texts, places = flat.field("text"), [flat.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in PLACE]
    return [Words(texts.slice(low, high - low), [v[low:high] for v in places]) for low, high in zip([0, *ends], ends)]


def words_of_pages(column: pa.Array) -> list[list[Words]]:
    """The same, of an array of lists (pages) of lists of words."""
    pages, ends = words_of(column.flatten()), np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()).tolist()
    return [pages[low:high] for low, high in zip([0, *ends], ends)]


def one_column(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, width: float) -> bool:
    """Whether words from left to right leave no gap as wide as a gutter."""
    order = np.lexsort((y0, x0))
    return bool(len(order)) and not (x0[order][1:] - np.maximum.accumulate(x1[order])[:-1] > GAP * width).any()


def union(boxes: list[dict]) -> dict | None:
    if not boxes:
        return None
    return {"x0": min(b["x0"] for b in boxes), "y0": min(b["y0"] for b in boxes), "x1": max(b["x1"] for b in boxes), "y1": max(b["y1"] for b in boxes)}


class PageWords:
    """A page's words as one line, with the place of each. The line is made when a text is first looked for."""

    def __init__(self, words: list[dict] | Words, width: float | None, kind: str | None):
        self.words, self.width, self.kind = words, width or 0.0, kind or ""

    @cached_property
    def held(self) -> Words:
        return self.words if isinstance(self.words, Words) else Words.of(self.words)

    @cached_property
    def _tokens(self) -> list[str]:
        texts = self.held.texts
        return [" ".join((t or "").split()) for t in (texts if isinstance(texts, list) else texts.to_pylist())]

    @cached_property
    def line(self) -> str:
        return " ".join(t for t in self._tokens if t)

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends in the line of the words that have any text, and their numbers."""
        size = np.array([len(t) for t in self._tokens], dtype=np.int64)
        number = np.flatnonzero(size)
        ends = np.cumsum(size[number] + 1) - 1
        return ends - size[number], ends, number

    def box(self, text: str, tokens: int = LEAST_TOKENS, chars: int = LEAST_CHARS, within_column: bool = True) -> dict | None:
        """The box of the words that spell a text, if they do so once, and in one column."""
        needle = " ".join((text or "").split())
        if self.kind in SKIPPED or self.width <= 0 or not needle or (len(needle.split()) < tokens and len(needle) < chars):
            return None
        at = self.line.find(needle)
        if at < 0 or self.line.find(needle, at + 1) >= 0:
            return None
        starts, ends, number = self.spans
        hit = number[np.searchsorted(ends, at, side="right") : np.searchsorted(starts, at + len(needle))]
        x0, y0, x1, y1 = (v[hit] for v in self.held.places)
        if not len(hit) or (within_column and not one_column(x0, y0, x1, self.width)):
            return None
        return {"x0": float(x0.min()), "y0": float(y0.min()), "x1": float(x1.max()), "y1": float(y1.max())}

    def row_box(self, cause: str, checks: str, body: str) -> dict | None:
        """The box of a row without a grid: of its cells that are unique, or else of its whole text."""
        cells = [self.box(x, CELL_TOKENS, CELL_CHARS) for x in map(str.strip, (cause or "", checks or "")) if x]
        found = [b for b in cells if b] or [b for b in [self.box((body or "").strip(), within_column=False)] if b]
        return union(found)


def span_boxes(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, body, bbox for each of a page's bodies. pages: keys, words, page_width, layout_kind, bodies (array)."""

    def read(p: dict) -> list[dict]:
        page = PageWords(p["words"] or [], p["page_width"], p.get("layout_kind"))
        return [{k: p[k] for k in keys} | {"place": i, "body": b, "bbox": page.box(b)} for i, b in enumerate(p["bodies"] or [], 1)]

    return map_rows(pages, read, f"{_types(pages, keys)}, place int, body string, bbox {BOX}", {"words": words_of})


def attach_layout(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, body and metadata (page_width, page_height, bbox, bbox_space) of pages' chunks.

    pages: keys, words, page_width, page_height, layout_kind, chunks (array of structs kind, body, cause, checks). Table
    rows are found by their cells, other chunks by their text. Without a box, prose has no metadata, rows have the page's size.
    """

    def read(p: dict) -> list[dict]:
        page, out = PageWords(p["words"] or [], p["page_width"], p.get("layout_kind")), []
        sized = bool(p["page_width"] and p["page_height"])
        for i, c in enumerate(p["chunks"] or [], 1):
            row = c["kind"] == "table_row"
            box = page.row_box(c["cause"], c["checks"], c["body"]) if row else page.box(c["body"])
            size = (p["page_width"], p["page_height"]) if sized and (row or box) else (None, None)
            out.append({k: p[k] for k in keys} | {"place": i, "body": c["body"], "page_width": size[0], "page_height": size[1], "bbox": box, "bbox_space": SPACE if box else None})
        return out

    return map_rows(pages, read, f"{_types(pages, keys)}, place int, body string, page_width double, page_height double, bbox {BOX}, bbox_space string", {"words": words_of})


def row_key(cells: Column) -> Column:
    """A row's cells, mapped and trimmed, as a key."""
    return F.transform(cells, lambda c: layout.map_private(F.trim(F.coalesce(c, F.lit("")))))


def filled_key(cells: Column) -> Column:
    """The same without blank cells."""
    return F.filter(row_key(cells), lambda c: c != "")


def sane_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with an area, else null."""
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def row_boxes(rows: DataFrame, found: DataFrame, page: list[str]) -> DataFrame:
    """rows(page's keys, cells) with `bbox`: that of the found row with the same cells, or else the same filled cells, if it is the only one on the page. found: page's keys, cells, bbox."""
    held = found.where("bbox is not null").select(*page, row_key(F.col("cells")).alias("full"), filled_key(F.col("cells")).alias("filled"), "bbox").where(F.size("filled") > 0)

    def once(key: str):
        return held.groupBy(*page, key).agg(F.count(F.lit(1)).alias("n"), F.first("bbox").alias(f"by_{key}")).where("n = 1").drop("n")

    keyed = rows.withColumn("full", row_key(F.col("cells"))).withColumn("filled", filled_key(F.col("cells")))
    keyed = keyed.join(once("full"), [*page, "full"], "left").join(once("filled"), [*page, "filled"], "left")
    return keyed.withColumn("bbox", F.coalesce("by_full", "by_filled")).drop("full", "filled", "by_full", "by_filled")


def converted(raw: Column) -> Column:
    """A raw table (array of rows) as headers and rows that aren't blank; null without two rows, or without any filled one."""
    clean = lambda r: F.transform(r, lambda c: layout.map_private(F.trim(F.coalesce(c, F.lit("")))))
    rows = F.filter(F.transform(F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0))), clean), lambda r: F.exists(r, lambda c: c != ""))
    return F.when((F.size(raw) >= 2) & (F.size(rows) > 0), F.struct(clean(F.get(raw, F.lit(0))).alias("headers"), rows.alias("rows")))
