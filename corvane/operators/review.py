"""Editing the spans of a candidate version: split, merge, add, remove, move, and resize that pushes neighbours.

A reviewer changes where a unit starts and stops, never what it says: its text is rebuilt from the pages it covers. A
version's units and edits are a row (arrays of structs) since each edit sees what the ones before it did. An edit that
can't be applied is reported and leaves the units as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts
from .arms import small
from .rows import map_rows, settled

# A unit's states and origins, and the longest slug.
PROPOSED, EDITED, APPROVED = "proposed", "edited", "approved"
BY_MODEL, BY_MODEL_EDITED, BY_HUMAN = "llm", "llm_edited", "human"
SLUG_CHARS = 48

UNIT_FIELDS = (
    "unit_key:string,ordinal:int,title:string,unit_type:string,page_start:int,page_end:int,start_y:double,end_y:double,section_path:array<string>,source_text:string,"
    "source_span:array<string>,content_hash:string,review_status:string,origin:string,needs_ocr:boolean,edits:array<string>"
)
UNIT = f"struct<{UNIT_FIELDS}>"
UNIT_COLUMNS = ", ".join(f.replace(":", " ") for f in UNIT_FIELDS.split(","))
EDIT = "struct<action:string,unit_key:string,other_key:string,start_page:int,end_page:int,start_y:double,end_y:double,at_page:int,at_y:double,title:string,unit_type:string,status:string>"
PAGES = "array<struct<page:int,text:string>>"


class EditError(ValueError):
    """An edit that the units don't allow."""


def slug(text: str | None, other: str = "unit") -> str:
    made = re.sub("[^a-z0-9]+", "-", (text or "").strip().lower()).strip("-")
    return made[:SLUG_CHARS].strip("-") or other


def span_tags(start: tuple[int, float], end: tuple[int, float]) -> list[str]:
    return [f"p{page}@{y:.4f}" for page, y in (start, end)]


def unit_hash(text: str, tags: list[str]) -> str:
    return hashlib.sha256("\n".join([*tags, " ".join(text.split())]).encode()).hexdigest()


@dataclass(frozen=True)
class Unit:
    unit_key: str
    ordinal: int
    title: str
    unit_type: str
    page_start: int
    page_end: int
    start_y: float = 0.0
    end_y: float = 1.0
    section_path: tuple = ()
    source_text: str = ""
    source_span: tuple = ()
    content_hash: str = ""
    review_status: str = PROPOSED
    origin: str = BY_MODEL
    needs_ocr: bool = False
    edits: tuple = field(default=())

    @staticmethod
    def read(row: dict) -> Unit:
        kept = {k: v for k, v in row.items() if k in Unit.__dataclass_fields__ and v is not None}
        return Unit(**{k: tuple(v) if isinstance(v, list) else v for k, v in kept.items()})

    @property
    def start(self) -> tuple[int, float]:
        return self.page_start, self.start_y

    @property
    def end(self) -> tuple[int, float]:
        return self.page_end, self.end_y

    def noting(self, action: str, **detail) -> Unit:
        return replace(self, edits=(*self.edits, json.dumps({"action": action} | {k: v for k, v in detail.items() if v is not None}, sort_keys=True)))


class UnitBoard:
    """A version's units under edits. `changed` and `removed` are the keys that the last edit touched."""

    def __init__(self, units: list[Unit], pages: dict[int, str]):
        self.units = {u.unit_key: u for u in units}
        self.pages = pages
        self.changed: list[str] = []
        self.removed: list[str] = []

    def apply(self, e: dict) -> None:
        self.changed, self.removed = [], []
        actions = {"split": self._split, "merge": self._merge_two, "add": self._add, "remove": self._remove, "move_boundary": self._move, "resize_push": self._resize, "set_review_status": self._status}
        if e["action"] not in actions:
            raise EditError(f"unknown edit {e['action']}")
        actions[e["action"]](e)

    def get(self, key: str | None) -> Unit:
        if key not in self.units:
            raise EditError(f"no unit {key}")
        return self.units[key]

    def _text(self, first: int, last: int) -> str:
        return "\n".join(x for x in (self.pages.get(p, "") for p in range(first, last + 1)) if x.strip())

    def over(self, u: Unit, start: tuple[int, float], end: tuple[int, float], **more) -> Unit:
        """The unit over another span, its text rebuilt."""
        if start[0] > end[0]:
            raise EditError("a unit cannot end before it starts")
        text, tags = self._text(start[0], end[0]), span_tags(start, end)
        moved = {"page_start": start[0], "start_y": start[1], "page_end": end[0], "end_y": end[1], "source_text": text, "source_span": tuple(tags), "content_hash": unit_hash(text, tags), "needs_ocr": not text.strip()}
        return replace(u, **moved, **{"review_status": EDITED, "origin": BY_MODEL_EDITED} | {k: v for k, v in more.items() if v is not None})

    def _put(self, u: Unit) -> Unit:
        self.units[u.unit_key] = u
        self.changed = [*(k for k in self.changed if k != u.unit_key), u.unit_key]
        return u

    def _drop(self, key: str) -> None:
        del self.units[key]
        self.changed = [k for k in self.changed if k != key]
        self.removed.append(key)

    def _free_key(self, base: str, joiner: str) -> str:
        key, n = base, 2
        while key in self.units:
            key, n = f"{base}{joiner}{n}", n + 1
        return key

    @staticmethod
    def _asked(u: Unit, e: dict) -> tuple[tuple[int, float], tuple[int, float]]:
        """The span that an edit asks for; what it doesn't name stays."""
        pick = lambda name, own: own if e.get(name) is None else e[name]
        return (pick("start_page", u.page_start), pick("start_y", u.start_y)), (pick("end_page", u.page_end), pick("end_y", u.end_y))

    def _move(self, e: dict) -> None:
        u = self.get(e["unit_key"])
        start, end = self._asked(u, e)
        moved = self.over(u, start, end, title=e.get("title"), unit_type=e.get("unit_type"))
        if (moved.content_hash, moved.title, moved.unit_type) != (u.content_hash, u.title, u.unit_type):
            self._put(moved.noting("move_boundary", before=[u.start, u.end], after=[start, end]))

    def _split(self, e: dict) -> None:
        u, cut = self.get(e["unit_key"]), (e["at_page"], e.get("at_y") or 0.0)
        if not u.start < cut <= u.end:
            raise EditError(f"split point p.{cut[0]}@{cut[1]} is not inside {u.unit_key}")
        head_end = (cut[0] - 1, 1.0) if cut[1] <= 0 and cut[0] > u.page_start else (cut[0], max(0.0, cut[1]))
        head = self.over(u, u.start, head_end).noting("split", at=cut, kept="head")
        title = e.get("title") or u.title
        key = self._free_key(f"{u.ordinal + 1:03d}-{slug(title)}-b", "")
        tail = self.over(u, cut, u.end, title=title, origin=BY_HUMAN).noting("split", at=cut, kept="tail")
        self._put(head)
        self._put(replace(tail, unit_key=key, ordinal=u.ordinal + 1))

    def merged(self, a: Unit, b: Unit, title: str | None = None) -> Unit:
        """Both units as one, under the key of the one that starts first."""
        left, right = sorted((a, b), key=lambda u: u.start)
        joined = self.over(left, left.start, max(left, right, key=lambda u: (u.page_end, u is right)).end, title=title, origin=BY_HUMAN)
        self._drop(right.unit_key)
        return self._put(joined.noting("merge", with_unit=right.unit_key, before_left=[left.page_start, left.page_end], before_right=[right.page_start, right.page_end]))

    def _merge_two(self, e: dict) -> None:
        self.merged(self.get(e["unit_key"]), self.get(e["other_key"]), e.get("title"))

    def _add(self, e: dict) -> None:
        place = max((u.ordinal for u in self.units.values()), default=-1) + 1
        key = self._free_key(f"{place + 1:03d}-{slug(e.get('title'), slug(e.get('unit_type')))}", "-")
        blank = Unit(key, place, e.get("title") or "", e.get("unit_type") or "other", e["start_page"], e["end_page"])
        start, end = (e["start_page"], 0.0 if e.get("start_y") is None else e["start_y"]), (e["end_page"], 1.0 if e.get("end_y") is None else e["end_y"])
        self._put(self.over(blank, start, end, origin=BY_HUMAN).noting("add", span=[start, end]))

    def _remove(self, e: dict) -> None:
        self.get(e["unit_key"])
        self._drop(e["unit_key"])

    def _status(self, e: dict) -> None:
        if e.get("status") not in (PROPOSED, EDITED, APPROVED):
            raise EditError(f"unknown review status: {e.get('status')}")
        self._put(replace(self.get(e["unit_key"]), review_status=e["status"]).noting("set_review_status", status=e["status"]))

    def _resize(self, e: dict) -> None:
        """A unit over another span; its neighbours give way, and those that it covers become part of it."""
        u = self.get(e["unit_key"])
        start, end = self._asked(u, e)
        if start >= end:
            raise EditError(f"{u.unit_key}: a unit cannot end before it starts")
        if (start, end) == (u.start, u.end):
            return self._move(e)
        moved = self._put(self.over(u, start, end, title=e.get("title"), unit_type=e.get("unit_type")).noting("resize_push", before=[u.start, u.end], after=[start, end]))
        while (after := self._beside(moved, True)) and moved.end > after.start:
            if moved.end < after.end:
                self._put(self.over(after, moved.end, after.end).noting("pushed_by", by=moved.unit_key))
                break
            moved = self.merged(moved, after)
        while (before := self._beside(moved, False)) and moved.start < before.end:
            if moved.start > before.start:
                self._put(self.over(before, before.start, moved.start).noting("pushed_by", by=moved.unit_key))
                break
            moved = self.merged(moved, before)
        return None

    def _beside(self, u: Unit, later: bool) -> Unit | None:
        """The nearest other unit that starts at or after `u`'s start, or else before it."""
        others = sorted((x for x in self.units.values() if x.unit_key != u.unit_key), key=lambda x: (*x.start, x.ordinal))
        some = [x for x in others if (x.start >= u.start) == later]
        return (some[0] if later else some[-1]) if some else None

    def in_order(self) -> list[Unit]:
        return sorted(self.units.values(), key=lambda u: (u.ordinal, *u.start, u.unit_key))


def edit_units(versions: DataFrame, key: str = "version") -> DataFrame:
    """key, units (in order), changed and removed (keys, of all edits), errors; of versions(key, units: array of UNIT, pages: PAGES, todo: array of EDIT).

    What comes out depends on units, pages and edits alone, so versions that have the same are edited once.
    """
    what = ["units", "pages", "todo"]

    def run(v: dict) -> list[dict]:
        board = UnitBoard([Unit.read(u) for u in v["units"] or []], {p["page"]: p["text"] or "" for p in v["pages"] or []})
        changed, removed, errors = [], [], []
        for e in v["todo"] or []:
            try:
                board.apply(e)
            except EditError as reason:
                errors.append(f"{e['action']}: {reason}")
                continue
            changed += [k for k in board.changed if k not in changed]
            removed += board.removed
        return [{"case_": v["case_"], "units": [vars(u) for u in board.in_order()], "changed": [k for k in changed if k in board.units], "removed": removed, "errors": errors}]

    cases = settled(versions.select(*what).distinct().withColumn("case_", F.monotonically_increasing_id()))
    edited = settled(map_rows(cases, run, f"case_ bigint, units array<{UNIT}>, changed array<string>, removed array<string>, errors array<string>"))
    held = small(cases.select("case_", *[F.col(c).alias(f"{c}_") for c in what]))
    same = F.col("units").eqNullSafe(F.col("units_")) & F.col("pages").eqNullSafe(F.col("pages_")) & F.col("todo").eqNullSafe(F.col("todo_"))
    return versions.select(key, *what).join(held, same).select(key, "case_").join(small(edited), "case_").select(key, "units", "changed", "removed", "errors")


def units_from_spans(versions: DataFrame, key: str = "version") -> DataFrame:
    """key and units made of versions(key, spans: array of structs start_page, end_page, start_y, end_y, title, unit_type; pages: PAGES): in order, under unique keys, with text and hash."""
    dtype = versions.schema[key].dataType.simpleString()

    def run(v: dict) -> list[dict]:
        board = UnitBoard([], {p["page"]: p["text"] or "" for p in v["pages"] or []})
        for place, s in enumerate(sorted(v["spans"] or [], key=lambda s: (s["start_page"], s["start_y"], s["end_page"]))):
            base = slug(s["title"], slug(s["unit_type"]))
            name = board._free_key(f"{place + 1:03d}-{base}", "-")
            blank = Unit(name, place, s["title"] or base.replace("-", " ").title(), s["unit_type"] or "other", s["start_page"], s["end_page"])
            board._put(board.over(blank, (s["start_page"], s["start_y"]), (s["end_page"], s["end_y"]), review_status=PROPOSED, origin=BY_MODEL))
        return [vars(u) | {key: v[key]} for u in board.in_order()]

    return map_rows(versions.select(key, "spans", "pages"), run, f"{key} {dtype}, {UNIT_COLUMNS}")


def marker(page: Column, y: Column) -> Column:
    """A place on a page, comparable with others."""
    return F.struct(page.cast("int").alias("page"), y.cast("double").alias("y"))


def span_empty(start: Column, end: Column) -> Column:
    return start >= end


def content_hash(text: Column, tags: Column) -> Column:
    """A unit's identity: its span's tags and its text with single spaces."""
    return F.sha2(F.array_join(F.concat(tags, F.array(texts.collapse(text))), "\n"), 256)


def tags_of(start_page: Column, start_y: Column, end_page: Column, end_y: Column) -> Column:
    one = lambda p, y: F.concat(F.lit("p"), p.cast("int"), F.lit("@"), F.format_string("%.4f", y.cast("double")))
    return F.array(one(start_page, start_y), one(end_page, end_y))


def preflight(findings: DataFrame, units: DataFrame, key: str = "version") -> DataFrame:
    """key, ready and issues: a version may be approved if its spans have no findings and every unit has text. findings: key, code; units: key, unit_key, source_text, needs_ocr."""
    blank = F.coalesce("needs_ocr", F.lit(False)) | (F.trim(F.coalesce("source_text", F.lit(""))) == "")
    ocr = units.where(blank).select(key, F.lit("needs_ocr").alias("code")).distinct()
    issues = findings.select(key, "code").unionByName(ocr).groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("issues"))
    all_ = units.select(key).unionByName(findings.select(key)).distinct()
    return all_.join(issues, key, "left").select(key, F.col("issues").isNull().alias("ready"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))
