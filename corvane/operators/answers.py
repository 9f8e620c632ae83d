"""Model output: what it says, what it claims, and which evidence it rests on.

Output may be a JSON object (fenced or not), an abstention in words, or prose with citations like [2]. Reading it takes
nested JSON with loose types, so rows go through Python; what is a plain pattern is a column expression.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from .rows import map_rows

# Patterns of output, and the delimiters of evidence.
FENCE = re.compile(r"(?i)^```(?:json)?\s*|\s*```$")
SENTENCE = r"(?<=[.!?])\s+|\n+"
CITED = r"\[(\d+)\]"
ABSTAIN = "ABSTAIN:"
EVIDENCE_BEGIN, EVIDENCE_END = "<<<MANUFACTURER_EVIDENCE>>>", "<<<END_MANUFACTURER_EVIDENCE>>>"
FIGURE_NOTE = (
    "Note: this assistant cannot read figures or wiring diagrams. "
    "If a cited procedure refers to a figure, consult that graphic in the source document."
)
# Lengths of a label's parts, and the shortest theme that tells something.
GROUP_CHARS, TITLE_CHARS, THEME_CHARS, EXCERPT_CHARS = 48, 64, 6, 280

_SENTENCE, _CITED = re.compile(SENTENCE), re.compile(CITED)
CLAIMS = "array<struct<text:string,evidence_index:int>>"
OUTPUT = f"abstained boolean, abstain_reason string, answer string, claims {CLAIMS}, diagnostic string"
CITATIONS = "array<struct<index:int,doc_id:string,label:string>>"


def positive(value) -> int | None:
    """A whole number above zero, also as a whole float or digits in text; never a truth value."""
    if isinstance(value, str) and value.strip().isdigit():
        value = int(value.strip())
    if isinstance(value, bool) or not isinstance(value, int | float) or value != value or value in (float("inf"), float("-inf")) or value != int(value):
        return None
    return int(value) if value > 0 else None


def prose_claims(answer) -> list[dict]:
    """A claim for each sentence or line, with the first citation in it."""
    text = (answer or "").strip()
    parts = [p.strip() for p in _SENTENCE.split(text) if p.strip()]
    cited = [_CITED.search(p) for p in parts]
    return [{"text": p, "evidence_index": int(m[1]) if m else None} for p, m in zip(parts, cited)]


def json_object(raw: str) -> dict | None:
    bare = FENCE.sub("", raw.strip()).strip()
    try:
        found = json.loads(bare) if bare.startswith("{") else None
    except (json.JSONDecodeError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def loose_claims(rows) -> list[dict]:
    """Claims from a list of loose mappings; those without text are left out."""
    kept = [r for r in rows or [] if isinstance(r, dict) and str(r.get("text") or "").strip()]
    return [{"text": str(r["text"]).strip(), "evidence_index": positive(r.get("evidence_index"))} for r in kept]


def read_output(raw) -> dict:
    """The fields of OUTPUT (diagnostic as a mapping or None)."""
    text, out = (raw or "").strip(), {"abstained": False, "abstain_reason": "", "answer": "", "claims": [], "diagnostic": None}
    if not text:
        return out | {"abstained": True, "abstain_reason": "empty model output"}
    data = json_object(text)
    if data is None:
        if text.upper().startswith(ABSTAIN):
            return out | {"abstained": True, "abstain_reason": text[len(ABSTAIN) :].strip(), "answer": text}
        return out | {"answer": text, "claims": prose_claims(text)}
    answer, abstained = str(data.get("answer") or ""), bool(data.get("abstained"))
    claims = loose_claims(data.get("claims") if isinstance(data.get("claims"), list) else [])
    if not claims and answer and not abstained:
        claims = prose_claims(answer)
    report = data.get("diagnostic")
    return {
        "abstained": abstained, "abstain_reason": str(data.get("abstain_reason") or "").strip(), "answer": answer, "claims": claims,
        "diagnostic": report if isinstance(report, dict) else None,
    }


def shown(parsed: dict) -> str:
    """What a reader is shown: the abstention, the answer, or else the claims with their citations."""
    answer = parsed["answer"] or ""
    if parsed["abstained"]:
        return answer if answer.upper().startswith(ABSTAIN) else f"{ABSTAIN} {parsed['abstain_reason'] or answer or 'insufficient evidence'}"
    if answer.strip():
        return answer
    return "\n".join(c["text"] + (f" [{c['evidence_index']}]" if c["evidence_index"] else "") for c in parsed["claims"])


def _first(indexes, available: list[dict]) -> list[dict]:
    by = {c["index"]: c for c in available}
    return [by[i] for i in dict.fromkeys(indexes) if i in by]


def themes(label: str) -> list[str]:
    """What a label says after its dash, part by part and as a whole."""
    _, dash, theme = (label or "").partition("—" if "—" in (label or "") else " - ")
    theme = theme.strip().rstrip(".") if dash else ""
    parts = [p for p in (x.strip() for x in theme.split("/")) if len(p) >= THEME_CHARS]
    return parts + ([theme] if len(theme) >= THEME_CHARS and theme not in parts else [])


def resolved(answer: str, available: list[dict]) -> list[dict]:
    """The citations that an answer names by number; if there are none, those whose label's theme it mentions."""
    found = _first((int(n) for n in _CITED.findall(answer or "")), available)
    low = (answer or "").lower()
    if found or not low.strip() or low.lstrip().upper().startswith(ABSTAIN):
        return found
    return [c for c in available if any(t.lower() in low for t in themes(c.get("label") or ""))]


def bound(raw, available: list[dict]) -> dict:
    """What is shown of an output, and the citations of its claims, or else of its text."""
    parsed = read_output(raw)
    text = shown(parsed)
    if parsed["abstained"]:
        return {"display": text, "abstained": True, "abstain_reason": parsed["abstain_reason"] or text.split(":", 1)[-1].strip(), "claims": parsed["claims"], "citations": []}
    cited = _first((c["evidence_index"] for c in parsed["claims"] if c["evidence_index"]), available)
    cited = cited or _first((int(n) for n in _CITED.findall(text)), available)
    return {"display": text, "abstained": False, "abstain_reason": "", "claims": parsed["claims"], "citations": cited}


def _keys(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def parse_outputs(df: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """keys and OUTPUT's fields (diagnostic as JSON) for a column of model output."""

    def read(row: dict) -> list[dict]:
        out = read_output(row[raw])
        return [out | {"diagnostic": None if out["diagnostic"] is None else json.dumps(out["diagnostic"])} | {k: row[k] for k in keys}]

    return map_rows(df.select(*keys, raw), read, f"{_keys(df, keys)}, {OUTPUT}")


def bind_outputs(df: DataFrame, keys: list[str], raw: str = "raw", available: str = "available") -> DataFrame:
    """keys, display, abstained, abstain_reason, claims, citations; available: array of structs with index, doc_id, label."""
    schema = f"{_keys(df, keys)}, display string, abstained boolean, abstain_reason string, claims {CLAIMS}, citations {CITATIONS}"
    return map_rows(df.select(*keys, raw, available), lambda r: [bound(r[raw], r[available] or []) | {k: r[k] for k in keys}], schema)


def resolve_outputs(df: DataFrame, keys: list[str], answer: str = "answer", available: str = "available") -> DataFrame:
    """keys and citations, by number or by theme."""
    return map_rows(df.select(*keys, answer, available), lambda r: [{"citations": resolved(r[answer], r[available] or [])} | {k: r[k] for k in keys}], f"{_keys(df, keys)}, citations {CITATIONS}")


def claims_of(answer: Column) -> Column:
    """`prose_claims` as a column: array of structs text, evidence_index (null without a citation)."""
    parts = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), SENTENCE), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    cited = lambda p: F.nullif(F.regexp_extract(p, CITED, 1), F.lit("")).cast("int")
    return F.transform(parts, lambda p: F.struct(p.alias("text"), cited(p).alias("evidence_index")))


def fenced(text: Column) -> Column:
    """Evidence between its delimiters, put there once; without any, `(none)`."""
    x = F.coalesce(text, F.lit(""))
    body = F.when(x == "", "(none)").otherwise(F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(F.contains(x, F.lit(EVIDENCE_BEGIN)), x).otherwise(F.concat(F.lit(EVIDENCE_BEGIN + "\n"), body, F.lit("\n" + EVIDENCE_END)))


def ingestion_tag(strategy: Column, unit: Column) -> Column:
    """semantic for units and their strategy, structured where none is named, else the strategy."""
    s = F.trim(F.coalesce(strategy, F.lit("")))
    return F.when(unit | (s == "semantic_llm"), "semantic").when(s.isin("", "structured"), "structured").otherwise(s)


def label_detail(text: Column) -> Column:
    """What tells rows of a page apart: table group and problem, else the fault code of the row; empty where there is none."""
    t = F.coalesce(text, F.lit(""))
    group = F.substring(F.trim(F.regexp_extract(t, r"(?i)Table group:\s*([^\n|]+)", 1)), 1, GROUP_CHARS)
    problem = F.regexp_extract(t, r"(?i)(?:^|\n|\|)\s*Problem:\s*([^\n|]+)", 1)
    problem = F.substring(F.regexp_replace(F.trim(problem), r"(?s)\s*\(.*$", ""), 1, GROUP_CHARS)
    said = F.when((problem != "") & ~((group != "") & F.contains(F.upper(group), F.upper(problem))), problem).otherwise("")
    parts = F.concat_ws(" / ", F.nullif(group, F.lit("")), F.nullif(said, F.lit("")))
    code = F.upper(F.regexp_extract(t, r"(?i)Error Code:\s*([A-Z0-9]+)", 1))
    found = codes.error_codes(t)
    return F.when(parts != "", parts).when(code != "", code).when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("")


def unit_pages(page_label: Column, start: Column, end: Column) -> Column:
    """A unit's pages: its own label, one page, or a range; empty without any."""
    pages = F.when(start.isNull(), "").when(end.isNull() | (end == start), F.concat(F.lit("p."), start)).otherwise(F.concat(F.lit("pp."), start, F.lit("-"), end))
    return F.when(F.coalesce(page_label, F.lit("")) != "", page_label).otherwise(pages)


def format_label(publication: Column, doc_id: Column, revision: Column, page: Column, strategy: Column, text: Column, unit: Column, pages: Column, title: Column) -> Column:
    """A hit's citation label: document, revision, page or a unit's pages, how it came in, and a unit's title or the row's detail."""
    full = lambda c: F.nullif(c, F.lit(""))
    where = F.when(unit & (F.coalesce(pages, F.lit("")) != ""), pages).when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("p."), page))
    head = F.concat_ws(" ", F.coalesce(full(publication), doc_id), F.concat(F.lit("Rev "), full(revision)), where, F.concat(F.lit("["), ingestion_tag(strategy, unit), F.lit("]")))
    named = F.substring(F.trim(F.coalesce(title, F.lit(""))), 1, TITLE_CHARS)
    more = F.when(unit & (named != ""), named).otherwise(F.when(unit, F.lit("")).otherwise(label_detail(text)))
    more = F.when(unit & (named == ""), label_detail(text)).otherwise(more)
    return F.when(more != "", F.concat(head, F.lit(" — "), more)).otherwise(head)


def prompt_body(index: Column, label: Column, text: Column, unit: Column, attached: Column, unit_key: Column, unit_type: Column) -> Column:
    """A hit's numbered block: its text, or for a unit that is attached as pages a stub that says so."""
    head = F.concat(F.lit("["), index, F.lit("] "), label, F.lit("\nmodality: "))
    mark = F.concat(F.lit("["), index, F.lit("]"))
    locator = F.concat(F.coalesce(F.nullif(F.trim(unit_key), F.lit("")), F.lit("unit")), F.lit(" ("), F.coalesce(F.nullif(F.trim(unit_type), F.lit("")), F.lit("unit")), F.lit(")"))
    stub = F.concat(
        head, F.lit("semantic_pdf\nunit: "), locator, F.lit("\nAuthority for "), mark, F.lit(": attached PDF page-range (or page images) labeled "), mark,
        F.lit(".\nDo not invent content not visible in that attachment."),
    )
    fallback = F.concat(head, F.lit("semantic_text_fallback\nNote: PDF/raster attach failed for "), mark, F.lit("; authority is the extract below.\n"), text)
    return F.when(~unit, F.concat(head, F.lit("structured_text\n"), text)).when(attached, stub).otherwise(fallback)


def safe_doc_id(doc_id: Column) -> Column:
    """A document id that may stand in an address, else null."""
    x = F.trim(doc_id)
    return F.when(x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~F.contains(x, F.lit("..")), x)


def page_url(doc_id: Column, page: Column) -> Column:
    """The address of a page's image; null for unsafe ids and pages before the first."""
    return F.when(page >= 1, F.concat(F.lit("/v1/documents/"), safe_doc_id(doc_id), F.lit("/pages/"), page, F.lit("/image")))


def layout_box(box: Column, width: Column, height: Column) -> Column:
    """A box of a page, where it and the page are complete and have an area; else null."""
    edges = {k: box[k].cast("double") for k in ("x0", "y0", "x1", "y1")}
    sane = (edges["x1"] > edges["x0"]) & (edges["y1"] > edges["y0"]) & (width > 0) & (height > 0)
    return F.when(F.coalesce(sane, F.lit(False)), F.struct(*[c.alias(k) for k, c in edges.items()]))
