"""What a page's text looks like: matrix, contents, schematic, figure, photo, columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of page kinds.
GUIDE = r"(?i)TROUBLESHOOTING\s+GUIDE\s*#\s*\d+"
CAUSE = r"(?i)\bPOSSIBLE\s+CAUSE\b"
PROCEDURE = r"(?i)TEST\s+PROCEDURES|TEST\s*#\s*\d+"
FIGURE_TITLE = r"(?i)\b(wiring\s+diagram|strip\s+circuit|exploded\s+view|pictorial|control\s+panel\s+artwork)\b"
FIGURE_REFERENCE = r"(?i)\b(?:fig(?:ure)?\.?\s*\d+|wiring\s+diagram|see\s+(?:the\s+)?diagram|shown\s+in\s+(?:the\s+)?(?:figure|diagram))\b"
SCHEMATIC = r"(?i)\b(wiring\s+diagram|acu\s+connectors|pinouts?|strip\s+circuit)\b"
PHOTO = r"(?i)COMPONENT ACCESS|Removing the .+\(on some models\)"
# Words that mark a language.
MARKERS = {"fr": ("débran", "laveuse", "avertissement", "bulletin technique", "rév", "pour communication"), "es": ("desenchufe", "lavadora", "advertencia", "boletín", "técnico", "para la atención")}


def count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def is_matrix(text: Column) -> Column:
    return (F.length(text) >= 80) & text.rlike(GUIDE) & text.rlike(CAUSE)


def is_contents(text: Column) -> Column:
    tests = (count(text, r"(?i)TEST\s*#\s*\d+") >= 8) & text.rlike(r"(?i)Section\s+\d+\s*:") & ~text.rlike(r"(?m)^\s*1\.\s")
    return (F.length(F.trim(text)) >= 40) & ~is_matrix(text) & ((count(text, r"\.{4,}\s*\d+(?:-\d+)?") >= 4) | text.rlike("(?i)TABLE OF CONTENTS") | tests)


def is_schematic(text: Column) -> Column:
    return (F.length(F.trim(text)) >= 12) & ~is_matrix(text) & ~is_contents(text) & text.rlike(SCHEMATIC) & ~text.rlike(PROCEDURE)


def is_figure(text: Column) -> Column:
    """A diagram or artwork: a figure's title over little text, or mostly single letters."""
    tokens = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    words = F.size(F.filter(tokens, lambda t: F.length(t) >= 3))
    share = F.size(F.filter(tokens, lambda t: t.rlike("^[A-Za-z]$"))) / F.greatest(F.size(tokens), F.lit(1))
    titled, spaced = text.rlike(FIGURE_TITLE), text.rlike(r"(?:^|[\s])[A-Za-z](?:\s+[A-Za-z]){3,}")
    drawn = (titled & ((words < 80) | (share >= 0.25))) | (spaced & (share >= 0.35) & (words < 40)) | ((share >= 0.55) & (words < 20) & (F.length(text) < 400))
    procedure = text.rlike(PROCEDURE) & (F.length(text) > 400)
    return (F.length(F.trim(text)) >= 12) & ~is_matrix(text) & ~is_contents(text) & ~procedure & (is_schematic(text) | drawn)


def is_photo_access(text: Column) -> Column:
    return ~is_contents(text) & ~is_schematic(text) & ~is_matrix(text) & text.rlike(PHOTO) & text.rlike(r"(?i)Figure\s+\d+")


def page_layout(text: Column, cells: Column, tables: Column) -> Column:
    """The first kind that fits."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(is_matrix(t), "matrix").when(is_contents(t), "toc").when(is_schematic(t), "schematic").when(is_figure(t), "figure").when(is_photo_access(t), "photo_access")
        .when((cells >= 12) | (tables >= 2), "table_heavy").when(t.rlike(PROCEDURE), "multi_column").otherwise("default")
    )


def should_index(text: Column, kind: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(kind.isin("table_row", "article"), F.lit(False)) | ~(is_schematic(t) | is_figure(t))


def detect_language(text: Column) -> Column:
    """fr or es by their markers, en for other text of more than 40 characters, else null."""
    low = F.lower(text)
    n = {k: sum((F.contains(low, F.lit(m)).cast("int") for m in ms), F.lit(0)) for k, ms in MARKERS.items()}
    fr, es = n["fr"], n["es"]
    return F.when((fr == 0) & (es == 0), F.when(F.length(F.trim(text)) > 40, "en")).when(fr == es, "en").when(fr > es, "fr").otherwise("es")


def unread_figure(text: Column) -> Column:
    return F.coalesce(text.rlike(FIGURE_REFERENCE), F.lit(False))


def needs_image(text: Column) -> Column:
    """Whether a hit is better shown with its page: a figure, a schematic, photos, or text that refers to a figure."""
    t = F.coalesce(text, F.lit(""))
    return is_figure(t) | is_schematic(t) | is_photo_access(t) | unread_figure(t)


def missing_steps(text: Column, least: int = 5) -> Column:
    """Step numbers that a procedure's numbered lines leave out between their first and last; null for what is no procedure."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(\d{1,4})\.\s"), F.lit(1)), lambda x: x.cast("int"))))
    low, high = F.array_min(found), F.array_max(found)
    return F.when((F.size(found) >= least) & (low <= 3) & (high - low + 1 >= least), F.array_except(F.sequence(low, high), found))


def map_private(text: Column) -> Column:
    """List marks of the private use area as bullets, other such characters and NUL dropped, overdrawn connector labels mended."""
    x = F.translate(text, "\uf0d8\uf06e", "••")
    x = F.regexp_replace(x, "[\ue000-\uf8ff\u0000]", "")
    x = F.regexp_replace(x, r"J{2}(\d)(\d)\2", "J$1$2")
    return F.regexp_replace(x, r"-{2}(\d)\1\b", "-$1")


def is_index_language(language: Column) -> Column:
    """Whether text of a language is indexed: English of any region, or none known."""
    return F.coalesce(F.startswith(F.replace(F.lower(language), F.lit("_"), F.lit("-")), F.lit("en")), F.lit(True))


def strip_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def count_private(text: Column, marks: str = "\uf0d8\uf06e") -> Column:
    """How many private-use list marks a text has."""
    return F.char_length(text) - F.char_length(F.translate(text, marks, ""))
