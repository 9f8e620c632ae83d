"""What a query is after: folding, polarity, intent flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codes import connector_ids, error_codes

# Contractions and what they stand for.
CONTRACTIONS = {
    "won'?t": "will not", "wouldn'?t": "would not", "doesn'?t": "does not", "don'?t": "do not", "didn'?t": "did not", "can'?t": "cannot",
    "couldn'?t": "could not", "isn'?t": "is not", "wasn'?t": "was not", "hasn'?t": "has not", "haven'?t": "have not", "ain'?t": "is not",
}
# Intent patterns.
NEGATED = "((will|would|does|do|did|can|could|is|was|has|have) not|cannot)"
OPENING = "(open|opening|unlock|unlocking)"
UNLOCK = rf"\b{NEGATED}.{{0,28}}\b{OPENING}\b|\b(failed|unable) to {OPENING}\b"
LOCK = r"\b(will|would|does|do|did|can|could) not (lock|latch)\b|\bcannot (lock|latch)\b|\bnot locking\b|\b(failed|unable) to (lock|latch)\b"
LED = r"(?i)\bacu\b.*\bled\b|\bled\b.*\bacu\b"
TECHNICIAN = r"(?i)\b(what should i check|how (?:do|should) i (?:test|diagnose|check)|test\s*#\s*\d|service (?:mode|procedure)|technician|door will not lock|won'?t lock|will not lock)\b"
PART_OR_TEST = r"(?i)\bpart\s*(?:number|#|no\.?)\b|\bW\d{8}\b|\bTEST\s*#"


def fold_query(text: Column) -> Column:
    """Lower case, plain apostrophes, contractions written out (also those that lost their apostrophe), single spaces."""
    q = F.lower(F.translate(F.coalesce(text, F.lit("")), "‘’`´", "''''"))
    for short, long in CONTRACTIONS.items():
        q = F.regexp_replace(q, rf"\b{short}\b", long)
    q = F.replace(q, F.lit("'"), F.lit(""))
    for short, long in CONTRACTIONS.items():
        q = F.regexp_replace(q, rf"\b{short.replace(chr(39) + '?', '')}\b", long)
    return F.trim(F.regexp_replace(q, r"\s+", " "))


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """`fn` of a value that is worked out once, however often `fn` refers to it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def door_polarity(text: Column) -> Column:
    """unlock, lock, or null when a query has neither or both."""

    def read(q: Column) -> Column:
        unlock, lock = q.rlike(UNLOCK), q.rlike(LOCK)
        return F.when(unlock & ~lock, "unlock").when(lock & ~unlock, "lock")

    return once(fold_query(text), read)


def is_led_query(text: Column) -> Column:
    return text.rlike(LED)


def is_technician_query(text: Column) -> Column:
    return text.rlike(TECHNICIAN)


def needs_service_literature(text: Column, bibliographic: Column) -> Column:
    """Whether only service literature can answer: depth, documents, codes, connectors, parts or tests asked for."""
    named = (F.size(error_codes(text)) > 0) | (F.size(connector_ids(text)) > 0) | text.rlike(PART_OR_TEST)
    return (F.coalesce(text, F.lit("")) != "") & (is_technician_query(text) | bibliographic | named)
