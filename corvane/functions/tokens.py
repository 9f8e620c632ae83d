"""Token counts for an embedder: a pessimistic estimate, budgets, and windows that fit one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# An embedder's budget, and how a piece of text is charged.
BUDGET = 480
PIECE = r"\w+|[^\w\s]"

_PIECE = re.compile(PIECE)


def estimated(text: str | None) -> int:
    """`estimate` of one text, in Python."""
    return 2 + sum(1 if len(p) <= 4 else max(2, (len(p) + 2) // 3) if any(c.isdigit() for c in p) else (len(p) + 3) // 4 for p in _PIECE.findall(text or ""))


def estimate(text: Column) -> Column:
    """Tokens of a text at most, about: words by their length, those with digits more; two for its ends."""
    n = lambda p: F.char_length(p)
    coded = lambda p: F.greatest(F.lit(2), F.floor((n(p) + 2) / 3).cast("int"))
    cost = lambda p: F.when(n(p) <= 4, 1).when(p.rlike(r"\d"), coded(p)).otherwise(F.floor((n(p) + 3) / 4).cast("int"))
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)" + PIECE), F.lit(0))
    return F.aggregate(F.transform(pieces, cost), F.lit(2), lambda a, x: a + x)


def fits(text: Column, budget: int = BUDGET) -> Column:
    return estimate(text) <= budget


def overflow(text: Column, budget: int = BUDGET) -> Column:
    """Tokens over the budget; 0 where the text fits."""
    return F.greatest(F.lit(0), estimate(text) - budget)


def windows(text: str | None, budget: int = BUDGET) -> list[str]:
    """Text in pieces that fit the budget: lines packed in order, a line that is too long cut where it still fits."""
    body = (text or "").strip()
    if not body or estimated(body) <= budget:
        return [body] if body else []
    out: list[str] = []
    held: list[str] = []
    for line in (x for x in map(str.strip, body.split("\n")) if x):
        if estimated(line) > budget:
            out += ["\n".join(held)] if held else []
            held = []
            out += _cut(line, budget)
        elif held and estimated("\n".join([*held, line])) > budget:
            out.append("\n".join(held))
            held = [line]
        else:
            held.append(line)
    return out + (["\n".join(held)] if held else [])


def _cut(line: str, budget: int) -> list[str]:
    """The longest beginnings that fit, one after the other; one character at least."""
    out, at = [], 0
    while at < len(line):
        low, high = at + 1, len(line)
        while low < high:
            middle = (low + high + 1) // 2
            if estimated(line[at:middle]) <= budget:
                low = middle
            else:
                high = middle - 1
        out.append(line[at:low])
        at = low
    return out
