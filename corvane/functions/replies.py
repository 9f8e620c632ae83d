"""Replies that bring nothing new: checks passed, or done without help."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A reply's forms and its longest length.
ACK = (
    r"(?i)^(?:(?:(?:ok|okay|yes|checked|done|yep)(?:\s+all)?[\s.,]+)?(?:"
    r"no\s+(?:issues?|problems?|errors?|faults?)(?:\s+(?:here|found|there|with\s+(?:that|those|these)|from\s+(?:these|those|the)\s+checks?))*(?:\s+as\s+well)?"
    r"|(?:that|this|it|they|those|these)\s+(?:also\s+)?(?:looks?|sounds|seems)\s+good"
    r"|(?:all|everything)\s+(?:(?:looks|is|seems)\s+)?(?:good|fine|ok|clear|passed?)"
    r"|(?:checks?|tests?)\s+(?:(?:all|look)\s+)?(?:pass(?:ed)?|ok|good|fine|clear)"
    r"|(?:nothing|none)\s+(?:found|wrong|unusual)"
    r"|looks?\s+good"
    r"|(?:all\s+)?(?:clear|good|fine|ok)\.?"
    r"))[\s.!,]*$"
)
UNRESOLVED = (
    r"(?i)^(?:(?:(?:ok|okay|yes|i\s+)?(?:checked|done|tried)[\s.,]+)?(?:but\s+)?still\s+(?:facing|have|seeing|getting|experiencing)\s+(?:the\s+)?(?:same\s+)?(?:issue|problem)s?(?:\s+(?:here|there|though))?"
    r"|(?:(?:ok|okay|yes|i\s+)?(?:checked|done|tried)[\s.,!]*)+(?:but\s+)?(?:(?:it|that|this|the\s+(?:check|reset|step|test))\s+)?(?:did\s+not|didn't|does\s+not|doesn't)\s+(?:solve|fix|work|help|resolve)(?:\s+(?:the\s+)?(?:issue|problem)s?)?"
    r"|(?:that|it|this)\s+(?:did\s+not|didn't)\s+(?:work|help|solve|fix)(?:\s+(?:the\s+)?(?:issue|problem)s?)?"
    r")[\s.!,]*$"
)
LONGEST = 120


def _short(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _says(text: Column, pattern: str) -> Column:
    x = _short(text)
    return (x != "") & (F.char_length(x) <= LONGEST) & x.rlike(pattern)


def is_ack(text: Column) -> Column:
    """Whether a turn only says that checks passed or nothing was found."""
    return _says(text, ACK)


def is_unresolved(text: Column) -> Column:
    """Whether a turn only says that the last check changed nothing."""
    return _says(text, UNRESOLVED) & ~is_ack(text)


def is_progress(text: Column) -> Column:
    return is_ack(text) | is_unresolved(text)


def reply_label(text: Column) -> Column:
    """ack, still_unresolved, or null for a turn that says something else."""
    return F.when(is_ack(text), "ack").when(is_unresolved(text), "still_unresolved")
