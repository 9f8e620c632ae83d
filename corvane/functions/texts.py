"""Text: hashes, tokens, HTML, redaction, language, support."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content.
STOP_WORDS = "the and for that this with from are was were have has not but you your may can should then than into onto over under after before when what which there their them they also only just any all see use using".split()
#: Words of the domain that don't identify anything.
GENERIC_WORDS = "door lock washer fault error code control switch cycle drain pump".split()
# Entities that are decoded.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def collapse(text: Column) -> Column:
    """Single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def chunk_id(page: Column, kind: Column, text: Column) -> Column:
    """p<page>-<kind>-<12 hex digits of page:kind:text's digest>."""
    line = F.concat_ws(":", page.cast("string"), kind, F.coalesce(text, F.lit("")))
    return F.concat_ws("-", F.concat(F.lit("p"), page.cast("string")), kind, F.substring(F.sha2(line, 256), 1, 12))


def content_tokens(text: Column) -> Column:
    """Distinct words of three letters or digits and more, lower case, without stop words, sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*map(F.lit, STOP_WORDS))))


def html_to_text(html: Column) -> Column:
    """What a reader sees: no scripts, styles and tags, entities decoded, single spaces."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for name, char in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    return collapse(x)


def slugify(text: Column, limit: int = 48) -> Column:
    x = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.rtrim(F.substring(F.trim(x, F.lit("-")), 1, limit), F.lit("-")), F.lit("")), F.lit("unit"))


def redact(text: Column) -> Column:
    """Tokens of the shape of a serial number become a placeholder."""
    return F.regexp_replace(text, r"\b[A-Z]{1,2}[0-9A-Z][0-9]{2}[0-9]{4,6}\b", "[SERIAL]")


def trace_fingerprint(code: Column, question: Column) -> Column:
    """A failure's identity: its code, and the question in lower case with single spaces."""
    return F.concat_ws("|", code, F.lower(collapse(question)))


def claim_supported(claim: Column, evidence: Column) -> Column:
    """Whether evidence bears out a claim: it contains it (from 12 characters on), or enough of its content words (all of up to three, else 60 %)."""
    tokens, found = content_tokens(claim), content_tokens(evidence)
    both, n = F.size(F.array_intersect(tokens, found)), F.size(tokens)
    folded, hay = F.lower(collapse(claim)), F.lower(collapse(evidence))
    inside = (F.length(folded) >= 12) & F.contains(hay, folded)
    return F.when(folded == "", True).when(hay == "", False).when(inside | (n == 0), True).when(n <= 3, both == n).otherwise(both / n >= 0.6)


def claim_fails_hard(claim: Column, evidence: Column) -> Column:
    """Whether a claim shares no content word with its evidence, or none of those that aren't generic."""
    tokens, found = content_tokens(claim), content_tokens(evidence)
    specific = F.array_except(tokens, F.array(*map(F.lit, GENERIC_WORDS)))
    return (F.size(F.array_intersect(tokens, found)) == 0) | ((F.size(specific) > 0) & (F.size(F.array_intersect(specific, found)) == 0))
