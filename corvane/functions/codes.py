"""Identifiers in text: fault codes, connectors, publications, revisions, literals, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifiers' patterns.
FAULT_CODE = r"(?i)\bF\s*(\d)\s*E\s*(\d)\b"
CONNECTOR = r"(?i)\bJ(\d{1,3})\b"
PUBLICATION = r"(?i)\b(W\d{8})\b"
PART_NUMBER = r"(?i)\bpart\s*(number|#|no\.?)\b"
REVISION = r"(?i)\brevision\s+([A-Z])\b"


def error_codes(text: Column) -> Column:
    """Fault codes, tight or spaced, as sorted distinct tight ones (F5 E2 -> F5E2)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FAULT_CODE), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))))


def connector_ids(text: Column) -> Column:
    """Connectors (J36), distinct, in order as strings."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CONNECTOR), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("J"), x))))


def code_regex(code: Column) -> Column:
    """The pattern that matches a fault code with or without spaces; null for what is no fault code."""
    c = F.upper(F.trim(code))
    made = F.concat(F.lit(r"F\s*"), F.substring(c, 2, 1), F.lit(r"\s*E\s*"), F.substring(c, 4, 1))
    return F.when(c.rlike("^F[0-9]E[0-9]$"), made)


def query_literals(text: Column) -> Column:
    """Tokens of three characters and more with both a digit and a letter, upper case, in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]{3,}"), F.lit(0))
    mixed = F.filter(found, lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]"))
    return F.array_distinct(F.transform(mixed, F.upper))


def queried_publications(text: Column) -> Column:
    """Publications that a query names; none if it speaks of part numbers, which look alike."""
    found = F.regexp_extract_all(text, F.lit(PUBLICATION), F.lit(1))
    return F.when(text.rlike(PART_NUMBER), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.transform(found, F.upper))))


def requested_revision(text: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(text, REVISION, 1), F.lit("")))


def citation_publication(ref: Column) -> Column:
    """The publication that a citation names, also with its revision letter glued on."""
    x = F.trim(ref)
    glued = F.regexp_extract(x, r"\b(W\d{8})[A-Z]\b", 1)
    plain = F.upper(F.regexp_extract(x, r"(?i)\b(W\d{8}|SYNTH-[A-Z0-9-]+)\b", 1))
    named = x.rlike(r"(?i)\bRev\.?\s*[A-Z]\b") | x.rlike(r"(?i)-rev[a-z]\b")
    return F.nullif(F.when(~named & (glued != ""), glued).otherwise(plain), F.lit(""))


def citation_revision(ref: Column) -> Column:
    x = F.trim(ref)
    a = F.upper(F.regexp_extract(x, r"(?i)\bRev\.?\s*([A-Z])\b", 1))
    b = F.upper(F.regexp_extract(x, r"(?i)-rev([a-z])\b", 1))
    c = F.regexp_extract(x, r"\bW\d{8}([A-Z])\b", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.nullif(c, F.lit("")))


def matches_citation(key: Column, needle: Column) -> Column:
    """Whether a citation key satisfies a wanted one: a bare publication takes any revision, a named revision only its own."""
    want_pub, want_rev = citation_publication(needle), citation_revision(needle)
    have_pub, have_rev = citation_publication(key), citation_revision(key)
    revised = want_rev.isNull() | have_rev.eqNullSafe(want_rev)
    inside = F.contains(F.lower(key), F.lower(want_pub)) & revised
    plain = F.startswith(F.lower(key), F.lower(needle))
    out = F.when(want_pub.isNull(), plain).when(have_pub.isNotNull(), (want_pub == have_pub) & revised).otherwise(inside)
    return F.coalesce(out, F.lit(False))


def cite_keys(doc_id: Column, publication: Column, revision: Column) -> Column:
    """The keys under which a hit may be cited: document, publication, publication with revision."""
    with_rev = F.when(publication.isNotNull() & revision.isNotNull(), F.concat(publication, F.lit(" Rev "), F.upper(F.trim(revision))))
    return F.array_compact(F.array(doc_id, publication, with_rev))
