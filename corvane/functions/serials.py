"""Models and serial numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Year codes, one for each year from 1990 on, then over again.
YEAR_CODES = "XABCDEFGHJKLMPRSTUWY0123456789"
FIRST_YEAR, LAST_YEAR = 1990, 2049


def model_matches(pattern: Column, model: Column) -> Column:
    """Equality without regard to case and outer spaces; a final * in the pattern matches any ending. Null for a malformed pattern or an empty model."""
    p, m = F.upper(F.trim(pattern)), F.upper(F.trim(model))
    found = F.when(F.endswith(p, F.lit("*")), F.startswith(m, F.rtrim(p, F.lit("*")))).otherwise(p == m)
    return F.when(p.rlike(r"^[0-9A-Z]+\*?$") & (m != ""), found)


def base_model(model: Column) -> Column:
    """The model without one final digit."""
    m = F.upper(F.trim(model))
    return F.when(F.length(m) > 1, F.regexp_replace(m, "[0-9]$", "")).otherwise(m)


def engineering_digit(model: Column) -> Column:
    m = F.upper(F.trim(model))
    return F.when(F.length(m) > 1, F.nullif(F.regexp_extract(m, "([0-9])$", 1), F.lit("")))


def year_code(year: Column) -> Column:
    """A year's code; null before the first year of the cycle."""
    return F.when(year >= FIRST_YEAR, F.substr(F.lit(YEAR_CODES), F.pmod(year - FIRST_YEAR, F.lit(len(YEAR_CODES))) + 1, F.lit(1)))


def years_for_code(code: Column, last: int = LAST_YEAR) -> Column:
    """All years that a code can stand for; null for what is no code."""
    at = F.instr(F.lit(YEAR_CODES), F.upper(code))
    return F.when((at > 0) & (F.length(code) == 1), F.sequence(FIRST_YEAR - 1 + at, F.lit(last), F.lit(len(YEAR_CODES))))


def serial_parts(serial: Column) -> Column:
    """struct(division, year_code, week, sequence); null for what is no serial.

    One division letter is tried first, then two; the first split with a week of 1 to 53 counts.
    """
    x = F.upper(F.regexp_replace(F.trim(serial), " ", ""))

    def attempt(letters: int) -> Column:
        pattern = rf"^([A-Z]{{{letters}}})([0-9A-Z])([0-9]{{2}})([0-9X]{{1,6}})$"
        week = F.try_to_number(F.nullif(F.regexp_extract(x, pattern, 3), F.lit("")), F.lit("99")).cast("int")
        parts = F.struct(F.regexp_extract(x, pattern, 1).alias("division"), F.regexp_extract(x, pattern, 2).alias("year_code"), week.alias("week"), F.regexp_extract(x, pattern, 4).alias("sequence"))
        return F.when(week.between(1, 53), parts)

    return F.coalesce(attempt(1), attempt(2))


def resolve_year(code: Column, reference: Column) -> Column:
    """The earliest year of a code from the reference year on, else the latest one."""
    years = years_for_code(code)
    return F.coalesce(F.array_min(F.filter(years, lambda y: y >= reference)), F.array_max(years))


def serial_key(parts: Column, reference: Column, filler: str = "0") -> Column:
    """struct(year, week, sequence), in order of making; unknown digits (X) are `filler`."""
    digits = F.regexp_replace(parts["sequence"], "X", filler).cast("int")
    return F.struct(resolve_year(parts["year_code"], reference).alias("year"), parts["week"].alias("week"), digits.alias("sequence"))


def serial_in_range(serial: Column, start: Column, end: Column, reference: Column) -> Column:
    """Whether a serial's parts lie between those of a range, ends included, and of its start's division."""
    low, high = serial_key(start, reference, "0"), serial_key(end, reference, "9")
    key = serial_key(serial, reference, "0")
    return F.coalesce((serial["division"] == start["division"]) & (key >= low) & (key <= high), F.lit(False))
