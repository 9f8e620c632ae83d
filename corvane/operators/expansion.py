"""Query expansion by families of phrases, intent, and retrieval plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, intent

# Families of phrases: (family, polarity, mid_cycle, what users say, what is added to a search).
FAMILIES = [
    ("door_unlock", "unlock", False, ["got locked", "stuck locked", "locked shut", "door locked", "door is locked", "door was locked"], "door will not unlock door will not open Door locks when cycle has started"),
    ("door_lock", "lock", False, ["failed to lock", "door not lock"], "Door Won't Lock door not closed Ensure that door is completely closed"),
    ("mid_cycle_stop", None, True, ["halfway thru", "halfway through", "halfway into", "mid-cycle", "mid cycle", "without finishing", "in the middle of the wash", "in the middle of wash", "shuts down", "shut down", "no error code", "without an error code", "without error code", "no fault code"], "Activating Service Diagnostic Mode Diagnostic Guide washer stops working standby"),
]
# Word pairs that mean a stop in mid-cycle.
STOP_WORDS, STOP_AFTER = ("stop", "stops", "stopped", "stopping"), ("after", "randomly", "mid", "halfway", "half-way", "half way", "partway", "part-way", "midway")
DOOR_TOPIC = r"(?i)\bdoor\b.*\block|\block\w*\b.*\bdoor\b|\blatch"


def normalised(text: Column) -> Column:
    """Lower case, no apostrophes, single spaces."""
    x = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "‘’`´", "''''"), "'", "")
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def family_pattern(family: str) -> str:
    """One pattern for all that users say of a family."""
    said = next(f[3] for f in FAMILIES if f[0] == family)
    words = "|".join(said)
    if family == "mid_cycle_stop":
        words += f"|({'|'.join(STOP_WORDS)}) ({'|'.join(STOP_AFTER)})"
    return rf"\b({words})\b"


def matches_family(text: Column, family: str) -> Column:
    return normalised(text).rlike(family_pattern(family))


def polarity(text: Column) -> Column:
    """unlock or lock by negations or families; null when neither or both."""

    def read(said: Column) -> Column:
        unlock = (said["composed"] == "unlock") | said["plain"].rlike(family_pattern("door_unlock"))
        lock = (said["composed"] == "lock") | said["plain"].rlike(family_pattern("door_lock"))
        return F.when(unlock & ~lock, "unlock").when(lock & ~unlock, "lock")

    return intent.once(F.struct(F.coalesce(intent.door_polarity(text), F.lit("")).alias("composed"), normalised(text).alias("plain")), read)


def needs_clarification(text: Column) -> Column:
    """Whether a query is about the door's lock but says neither which way nor any fault code."""
    return unclear(text, polarity(text))


def unclear(text: Column, polarity: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(DOOR_TOPIC) & polarity.isNull() & (F.size(codes.error_codes(text)) == 0)


def expanded(text: Column) -> Column:
    """The query with the phrases of its door family, then of mid-cycle stops."""
    add = {f[0]: f[4] for f in FAMILIES}
    p = polarity(text)
    door = F.when(p == "unlock", add["door_unlock"]).when(p == "lock", add["door_lock"])
    mid = F.when(matches_family(text, "mid_cycle_stop"), add["mid_cycle_stop"])
    return F.trim(F.concat_ws(" ", F.trim(F.coalesce(text, F.lit(""))), door, mid))


def with_plan(asks: DataFrame) -> DataFrame:
    """asks(query_id, ask) with polarity, topic, ambiguous, user_codes, embed_query and hops."""
    a = F.col("ask")
    out = asks.withColumns({"polarity": polarity(a), "user_codes": codes.error_codes(a)})
    topic = F.when(a.rlike(DOOR_TOPIC) | F.col("polarity").isNotNull(), "door_lock").otherwise("general")
    hops = F.array_compact(F.array(F.lit("vector"), F.lit("code"), F.lit("connector"), F.lit("xref"), F.when(F.col("polarity").isNotNull(), "polarity_expand")))
    unclear = (F.col("topic") == "door_lock") & F.col("polarity").isNull() & (F.size("user_codes") == 0)
    return out.withColumn("topic", topic).withColumn("ambiguous", unclear).withColumn("embed_query", expanded(a)).withColumn("hops", hops)


def evidence_fits(hits: DataFrame, right: str, wrong: str) -> DataFrame:
    """Of queries with polarity unlock, whether their first five hits don't speak for the opposite: query_id, fits. hits: query_id, rank, text, polarity."""
    top = hits.where("rank <= 5")
    good, bad = F.count_if(F.col("text").rlike(right)), F.count_if(F.col("text").rlike(wrong) & ~F.col("text").rlike(right))
    return top.groupBy("query_id").agg((F.coalesce(F.first("polarity"), F.lit("")) != "unlock").alias("other"), bad.alias("bad"), good.alias("good")).select("query_id", (F.col("other") | ~((F.col("bad") >= 2) & (F.col("good") == 0))).alias("fits"))
