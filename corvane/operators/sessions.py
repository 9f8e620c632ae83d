"""Sessions: activity windows, turns, and queries built from a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes, replies
from . import expansion

def sessionize(events: DataFrame, gap_seconds: int, user: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """`events` and session_no: from 1, a new one after a pause longer than the gap."""
    order = Window.partitionBy(user).orderBy(ts, tie)
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))
    return events.withColumn("new_", F.coalesce((pause > gap_seconds * 1_000_000).cast("int"), F.lit(1))).withColumn("session_no", F.sum("new_").over(order)).drop("new_")


def session_query(turns: DataFrame, key: str = "conv_id", last: int = 3) -> DataFrame:
    """What to search for after each conversation: sorted fault codes of all user turns, then a text.

    The text is the latest turn where that tells of a stop in mid-cycle and the first one didn't; the first turn that
    isn't mere progress, where the latest is; else the last `last` turns that aren't. turns: key, turn, role, text. A
    conversation's turns are held together.
    """
    user = turns.where("role = 'user'").withColumn("progress", replies.is_progress(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("turn", "text", "progress")))
    s = user.groupBy(key).agg(rows.alias("t"))
    real = F.filter("t", lambda x: ~x["progress"])
    anchor = F.coalesce(F.get(real, F.lit(0))["text"], F.get("t", F.lit(0))["text"])
    latest = F.element_at("t", -1)
    some = F.when(F.size(real) > 0, real).otherwise(F.col("t"))
    recent = F.slice(some, F.greatest(F.size(some) - last + 1, F.lit(1)), F.lit(last))
    stops = lambda x: expansion.matches_family(x, "mid_cycle_stop")
    query = F.when(stops(latest["text"]) & ~stops(anchor), latest["text"]).when(latest["progress"], anchor).otherwise(F.array_join(F.transform(recent, lambda x: x["text"]), " "))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("t", lambda x: codes.error_codes(x["text"])))))
    return s.select(key, F.trim(F.concat_ws(" ", F.nullif(F.array_join(found, " "), F.lit("")), F.trim(query))).alias("query"))


def within_limit(turns: DataFrame, most: int, key: str = "conv_id") -> DataFrame:
    """User turns up to `most` of a conversation."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("turn"))
    return turns.where("role = 'user'").withColumn("place", place).where(F.col("place") <= most)


def prior_assistant(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each user turn with the assistant's last text before it."""
    said = F.when(F.col("role") == "assistant", F.col("text"))
    before = F.last(said, ignorenulls=True).over(Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("prior", before).where("role = 'user'")
