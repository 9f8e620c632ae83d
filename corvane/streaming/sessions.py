"""Structured Streaming: session activity, boards folded per conversation, gated answers, deduplicated traces.

State is kept per key and dropped by time; nothing here depends on how many keys there are in all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import dialogue
from ..operators.rows import reach_workers
from ..operators.safety import FORBIDDEN_OUTPUT, HOLD_BACK


def session_activity(events: DataFrame, ttl: str = "30 minutes", late: str = "10 minutes", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Sessions that end after a pause of `ttl`: user, start, end, n."""
    e = events.withColumn("at_", F.col(ts).cast("timestamp")).withWatermark("at_", late)
    s = e.groupBy(F.col(user), F.session_window("at_", ttl).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts and means by event type in tumbling or sliding windows."""
    e = events.withColumn("at_", F.col(ts).cast("timestamp")).withWatermark("at_", late)
    w = F.window("at_", window, slide) if slide else F.window("at_", window)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def new_traces(events: DataFrame, keys: list[str], within: str = "7 days", ts: str = "ts") -> DataFrame:
    """Events whose keys weren't seen `within` that time."""
    return events.withColumn("at_", F.col(ts).cast("timestamp")).withWatermark("at_", within).dropDuplicatesWithinWatermark(keys).drop("at_")


def keep_in_rocksdb(spark) -> None:
    """State of several named variables needs the store that keeps it on disk; the session's own choice stays, where it has one."""
    if spark.conf.get(PROVIDER, HDFS_STORE) == HDFS_STORE:
        spark.conf.set(PROVIDER, ROCKS_STORE)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
HDFS_STORE, ROCKS_STORE = (f"org.apache.spark.sql.execution.streaming.state.{n}StateStoreProvider" for n in ("HDFSBacked", "RocksDB"))


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, ttl_ms: int | None) -> DataFrame:
    keep_in_rocksdb(rows.sparkSession)
    reach_workers(rows.sparkSession)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "update", "processingTime" if ttl_ms else "none")


class BoardKeeper(StatefulProcessor):
    """A conversation's fold so far, and its turns in a list: turns that come after later ones are folded again with all."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", "fold string, last long", self.ttl_ms)
        self.turns = handle.getListState("turns", "turn long, role string, text string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("turn")
        fresh = [(None if pd.isna(t) else int(t), r, x) for t, r, x in zip(new["turn"], new["role"], new["text"])]
        saved, last = self.fold.get() if self.fold.exists() else (None, None)
        late = last is not None and any(t is not None and t < last for t, *_ in fresh)
        todo = sorted([*self.turns.get(), *fresh], key=lambda t: (t[0] is not None, t[0] or 0)) if late else fresh
        fold = dialogue.Fold.read(None if late else saved)
        for turn, role, text in todo:
            fold.take({"conv_id": key[0], "turn": turn, "role": role, "text": text})
        self.turns.appendList(fresh)
        self.fold.update((json.dumps(asdict(fold)), max([t for t, *_ in fresh if t is not None] + ([last] if last is not None else []), default=None)))
        yield pd.DataFrame({"conv_id": [key[0]], "board": [json.dumps(asdict(fold.board))]})

    def close(self) -> None:
        pass


def fold_boards(turns: DataFrame, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """Each conversation's board (as `operators.dialogue` folds it) after every batch in which it had turns; forgotten `ttl_ms` of processing time after the last one.

    turns: conv_id, turn, role, text. Without a `ttl_ms` boards are never forgotten; a stream that is to end by itself
    needs that, since timers keep one running. Turns are folded in order of turn, also those that come in a later batch
    than turns after them.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    folded = _with_state(rows, "conv_id", BoardKeeper(ttl_ms), "conv_id long, board string", ttl_ms)
    return folded.select("conv_id", F.from_json("board", dialogue.BOARD).alias("b")).select("conv_id", "b.*")


#: Characters of blanks in a row, and of text, that a hazard's match can span; what came before can't be part of one.
BLANKS, SPAN = 41, 128


class Matcher:
    """Looks for hazards in a text that comes in pieces. It carries the last few characters, not the text.

    A hazard's lead may have blanks of any number in it, and between lead and object stand 40 characters at most. So runs
    of blanks are cut to one more than those, and of the rest as many characters are carried as a match can span.
    """

    def __init__(self, tail: str = ""):
        self.pattern, self.tail = re.compile(FORBIDDEN_OUTPUT), tail

    def hit(self, piece: str) -> bool:
        text = re.sub(rf"(\s{{{BLANKS}}})\s+", r"\1", self.tail + piece)
        # a word that the cut goes through begins nowhere
        start = 1 if len(self.tail) > SPAN else 0
        found = self.pattern.search(text, start) is not None
        self.tail = text[-SPAN - 1 :]
        return found


class GateKeeper(StatefulProcessor):
    """An answer's text that is not released yet, the matcher's tail, and pieces that came before their turn."""

    def __init__(self, hold_back: int, ttl_ms: int | None):
        self.hold_back, self.ttl_ms = hold_back, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "pending string, tail string, next long, stopped boolean, done boolean", self.ttl_ms)
        self.early = handle.getListState("early", "n long, piece string, last boolean", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pending, tail, at, stopped, done = self.held.get() if self.held.exists() else ("", "", 0, False, False)
        new = pd.concat(list(rows))
        waiting = {n: (piece, last) for n, piece, last in self.early.get()}
        waiting |= {int(n): (piece or "", bool(last)) for n, piece, last in zip(new["n"], new["piece"], new["last"]) if n >= at}
        ready = []
        while at in waiting:
            piece, last = waiting.pop(at)
            ready.append(piece)
            done, at = done or last, at + 1
        out, text = "", "".join(ready)
        if text and not stopped:
            matcher = Matcher(tail)
            stopped, tail, pending = matcher.hit(text), matcher.tail, pending + text
        if stopped:
            pending = tail = ""
        else:
            limit = len(pending) if done else max(0, len(pending) - self.hold_back)
            cut = limit if done else pending.rfind(" ", 0, limit) + 1
            out, pending = pending[:cut], pending[cut:]
        self.held.update((pending, tail, at, stopped, done))
        if waiting:
            self.early.put([(n, piece, last) for n, (piece, last) in waiting.items()])
        else:
            self.early.clear()
        yield pd.DataFrame({"answer_id": [key[0]], "released": [out], "stopped": [stopped]})

    def close(self) -> None:
        pass


def gate_stream(deltas: DataFrame, hold_back: int = HOLD_BACK, ttl_ms: int | None = 600_000) -> DataFrame:
    """answer_id, released text and whether the answer was stopped, for each batch of deltas(answer_id, n, piece, last); n counts from 0.

    Text is held back until a hazard that could still grow into it would have been seen; after one is seen nothing more is
    released. Pieces that come before their turn wait for it, repeated ones are passed over. State is what is held back
    and a matcher's tail, so a batch costs what it brings, however long the answer is by then.
    """
    rows = deltas.select("answer_id", F.col("n").cast("long").alias("n"), "piece", "last")
    return _with_state(rows, "answer_id", GateKeeper(hold_back, ttl_ms), "answer_id string, released string, stopped boolean", ttl_ms)


def over_capacity(sessions: DataFrame, capacity: int, last: str = "end", key: str = "user_id") -> DataFrame:
    """Sessions beyond the `capacity` most recently used ones, of a table of sessions."""
    keep = sessions.orderBy(F.desc(last), key).limit(capacity).select(key, last)
    return sessions.join(keep, [key, last], "left_anti")


def pieces(text: Column, size: int = 24) -> Column:
    """A text in pieces of `size` characters, as a stream would deliver it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
