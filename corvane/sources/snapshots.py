"""Tables with versions: staged files, a log of snapshots, and one atomic step that makes a version visible.

A table is a folder. Writers stage a segment (Parquet files of rows, and the keys that they replace or remove) under a
name of their own; nothing refers to it yet. A version is a log file that lists all of its segments. It is made by
giving a complete file the next number, which fails if that number is taken, so of two writers one wins, and readers,
who take the highest number, never see half a version. The loser looks at what came in between: if no key is touched by
both it takes the next number, else it has a conflict.

Rows of older segments whose key a later segment touches don't count. So a small change costs a small segment, and
reading joins older rows with the keys of the later ones; `compact` makes one segment of all.
"""

from __future__ import annotations

import errno
import functools
import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has changed some of the same keys since the version that a change was based on."""


@dataclass
class Version:
    number: int
    segments: list[dict] = field(default_factory=list)  # folder, number of the version that added it, whether it has keys
    note: str = ""


class SnapshotTable:
    """A table of rows with a key column. `partition`: a column whose values become folders, for pruning."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, partition: str | None = None, options: dict[str, str] | None = None):
        self.spark, self.path, self.key, self.schema, self.partition, self.options = spark, path.rstrip("/"), key, schema, partition, options or {}

    # the log

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _log(self, number: int) -> str:
        return f"{self.path}/log/{number:012d}"

    def latest(self) -> int:
        """The number of the current version; 0 if nothing was committed."""
        fs, at = self._fs(f"{self.path}/log")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def version(self, number: int | None = None) -> Version:
        number = self.latest() if number is None else number
        if number == 0:
            return Version(0)
        fs, at = self._fs(self._log(number))
        stream = fs.open(at)
        try:
            content = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(content))

    def _publish(self, v: Version) -> bool:
        """Makes version `v` visible; False if its number is taken."""
        final, staged = self._log(v.number), f"{self.path}/log/_{uuid.uuid4().hex}"
        fs, at = self._fs(staged)
        out = fs.create(at, False)
        out.write(json.dumps(v.__dict__).encode())
        out.close()
        scheme = fs.getUri().getScheme()
        try:
            if scheme == "file":  # there a rename would replace a file; a link doesn't
                os.link(_local(staged), _local(final))
                return True
            jvm = self.spark._jvm
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            files.rename(at, self._fs(final)[1], none)
            return True
        except OSError as e:
            if e.errno != errno.EEXIST:
                raise
            return False
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        finally:
            if fs.exists(at):
                fs.delete(at, False)

    # rows

    def read(self, number: int | None = None, where: str | None = None) -> DataFrame:
        """The rows of a version (the current one by default). `where` is put on the files, so that it prunes partitions."""
        rows, newest = self.layers(number, where)
        if newest is not None:
            rows = rows.join(newest, F.col(self.key).eqNullSafe(F.col("key_")) & (F.col("seq_") < F.col("newest_")), "left_anti")
        return rows.drop("seq_")

    def layers(self, number: int | None = None, where: str | None = None) -> tuple[DataFrame, DataFrame | None]:
        """The rows of all segments of a version, with the number `seq_` that they came with; and key_ and newest_, before
        which the key's rows don't count (None if there is no later segment)."""
        v = self.version(number)
        rows = None
        for s in v.segments:
            part = self._segment(s["folder"]).where(where) if where else self._segment(s["folder"])
            part = part.withColumn("seq_", F.lit(s["number"]))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.spark.createDataFrame([], self.schema).withColumn("seq_", F.lit(0)), None
        later = self._touched(v.segments[1:])  # as few as the changes since the last compaction
        return rows, None if later is None else later.groupBy(F.col(self.key).alias("key_")).agg(F.max("seq_").alias("newest_"))

    def _segment(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}/rows")

    def _touched(self, segments: list[dict]) -> DataFrame | None:
        out = None
        for s in segments:
            keys = self.spark.read.parquet(f"{self.path}/data/{s['folder']}/keys").withColumn("seq_", F.lit(s["number"]))
            out = keys if out is None else out.unionByName(keys)
        return out

    # changes

    def stage(self, rows: DataFrame, removed: DataFrame | None = None, replaced: DataFrame | None = None, whole: bool = False) -> str:
        """Writes a segment that no version refers to yet: `rows`, which replace all rows of their keys (and those of the
        keys of `replaced`), and keys `removed` without new rows. Returns its name. With `whole`, `replaced` has all keys of
        `rows`, so these aren't read back."""
        folder = uuid.uuid4().hex
        base = f"{self.path}/data/{folder}"
        names = [c for c, _ in self.spark.createDataFrame([], self.schema).dtypes]
        writer = rows.select(*names).write.options(**self.options)
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(f"{base}/rows")
        keys = [df.select(self.key) for df in (None if whole else self._segment(folder), removed, replaced) if df is not None]
        functools.reduce(DataFrame.unionByName, keys).distinct().write.parquet(f"{base}/keys")
        return folder

    def commit(self, folder: str, base: int, note: str = "") -> int:
        """Makes a staged segment part of the next version, if no version after `base` touched one of its keys."""
        mine = None
        while True:
            now = self.version()
            between = [s for s in now.segments if s["number"] > base]
            if between:
                mine = self.spark.read.parquet(f"{self.path}/data/{folder}/keys") if mine is None else mine
                theirs = self._touched(between).select(F.col(self.key).alias("key_")).distinct()
                if mine.join(theirs, F.col(self.key).eqNullSafe(F.col("key_")), "left_semi").limit(1).count():
                    raise Conflict(f"versions after {base} touch keys of this change")
            v = Version(now.number + 1, [*now.segments, {"folder": folder, "number": now.number + 1}], note)
            if self._publish(v):
                return v.number

    def replace(self, rows: DataFrame, removed: DataFrame | None = None, base: int | None = None, note: str = "") -> int:
        """Stages and commits a change that was based on version `base` (the current one by default). Returns the new version."""
        base = self.latest() if base is None else base
        return self.commit(self.stage(rows, removed), base, note)

    def revert(self, number: int, note: str = "") -> int:
        """A new version with the segments of an earlier one. It conflicts with a version that appears meanwhile."""
        now, then = self.version(), self.version(number)
        if not self._publish(Version(now.number + 1, then.segments, note or f"as version {number}")):
            raise Conflict("another version appeared meanwhile")
        return now.number + 1

    def compact(self, note: str = "compacted") -> int:
        """A version of the same rows in one segment; segments that others add meanwhile come after it."""
        base = self.version()
        folder = self.stage(self.read(base.number), replaced=self._touched(base.segments))
        while True:
            now = self.version()
            if now.segments[: len(base.segments)] != base.segments:
                raise Conflict("the segments at hand are no longer those of the current version")
            first = {"folder": folder, "number": base.segments[-1]["number"] if base.segments else 0}
            if self._publish(Version(now.number + 1, [first, *now.segments[len(base.segments) :]], note)):
                return now.number + 1


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def publish_documents(table: SnapshotTable, chunks: DataFrame, problems: DataFrame, base: int | None = None, note: str = "") -> tuple[int, DataFrame]:
    """Publishes the documents of `chunks` that have no row in `problems` (key, reason): each whole, or not at all.

    A document with a problem keeps the rows that it had. Returns the version, and key, committed and reason for each document.
    """
    key = table.key
    bad = problems.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason"))
    good = chunks.join(bad.select(F.col(key).alias("bad_")), F.col(key) == F.col("bad_"), "left_anti")
    number = table.replace(good, base=base, note=note)
    every = chunks.select(key).distinct().join(bad, key, "full")
    return number, every.select(key, F.col("reason").isNull().alias("committed"), "reason")
