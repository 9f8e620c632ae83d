"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders written by `materialise` in this process and not yet deleted, with the session that can delete them.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is `spark.checkpoint.dir` of the session; only where that is unset and all runs on one machine, a temporary
    folder is set as the checkpoint folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="corvane-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return base.rstrip("/")


def materialise(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back.

    This cuts the lineage, survives the loss of executors, and fixes values (row numbers) that a second
    evaluation might deal differently. `discard` deletes the files, else the end of the process does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def discard(*held: DataFrame) -> None:
    """Deletes the files of results of `materialise` that nothing reads any more; other frames are left alone."""
    for df in held:
        path = getattr(df, "_corvane_path", None)
        if path in _written:
            _delete(path)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    with contextlib.suppress(Exception):  # a session that has ended, or a folder that is gone
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path in list(_written):
        _delete(path)
        local = path.removeprefix("file://")
        if local.startswith("/"):
            shutil.rmtree(local, ignore_errors=True)


atexit.register(_sweep)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names built on `names` that don't clash with `taken`, whatever the letters' case."""
    held = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package where it isn't installed.

    On a cluster ship it as usual (installed, or `--py-files`).
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    held = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


#: What a worker drops when a task ends: caches that the next task fills anew.
_at_task_end: list[Callable[[], None]] = []


def at_task_end(drop: Callable[[], None]) -> None:
    _at_task_end.append(drop)


def release() -> None:
    """Drops tasks' caches and returns free memory to the system, since workers outlive tasks."""
    for drop in _at_task_end:
        drop()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to a few megabytes, where the session has Spark's default of 10,000 rows of any size."""
    if spark.conf.get(ROWS, "10000") == "10000":
        spark.conf.set(ROWS, str(BATCH_ROWS))
        spark.conf.set(BYTES, str(BATCH_BYTES))


ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def arrow_map(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: T.StructType | str) -> DataFrame:
    """`mapInArrow` with the package reachable from the workers, bounded batches, and caches dropped after each task."""
    reach_workers(df.sparkSession)
    bounded_batches(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def doc_crc(column: str = "doc_id"):
    """crc32 of an id written as text, as the hold-out rules use it (null: as empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "utf-8"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
