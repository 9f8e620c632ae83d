"""Row-wise Python over Arrow batches, for operators whose state or recursion no column expression has."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.writers import shared_folder

#: Rows of a batch, so that long texts don't add up.
BATCH_ROWS = 2_000


def reach_workers(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package where it isn't installed; on a cluster ship it as usual."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    held = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)


def map_rows(df: DataFrame, fn: Callable[[dict], Iterable[dict]], schema: str, read: dict[str, Callable[[pa.Array], list]] | None = None) -> DataFrame:
    """The rows (dicts with the names of `schema`; missing ones are null) that `fn` makes of each row of `df`.

    read: of columns by name, what makes the rows' values of an array, where plain Python objects would be too many.
    """
    reach_workers(df.sparkSession)
    wanted = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(wanted)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(low, BATCH_ROWS)
                columns = [(read or {}).get(c, pa.Array.to_pylist)(part.column(c)) for c in part.schema.names]
                made = [r for row in zip(*columns) for r in fn(dict(zip(part.schema.names, row)))]
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return df.mapInArrow(run, wanted)


def gathered(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "rows") -> DataFrame:
    """One row for each value of `keys`, with an array of structs of the other columns, in order. A key's rows are held together, so keys are of things of bounded size: a conversation, a page, a document's units."""
    struct = F.struct(*order, *[c for c in columns if c not in order])
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(struct)).alias(name))


def settled(df: DataFrame) -> DataFrame:
    """The same rows, from a table in the shared folder: what is built on them doesn't repeat how they were made, and a lost executor's part isn't made again."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
