"""Every registered plan against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from corvane import plans
from corvane.plans import registry

plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def cell(v) -> str:
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return "null"
    return f"{float(v):.6g}" if isinstance(v, int | float) or (hasattr(v, "dtype") and v.dtype.kind in "biuf") else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_plan_equals_its_sql(spark, duck, sf, name):
    got, want = registry.PLANS[name](spark, sf).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.PLANS) - set(registry.SQL)))
def test_plan_without_sql_runs(spark, sf, name):
    found = registry.PLANS[name](spark, sf).toPandas()
    assert len(found.columns) and not found.columns.duplicated().any()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
