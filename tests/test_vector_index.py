"""The vector index: recall against all rows, pruned folders, exact scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import arms, vector_index
from corvane.plans import retrieval


def vectors(spark, n=1200, clusters=30, width=32):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(clusters, width)) * 2
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, width)) * 0.4
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(9000, None), (9001, []), (9002, [1.0, 2.0])], "id_ int, embedding array<float>")


def test_recall_on_the_small_table(spark, sf):
    assert retrieval.vector_index_recall(spark, sf).first()["recall"] >= 0.9


def test_few_lists_do_where_vectors_have_clusters(spark, tmp_path, monkeypatch):
    held = vectors(spark)
    asked = held.where("id_ % 20 = 0 and id_ < 9000").select(F.col("id_").alias("query_id"), F.col("embedding").alias("vector"))
    book, path = vector_index.fit(held, lists=30, parts=8), str(tmp_path / "index")
    vector_index.build(held, book, path)
    assert spark.read.parquet(path).count() == 1200
    found, exact = vector_index.search(asked, held, book, path, 8, probes=4, kept=60), arms.nearest(asked, held, 8)
    assert vector_index.recall(found, exact).first()["recall"] >= 0.95
    score = {(r.query_id, r.id_): r.score for r in exact.collect()}
    got = found.collect()
    assert all(score[r.query_id, r.id_] == pytest.approx(r.score) for r in got if (r.query_id, r.id_) in score)
    assert all(r.id_ == r.query_id and r.score == pytest.approx(1) for r in got if r.arm_rank == 1)
    plan = vector_index.search(asked.limit(1), held, book, path, 8, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    monkeypatch.setattr(vector_index, "BROADCAST_QUERIES", 10)
    again = vector_index.search(asked, held, book, path, 8, probes=4, kept=60)
    assert {tuple(r) for r in again.select("query_id", "id_", "arm_rank").collect()} == {tuple(r) for r in found.select("query_id", "id_", "arm_rank").collect()}
