"""Embedding whitening against an eigendecomposition in longer numbers, and its parts against definitions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from corvane.llm import whitening
from corvane.llm.queries import op11_whitening


def table(spark, rows, schema="vec_id long, embedding array<float>"):
    return spark.createDataFrame(rows, schema)


def slow(vectors, k=4):
    """{id: (n, deviation, [whitened])} and explained shares, from the covariance of the different vectors."""
    x = {i: tuple(math.floor(256 * float(c)) for c in v) for i, v in vectors}
    distinct = sorted(set(x.values()))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in distinct])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    out = {}
    for i, row in x.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(row, sums))
        c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(row, sums)])
        out[i] = (n, deviation, (c @ v) / np.sqrt(e))
    return out, e / np.trace(centred.T @ centred / n), v


def held(spark, vectors, **more):
    rows = whitening.whitened_rows(table(spark, vectors).repartition(5), **more).collect()
    found = {}
    for r in rows:
        found.setdefault(r.vec_id, {})[r.component] = r
    return found


def agrees(found, vectors):
    want, shares, _ = slow(vectors)
    assert set(found) == set(want)
    sign = {}
    for i, (n, deviation, w) in want.items():
        for k, value in enumerate(w):
            r = found[i][k + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(shares[k], rel=1e-9) and r.identity_error < 1e-10
            if abs(value) > 1e-6:
                assert sign.setdefault(k, np.sign(value * r.whitened)) == np.sign(value * r.whitened)
            assert abs(abs(r.whitened) - abs(value)) < 1e-7


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12)) * np.array([9, 5, 3, 2, 1, 1, 0.5, 0.5, 0.3, 0.2, 0.1, 0.05])[:, None]
    some = (rng.normal(size=(400, 12)) @ mix + 4).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(some)]
    return rows + [(1000 + i, rows[7][1]) for i in range(300)]  # copies count once


def test_rows_equal_an_eigendecomposition(spark, vectors):
    agrees(held(spark, vectors), vectors)


def test_the_whole_small_table(spark, sf):
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = {}
    for r in op11_whitening(spark, sf).collect():
        found.setdefault(r.vec_id, {})[r.component] = r
    agrees(found, vectors)


def test_left_out_rows_and_extra_columns(spark, vectors):
    nan, inf = float("nan"), float("inf")
    bad = [(5001, None), (5002, [1.0] * 11 + [None]), (5003, [nan] + [1.0] * 11), (5004, [inf] * 12), (5005, [1.0] * 3), (5006, []), (5007, [3e38] * 12)]
    rows = [(i, v, 1.0, None) for i, v in [*vectors, *bad, (None, vectors[0][1])]]
    df = table(spark, rows, "vec_id long, embedding array<float>, whitened double, X_ string")
    out = whitening.whitened_rows(df)
    assert {r.vec_id for r in out.collect()} == {i for i, _ in vectors} | {None}
    model = whitening.fit(df)
    wide = whitening.whiten(df, model, 2, names=("dev", "place"))
    assert wide.columns == [*df.columns, "dev", "place"] and wide.count() == len(vectors) + 1
    with pytest.raises(ValueError):
        whitening.whiten(df, model)


def test_empty_single_and_flat_tables(spark):
    assert held(spark, [(1, None)]) == {}
    assert whitening.whitened_rows(table(spark, [])).collect() == []
    one = held(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])])
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one[2].values()] == [(1, 0, None, None, None)] * 3
    line = held(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])
    assert [r.whitened is None for r in line[0].values()] == [False, True, True]
    assert line[0][1].explained == pytest.approx(1) and line[0][1].identity_error < 1e-12


def test_long_numbers_are_exact(spark):
    vectors = [(i, [1e15 + 7.0 * i, -3e15 + i * i, float(i % 3)]) for i in range(40)]
    rows = whitening.whitened_rows(table(spark, vectors, "vec_id long, embedding array<double>")).collect()
    x = {i: [math.floor(256 * c) for c in v] for i, v in vectors}
    n, sums = len({tuple(v) for v in x.values()}), [sum(c) for c in zip(*{tuple(v) for v in x.values()})]
    assert {(r.vec_id, r.deviation) for r in rows} == {(i, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for i, v in x.items()}


def test_rotations_give_singular_values_and_vectors():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 8, 33):
        a = rng.normal(size=(3 * d, d)) * 10.0 ** -np.arange(d)[:, None].T.clip(max=12)
        r = np.linalg.qr(a, mode="r")
        sigma, v = whitening.jacobi(r)
        assert np.allclose(v @ v.T, np.eye(d), atol=1e-12)
        assert np.allclose(np.linalg.norm(r @ v.T, axis=0), sigma, rtol=1e-12)
        assert np.allclose(sigma, np.linalg.svd(a, compute_uv=False), rtol=1e-6)
        pairs = [tuple(sorted(x)) for p, q in whitening.rounds(d) for x in zip(p.tolist(), q.tolist())]
        assert sorted(pairs) == [(i, j) for i in range(d) for j in range(i + 1, d)]


def test_triangles_fold_in_a_tree(spark, monkeypatch, vectors):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = whitening.fit_list(table(spark, vectors), 12).repartition(9)
    n, sums = whitening.exact_sums(rows, 12)
    start = whitening.Whitening(256.0, n, sums, np.zeros((0, 12)), np.zeros(0), 0.0)
    r = whitening.triangle_of(rows, start)
    x = np.array([r.x for r in rows.collect()])
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c)
