"""Operator 11: embedding whitening by a one-sided Jacobi SVD of a tall-and-skinny QR.

1. Quantise. A vector's entries c become longs floor(scale * c). The fit list has each different vector once; its size n
   and sums S are exact, so that n * x - S, the centred vector times n, is exact too.
2. Compress. Each task folds its centred rows, block by block, into one triangle R (QR of the triangle so far on top of
   the next block); triangles are folded again, FAN_IN at a time, until one is left. It has the rows' singular values and
   right singular vectors, and never the squares that a covariance matrix would have, so small deviations keep their digits.
3. Rotate. Plane rotations orthogonalise R's columns, disjoint pairs of them at a time, until all are; the accumulated
   rotations are the components, the columns' lengths the standard deviations times the root of n.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, fresh, materialise, require

#: Rows that are folded into a triangle at once (in units of its width), and triangles that one task folds into one.
BLOCK_ROWS, FAN_IN = 8, 32
#: Cosine of two columns under which they count as orthogonal, and sweeps over all pairs after which rotation ends.
ORTHOGONAL, SWEEPS = 1e-15, 60
#: A deviation of at most this share of the largest, for each dimension, is rounding and counts as none.
RANK = 4e-16
SAFE = 1 << 62


@dataclass
class Whitening:
    """A fit: `n` different vectors with the sums `sums` (exact), components as rows by falling deviation, and `scale`."""

    scale: float
    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def explained(self, k: int) -> float | None:
        """The share of component k (from 0) in the whole variance; None where there is none."""
        return float(self.deviations[k] ** 2 / self.trace) if self.trace > 0 else None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S for rows of longs; Python's integers where longs could overflow."""
        if self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0) < SAFE and x.min(initial=0) > -SAFE:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def project(self, centred: np.ndarray, k: int) -> np.ndarray:
        """Whitened places of centred rows on the first k components; not a number where a component has no deviation."""
        flat = centred.astype(np.float64) / max(self.n, 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.deviations[:k] > 0, flat @ self.components[:k].T / self.deviations[:k], np.nan)


def usable(embedding: str = "embedding", scale: float = 256.0) -> Column:
    """Whether a vector is one: not null or empty, without null and non-finite entries, and in the range of longs."""
    x = F.col(f"`{embedding}`")
    in_range = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < 9.2e18))
    return F.coalesce(F.size(x) > 0, F.lit(False)) & F.coalesce(in_range, F.lit(False))


def quantised(embedding: str = "embedding", scale: float = 256.0) -> Column:
    return F.transform(F.col(f"`{embedding}`"), lambda c: F.floor(c.cast("double") * scale).cast("long"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def width_of(embeddings: DataFrame, embedding: str = "embedding", scale: float = 256.0) -> int:
    """The commonest number of entries of usable vectors, the larger one of two as common; 0 where there are none."""
    found = embeddings.where(usable(embedding, scale)).groupBy(F.size(F.col(f"`{embedding}`")).alias("d")).count()
    best = found.orderBy(F.desc("count"), F.desc("d")).first()
    return best["d"] if best else 0


def fit_list(embeddings: DataFrame, width: int, embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Column x: each different quantised vector of `width` entries once."""
    rows = embeddings.where(usable(embedding, scale) & (F.size(F.col(f"`{embedding}`")) == width))
    return rows.select(quantised(embedding, scale).alias("x")).distinct()


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows of x and the sums of its entries. A task gives one row, with sums as text since they may pass a long."""

    def run(batches):
        n, total = 0, [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            small = len(x) * max(int(np.abs(x).max(initial=0)), 1) < SAFE and x.min(initial=0) > -SAFE
            part = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(v) for v in total]])], names=["n", "s"])

    tasks = arrow_map(rows, run, "n long, s array<string>")
    n = tasks.agg(F.sum("n")).first()[0] or 0
    each = tasks.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums = {r["i"]: int(r["v"]) for r in each.collect()}  # one row a dimension
    return n, [sums.get(i, 0) for i in range(width)]


def fold(triangle: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """R of the rows that `triangle` stands for and those of `block`."""
    stacked = block if triangle is None else np.vstack([triangle, block])
    return np.linalg.qr(stacked, mode="r") if len(stacked) else np.zeros((0, block.shape[1]))


def triangle_of(rows: DataFrame, start: Whitening) -> np.ndarray:
    """R of all centred rows (divided by n), folded by tasks and then in a tree; the driver gets one triangle."""
    width = start.width

    def first(batches):
        part, r, held, size = TaskContext.get().partitionId() if TaskContext.get() else 0, None, [], 0
        for batch in batches:
            held.append(start.centred(_matrix(batch.column(0), width)).astype(np.float64) / start.n)
            size += len(held[-1])
            if size >= BLOCK_ROWS * width:
                r, held, size = fold(r, np.vstack(held)), [], 0
        if held:
            r = fold(r, np.vstack(held))
        if r is not None and len(r):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def again(batches):
        part, r = None, None
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                part, r = p // FAN_IN, fold(r, x.values.to_numpy(zero_copy_only=False).reshape(-1, width))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    schema = "part long, r array<double>"
    level = materialise(arrow_map(rows, first, schema), "triangles")
    while True:
        m = level.agg(F.count(F.lit(1)).alias("c"), F.max("part").alias("top")).first()
        if m["c"] <= 1:
            break
        # each group of FAN_IN is one task
        groups = m["top"] // FAN_IN + 1
        dealt = level.repartitionById(groups, (F.col("part") / FAN_IN).cast("int")).sortWithinPartitions("part")
        below, level = level, materialise(arrow_map(dealt, again, schema), "triangles")
        discard(below)
    only = level.first()
    discard(level)
    return np.zeros((0, width)) if only is None else np.array(only["r"]).reshape(-1, width)


def rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d columns, as rounds of disjoint pairs."""
    m = d + d % 2
    ring, out = list(range(m)), []
    for _ in range(m - 1):
        pairs = [(a, b) for a, b in zip(ring[: m // 2], ring[: m // 2 - 1 : -1]) if max(a, b) < d]
        out.append((np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as rows), by falling value, by rotating pairs of columns until all are orthogonal."""
    d = triangle.shape[1]
    a, v = np.ascontiguousarray(triangle.T, dtype=np.float64), np.eye(d)  # columns as rows
    order = rounds(d)
    for _ in range(SWEEPS):
        turned = False
        for p, q in order:
            if not len(p):
                continue
            alpha, beta, gamma = (np.einsum("ij,ij->i", a[i], a[j]) for i, j in ((p, p), (q, q), (p, q)))
            go = np.abs(gamma) > ORTHOGONAL * np.sqrt(alpha * beta)
            if not go.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[go], q[go], alpha[go], beta[go], gamma[go]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            for m in (a, v):
                x, y = m[p], m[q]
                m[p], m[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
        if not turned:
            break
    sigma = np.sqrt(np.einsum("ij,ij->i", a, a))
    down = np.argsort(-sigma, kind="stable")
    return sigma[down], v[down]


def fit(embeddings: DataFrame, embedding: str = "embedding", scale: float = 256.0, held: DataFrame | None = None) -> Whitening:
    """The whitening of a table's vectors. `held`: its fit list, where that is at hand as a written table.

    Vectors that are null, empty, have null or non-finite entries or ones whose long would overflow don't count, nor do
    those of another number of entries than most have (the larger number of two as common). Copies count once, in
    whatever number. No vectors: a fit of width 0. A component without deviation (fewer different vectors than
    dimensions) has deviation 0. What a task holds is one triangle (width x width) and a block of rows; the driver, one triangle.
    """
    require(embeddings, embedding)
    rows = held if held is not None else materialise(fit_list(embeddings, width_of(embeddings, embedding, scale), embedding, scale), "fit-list")
    one = rows.first()
    width = len(one["x"]) if one else 0
    n, sums = exact_sums(rows, width) if width else (0, [])
    start = Whitening(scale, n, sums, np.zeros((0, width)), np.zeros(0), 0.0)
    if n:
        triangle = triangle_of(rows, start)
        sigma, v = jacobi(triangle)
        sigma = np.where(sigma > RANK * max(width, 1) * sigma.max(initial=0), sigma, 0.0)
        start = Whitening(scale, n, sums, v, sigma / sqrt(n), float((triangle**2).sum() / n))
    if held is None:
        discard(rows)
    return start


def whiten(embeddings: DataFrame, model: Whitening, components: int = 4, embedding: str = "embedding", names: tuple[str, str] = ("deviation", "whitened")) -> DataFrame:
    """The rows of `embeddings` that have a vector of the fit's width, with its deviation and whitened place beside their columns.

    deviation: the sum over dimensions of (n * x - S) ** 2, exact; null where it passes a long. whitened: the centred
    vector on the first `components` components, each over its standard deviation; null entries where that is 0. Rows
    that `fit` leaves out go, repeated rows stay. `names` must not be columns of `embeddings`. An empty table gives an empty result.
    """
    require(embeddings, embedding)
    if set(map(str.lower, names)) & set(map(str.lower, embeddings.columns)):
        raise ValueError(f"{names} clash with the columns {embeddings.columns}")
    x = fresh([*embeddings.columns, *names], "x_")[0]
    rows = embeddings.where(usable(embedding, model.scale) & (F.size(F.col(f"`{embedding}`")) == model.width))
    rows = rows.select(*[F.col(f"`{c}`") for c in embeddings.columns], quantised(embedding, model.scale).alias(x))
    k, columns = min(components, model.width), [*embeddings.columns, *names]
    if not k:
        return rows.where(F.lit(False)).drop(x).withColumns({names[0]: F.lit(None).cast("long"), names[1]: F.lit(None).cast("array<double>")})

    def run(batches):
        for batch in batches:
            centred = model.centred(_matrix(batch.column(batch.num_columns - 1), model.width))
            top = int(np.abs(centred).max(initial=0)) ** 2 * max(model.width, 1)
            squares = (centred * centred).sum(axis=1) if top < SAFE else (centred.astype(object) ** 2).sum(axis=1)
            places = model.project(centred, k)
            found = pa.array(places.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(places) + 1) * k, pa.int32()), found)
            deviations = pa.array([None if v >= 1 << 63 else int(v) for v in squares], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], deviations, lists], names=columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in embeddings.schema.fields)
    return arrow_map(rows, run, f"{fields}, `{names[0]}` long, `{names[1]}` array<double>")


def identity_error(rows: DataFrame, model: Whitening, components: int = 4) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance (centred, divisor n) minus the identity, over components with a deviation; None where there are none."""
    k = [i for i in range(min(components, model.width)) if model.deviations[i] > 0] if model.n else []
    if not k:
        return None
    w = whiten(rows.select(F.col("x").alias("v")), _unscaled(model), components, "v").select(*[F.col("whitened")[i].alias(f"w{i}") for i in k])
    pairs = [(i, j) for i in k for j in k if i <= j]
    found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def _unscaled(model: Whitening) -> Whitening:
    """The same fit for vectors that are quantised already."""
    return Whitening(1.0, model.n, model.sums, model.components, model.deviations, model.trace)


def whitened_rows(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0, components: int = 4) -> DataFrame:
    """One row per usable vector and component (from 1): vec_id, component, n, deviation, whitened, explained, identity_error."""
    require(embeddings, vec_id, embedding)
    rows = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    held = materialise(fit_list(rows, width_of(rows, scale=scale), scale=scale), "fit-list")
    model = fit(rows, scale=scale, held=held)
    error = identity_error(held, model, components)
    discard(held)
    shares = [model.explained(k) if model.n else None for k in range(min(components, model.width))]
    out = whiten(rows, model, components).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("at") + 1) if shares else F.lit(None).cast("double")
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
