"""Whitening of embeddings by blockwise QR and a bidiagonal qd solver.

Entries become whole numbers, so counts, sums and deviations are exact. The model is fitted
to the distinct vectors, found by a grouped shuffle that combines repeats first. Each task
folds its centred rows into one triangular factor R, block by block; factors are
folded by ``FAN_IN`` at a time until one is left, so neither task nor driver ever
holds more than that many of them. Its singular values and right vectors (``bidiagonal``) are those
of all centred rows: e = s * s / n are the covariance's eigenvalues, and no covariance
matrix is formed, so small ones keep their accuracy. The fitted model is one matrix of
dimensions by components, sent to the tasks that score the rows.

Defined cases: rows whose vector is null, empty, or has null or non-finite entries are dropped,
and so are entries of 2**56 or more, whose whole number is no long. Where lengths differ,
the most frequent one among distinct vectors counts (of ties the longest), the other
rows are dropped. Components whose variance vanishes next to the largest (to double precision)
have no direction and give no rows, so equal vectors or a single one give none. Equal eigenvalues
get some orthonormal directions, the same for all rows. A deviation beyond a long is null. Rows without id
and repeated ids are rows like others; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.llm.bidiagonal import right_singular
from freightlens.llm.common import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
FAN_IN = 16
#: Numbers handled at a time inside a task.
SLICE_NUMBERS = 1 << 18
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vector: Column) -> Column:
    """The whole numbers of a vector, null where it is dropped."""
    usable = (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 56), F.lit(False)))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET))


@dataclass(frozen=True)
class Centre:
    """Count and exact sums of the fit list."""

    n: int
    sums: tuple[int, ...]

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as 64-bit numbers where they suffice."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums), 1)
        if most < 1 << 61:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.times_n(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        far = self.times_n(x)
        if far.dtype != object and int(np.abs(far).max(initial=0)) ** 2 * far.shape[1] < 1 << 62:
            return (far * far).sum(axis=1).tolist()
        return [d if d < 1 << 63 else None for d in (far.astype(object) ** 2).sum(axis=1)]


@dataclass(frozen=True)
class Whitening:
    """Directions (dimensions by components) over the roots of their variances, and what they explain."""

    centre: Centre
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.directions


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows with their vectors as a matrix."""
    step = max(1, SLICE_NUMBERS // dims)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            rows = batch.slice(at, step)
            yield rows, rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(fit: DataFrame, dims: int) -> tuple[int, ...]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for _, x in _matrices(batches, dims):
            small = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            total += (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
        yield pa.record_batch([pa.array([[int(v) for v in total]], pa.list_(pa.decimal128(38, 0)))], ["v"])

    found = fit.mapInArrow(partial, "v array<decimal(38,0)>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    by_pos = {r["pos"]: int(r["s"]) for r in found}
    return tuple(by_pos[i] for i in range(dims))


def _folded(rows: Iterator[np.ndarray], dims: int) -> np.ndarray:
    """The triangular factor of all rows."""
    out = np.zeros((0, dims))
    for block in rows:
        out = np.linalg.qr(np.vstack([out, block]), mode="r")
    return out


def triangular(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred rows of ``fit``, as a square matrix."""
    dims = len(centre.sums)
    schema = "id long, r array<double>"

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _folded((centre.centred(x) for _, x in _matrices(batches, dims)), dims)
        if len(r):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["id", "r"])

    def together(factors: pa.Table) -> pa.Table:
        factors = factors.sort_by("id")  # one sum whatever the order of arrival
        r = _folded((np.array(v.as_py()).reshape(-1, dims) for v in factors.column("r")), dims)
        return pa.table({"id": pa.array([factors.column("id")[0].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    factors = written(fit.mapInArrow(in_task, schema))
    last = factors.agg(F.max("id")).first()[0]
    while last > 0:
        factors = written(factors.groupBy(F.floor(F.col("id") / FAN_IN)).applyInArrow(together, schema))
        last //= FAN_IN
    rows = np.array(factors.first()["r"]).reshape(-1, dims)
    return np.vstack([rows, np.zeros((dims - len(rows), dims))]) if len(rows) < dims else rows


def _identity_error(fit: DataFrame, centre: Centre, directions: np.ndarray) -> float:
    """The largest entry of the scores' covariance over the fit list, the identity taken off."""
    dims, k = directions.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = np.zeros(k), np.zeros((k, k))
        for _, x in _matrices(batches, dims):
            y = centre.centred(x) @ directions
            total += y.sum(axis=0)
            gram += y.T @ y
        yield pa.record_batch([pa.array([np.concatenate([total, gram.ravel()])], pa.list_(pa.float64()))], ["v"])

    found = fit.mapInArrow(partial, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    v = np.zeros(k + k * k)
    for r in found:
        v[r["pos"]] = r["s"]
    mean = v[:k] / centre.n  # of centred rows: 0 but for rounding
    return float(np.abs(v[k:].reshape(k, k) / centre.n - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit to the distinct vectors of ``x``; None where no component has a variance."""
    distinct = written(x.filter(F.col("x").isNotNull()).groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    shape = distinct.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if shape is None:
        return None
    dims, n = shape
    distinct = distinct.filter(F.size("x") == dims)
    centre = Centre(n, _sums(distinct, dims))
    values, vectors = right_singular(triangular(distinct, centre), components)
    k = vectors.shape[1]
    if not k:
        return None
    directions = vectors / np.sqrt(values[:k] / n)
    return Whitening(centre, directions, values[:k] / values.sum(), _identity_error(distinct, centre, directions))


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: the contract's columns (``OUT``)."""
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vector_col}`")).alias("x"))
    model = fit_whitening(rows, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], OUT)
    dims, k = model.directions.shape
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        numbers = np.arange(1, k + 1, dtype=np.int32)
        for part, x in _matrices(batches, dims):
            many = np.repeat(np.arange(len(x)), k)
            same = lambda v, kind: pa.array(np.full(len(many), v), kind)  # noqa: E731, B023
            columns = [
                part.column("vec_id").take(pa.array(many)), pa.array(np.tile(numbers, len(x))), same(w.centre.n, pa.int64()),
                pa.array(w.centre.deviation(x), pa.int64()).take(pa.array(many)), pa.array(w.scores(x).ravel()),
                pa.array(np.tile(w.explained, len(x))), same(w.identity_error, pa.float64()),
            ]
            yield pa.record_batch(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == dims).mapInArrow(run, OUT)

