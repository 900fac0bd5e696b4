"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become whole numbers, ``floor(SCALE * c) + OFFSET``, so sums and deviations are exact. One pass
gives each task's count, exact sums, mean and centred products, a row of the matrix per row; the rows of all tasks
are combined by matrix row, each shifted to the common mean. The matrix has as many entries as a vector
squared, whatever the number of vectors, and only it comes to the driver.

Its eigenvectors are found in float32 and then corrected by the iteration of Ogita and Aishima in extended
precision, which is four matrix products a step and doubles the number of right digits. Eigenvectors whose
eigenvalues lie closer together than the correction can tell apart are only known as a subspace; there the small problem
in that subspace is solved after each step and the basis turned to it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
#: An eigenvalue below this part of the largest has no direction of its own: its component is 0 everywhere.
FLAT = 1e-13
#: Rows of a vector batch worked on at a time.
STEP = 1024
#: Entries beyond this cannot be told from their neighbours and count as not finite.
MOST = float(2**45)

PART = "i int, n long, total decimal(38,0), mean array<double>, products array<double>"
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def whole(vectors: pa.Array, dims: int) -> np.ndarray:
    """``floor(SCALE * c)`` of every entry as int64, a row per vector."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return np.floor(entries * SCALE).astype(np.int64)


class Moments:
    """Count, exact sums, mean and centred products of the rows added so far."""

    def __init__(self, dims: int) -> None:
        self.n, self.total = 0, [0] * dims
        self.mean, self.products = np.zeros(dims), np.zeros((dims, dims))

    def add(self, rows: np.ndarray) -> None:
        if rows.dtype.kind == "i":
            exact = np.abs(rows).max(initial=0) < (1 << 62) // max(1, len(rows))
            sums = rows.sum(axis=0) if exact else rows.astype(object).sum(axis=0)
            self.total = [a + int(b) for a, b in zip(self.total, sums)]
        rows = rows.astype(np.float64)
        mean = rows.mean(axis=0)
        centred = rows - mean
        apart, n = mean - self.mean, self.n + len(rows)
        self.products += centred.T @ centred + np.outer(apart, apart) * (self.n * len(rows) / n)
        self.mean += apart * (len(rows) / n)
        self.n = n

    def rows(self) -> pa.RecordBatch:
        from decimal import Decimal

        dims = len(self.mean)
        mean = pa.array([self.mean.tolist()] * dims, pa.list_(pa.float64()))
        total = pa.array([Decimal(t) for t in self.total], pa.decimal128(38, 0))
        columns = [pa.array(range(dims), pa.int32()), pa.array([self.n] * dims, pa.int64()), total, mean, pa.array(self.products.tolist(), pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["i", "n", "total", "mean", "products"])


def gathered(dims: int, out: int, seen):
    """Task code: batches of (embedding, ...) to the moments of ``seen`` of their whole numbers, ``out`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = Moments(out)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                moments.add(seen(whole(batch.column("embedding").slice(at, STEP), dims)))
        if moments.n:
            yield moments.rows()

    return run


def combined(key: tuple, parts: pa.Table) -> pa.Table:
    """Task code: one matrix row of all tasks to that of all vectors."""
    i = key[0].as_py()
    n = parts["n"].to_numpy().astype(np.float64)
    means = np.array(parts["mean"].to_pylist())
    rows = np.array(parts["products"].to_pylist())
    mean = (n[:, None] * means).sum(axis=0) / n.sum()
    apart = means - mean
    row = rows.sum(axis=0) + ((n * apart[:, i])[:, None] * apart).sum(axis=0)
    total = sum(parts["total"].to_pylist())
    columns = [[i], [int(n.sum())], [total], [mean.tolist()], [row.tolist()]]
    kinds = [pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["i", "n", "total", "mean", "products"])


def moments_of(vectors: DataFrame, dims: int, out: int, seen) -> tuple[int, list[int], np.ndarray]:
    """(n, exact sums, covariance) of ``seen`` of all vectors; ``out`` rows of ``out`` numbers come to the driver."""
    parts = vectors.select("embedding").mapInArrow(gathered(dims, out, seen), PART)
    rows = parts.groupBy("i").applyInArrow(combined, PART).orderBy("i").collect()
    if not rows:
        return 0, [], np.zeros((0, 0))
    covariance = np.array([r.products for r in rows]) / rows[0].n
    return rows[0].n, [int(r.total) for r in rows], (covariance + covariance.T) / 2


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of eigenvalues in order, those closer together than ``apart`` in one list."""
    cuts = np.flatnonzero(np.diff(values) > apart) + 1
    return [c for c in np.split(np.arange(len(values)), cuts) if len(c) > 1]


def eigen(matrix: np.ndarray, steps: int = 14) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns, to double precision.

    ``eigh`` in float32 starts; every step corrects all vectors by matrix products in extended precision. Eigenvalues
    that the step cannot tell apart make a cluster: their vectors are corrected as a subspace,
    within which the small matrix, shifted by the cluster's middle, is solved in double precision.
    """
    n = len(matrix)
    scale = np.abs(matrix).max(initial=0)
    if not scale:
        return np.zeros(n), np.eye(n)
    a = (matrix / scale).astype(np.longdouble)
    x = np.linalg.eigh((matrix / scale).astype(np.float32))[1].astype(np.longdouble)
    eye = np.eye(n, dtype=np.longdouble)
    norm = float(np.sqrt((a * a).sum()))
    least, values, best, waited = np.inf, np.zeros(n), x, 0
    for _ in range(steps):
        r = eye - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        error = float(np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        waited = 0 if error < least / 2 else waited + 1
        if error < least:
            least, best = error, x
        if waited > 2:
            break
        apart = values[None, :] - values[:, None]
        close = np.abs(apart) <= 2 * error
        e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, apart))
        x = x + x @ e
        for cluster in _clusters(np.asarray(np.sort(values), np.float64), 2 * error):
            own = np.argsort(values, kind="stable")[cluster]
            basis = x[:, own]
            basis = basis + basis @ ((np.eye(len(own), dtype=np.longdouble) - basis.T @ basis) / 2)
            middle = values[own].mean()
            small = basis.T @ (a @ basis - middle * basis)
            size = np.abs(small).max()
            turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1] if size else np.eye(len(own))
            x[:, own] = basis @ turn.astype(np.longdouble)
    x = best + best @ ((eye - best.T @ best) / 2)
    values = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return np.asarray(values[order] * scale, np.float64), np.asarray(x, np.float64)


@dataclass(frozen=True)
class Whitening:
    """What is needed to whiten a vector: its size grows with the number of dimensions only."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` exactly, as int64 or, where that could overflow, as Python's integers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        fits = len(self.sums) * most * most < 1 << 63
        kind = np.int64 if fits else object
        return x.astype(kind) * (self.n if fits else int(self.n)) - np.array(self.sums, kind)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred rows projected on the components, over the root of the eigenvalue; 0 where that is flat."""
        centred = (self.deviations(x) / self.n).astype(np.float64)
        flat = self.values <= FLAT * max(self.values[0], 0)
        return np.where(flat, 0.0, centred @ self.vectors / np.sqrt(np.where(flat, 1.0, self.values)))


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) without NULL, empty, NULL-holding and non-finite vectors, entries as doubles."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c) < MOST, F.lit(False))), F.lit(False)) & (F.size(vector) > 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("embedding")).where(F.coalesce(fine, F.lit(False)))


def fitted(vectors: DataFrame, components: int) -> tuple[int, Whitening | None]:
    """The vectors' length and the whitening of all of that length. Vectors of another length than the most frequent (of
    equally frequent ones the longest) lack entries; they are neither fitted nor whitened."""
    sizes = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if found is None:
        return 0, None
    dims = found.d
    n, sums, covariance = moments_of(vectors.where(F.size("embedding") == dims), dims, dims, lambda x: x)
    values, axes = eigen(covariance)
    trace = float(np.trace(covariance))
    return dims, Whitening(n, tuple(sums), values[:components], axes[:, :components], trace)


def projected(model: Whitening, dims: int):
    """Task code: vectors to a row per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        k = len(model.values)
        explained = model.values / model.trace if model.trace else np.zeros(k)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = whole(part.column("embedding"), dims)
                m = len(x)
                apart = model.deviations(x)
                deviation = pa.array([Decimal(int(d)) for d in (apart * apart).sum(axis=1)], pa.decimal128(38, 0))
                which = np.repeat(np.arange(m), k)
                columns = [
                    part.column("vec_id").take(pa.array(which)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    deviation.take(pa.array(which)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, m)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    return run


def whitened(rows: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component, with the fit's figures; see ``OUT``, and ``identity_error``.

    Vectors that are NULL, empty, hold NULL, NaN, infinity or an entry beyond 2**45, or are of another length than
    the most frequent one give no rows. A NULL id is an id; repeated rows count and are given as often as
    they occur; other columns are ignored. Equal eigenvalues leave their components free to turn among themselves; one
    basis is used for all rows. A component without variance is 0 everywhere, and then the identity error is 1. An
    empty table gives no rows.
    """
    spark = rows.sparkSession
    vectors = usable(rows, id_col, vector_col)
    dims, model = fitted(vectors, components)
    if model is None:
        return spark.createDataFrame([], OUT + ", identity_error double")
    same = vectors.where(F.size("embedding") == dims)
    k = len(model.values)
    _, _, covariance = moments_of(same, dims, k, model.whitened)
    error = float(np.abs(covariance - np.eye(k)).max())
    return same.mapInArrow(projected(model, dims), OUT).withColumn("identity_error", F.lit(error))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
