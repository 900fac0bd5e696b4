"""Whitening against dense double arithmetic on the driver."""

from __future__ import annotations

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from comandix.llm import catalog, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, n string, _t int"


def usable(rows):
    return [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]


def dense(rows, components=32):
    """(n, deviation by place, values, vectors, whitened, trace) in plain numpy, deviations in exact integers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows]
    n = len(x)
    sums = [sum(column) for column in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, deviation, values, vectors, centred @ vectors / np.sqrt(values), np.trace(covariance)


def compare(got, rows):
    n, deviation, values, _, white, trace = dense(rows)
    k = len(values)
    assert len(got) == len(rows) * k and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.component, r.deviation) for r in got) == Counter((i, c + 1, d) for (i, _), d in zip(rows, deviation) for c in range(k))
    by_id = {i: at for at, (i, _) in enumerate(rows)}
    found = np.zeros((len(rows), k))
    for r in got:
        found[by_id[r.vec_id], r.component - 1] = r.whitened
        assert abs(r.explained - values[r.component - 1] / trace) <= 1e-10 * r.explained
    for at, (i, _) in enumerate(rows):
        found[at] = found[by_id[i]]
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found - signs * white).max() < 1e-7
    assert all(r.identity_error == got[0].identity_error for r in got)
    assert got[0].identity_error < 1e-9


def test_stored_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(catalog.op13_embedding_whitening(spark, sf_dir).collect(), usable(rows))


def test_edges(spark):
    random = np.random.default_rng(1)
    rows = [(i, random.normal(size=5).tolist(), 1, 7, "x", 0) for i in range(40)]
    rows += [rows[3], (None, rows[4][1], None, None, None, None)]
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [math.nan, 1.0, 1.0, 1.0, 1.0], [math.inf] * 5, [1.0, 2.0], [1e38] * 5]
    frame = spark.createDataFrame(rows + [(100 + i, v, 1, 1, "", 1) for i, v in enumerate(odd)], SCHEMA).repartition(4)
    got = whitening.whitened(frame).collect()
    compare(got, [(i, [float(np.float32(c)) for c in v]) for i, v, *_ in rows])
    assert whitening.whitened(frame.limit(0)).collect() == []
    assert whitening.whitened(frame.limit(0)).columns == whitening.whitened(frame).columns


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 3, [[1.0, 5.0], [2.0, 5.0]]])
def test_without_variance(spark, vectors):
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = whitening.whitened(frame).collect()
    assert len(got) == 2 * len(vectors) and all(math.isfinite(r.whitened) for r in got)
    assert all(r.whitened == 0 for r in got if r.component == 2) and got[0].identity_error == 1


def test_exact_beyond_64_bits(spark):
    vectors = [[2.0**30 + i, -(2.0**29)] for i in range(9)]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    _, deviation, *_ = dense(list(enumerate(vectors)), 1)
    assert {r.vec_id: int(r.deviation) for r in whitening.whitened(frame, 1).collect()} == dict(enumerate(deviation))


@pytest.mark.parametrize("values", [
    np.linspace(1, 9, 24),
    np.r_[np.full(8, 3.0), np.linspace(4, 5, 16)],
    np.r_[3 + 1e-9 * np.arange(8), np.linspace(4, 5, 16)],
    np.r_[3 + 1e-13 * np.arange(8), 1e-8 * np.arange(1, 9), 1e4 + np.arange(8)],
    np.full(24, 2.0),
])
def test_eigenvectors_to_double_precision(values):
    """Separate, equal, and clustered eigenvalues: residuals and angles as small as double arithmetic gives them."""
    random = np.random.default_rng(7)
    turn = np.linalg.qr(random.normal(size=(24, 24)))[0]
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, x = whitening.eigen(matrix)
    assert np.all(np.diff(found) <= 1e-12 * values.max())
    assert np.abs(found - np.linalg.eigvalsh(matrix)[::-1]).max() < 1e-14 * len(values) * values.max()
    assert np.abs(x.T @ x - np.eye(24)).max() < 1e-14
    assert np.abs(matrix @ x - x * found).max() < 2e-15 * len(values) * values.max()


def test_better_than_it_starts():
    random = np.random.default_rng(3)
    a = random.normal(size=(300, 64)) * np.linspace(1, 30, 64)
    matrix = a.T @ a / 300
    start = np.linalg.eigh(matrix.astype(np.float32))[1].astype(float)
    values, x = whitening.eigen(matrix)
    rough = np.abs(start.T @ matrix @ start - np.diag(values[::-1])).max()
    fine = np.abs(x.T @ matrix @ x - np.diag(values)).max()
    assert fine < 1e-11 * values[0] < 1e-3 * rough
    assert np.abs(np.abs((x * np.linalg.eigh(matrix)[1][:, ::-1]).sum(axis=0)) - 1).max() < 1e-13
