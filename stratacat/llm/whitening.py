"""Embedding whitening with components from spectral divide and conquer (QDWH).

Entries become integers, so counts, sums and the covariance of the fit list (each different vector once) are exact: tasks
add up centred products per partition, Spark sums them, and only the d x d sums reach the driver. There the covariance is
split again and again: the polar factor U of ``V - shift I``, found by QDWH iterations, gives the projector (U + I) / 2 on the
directions with larger eigenvalues and its complement, and the covariance restricted to each of the two subspaces is split in turn,
down to single directions. The d x k whitening matrix is broadcast, and every row is whitened where it lies.

Defined cases: rows whose vector is null, empty, or has null or non-finite entries are dropped, also those with an entry
of 2^57 or more in size (it has no integer) and those whose length is not the commonest one (of equally common ones the
longest); a null id stays null; repeated rows each get their result but count once in the fit list; directions in which the
fit list does not vary are no components, so one vector alone, or none, gives an empty result; of equal eigenvalues any directions
may stand for their subspace; a deviation beyond the range of long is null; extra columns are ignored. The dimension, not the number of
rows, bounds what the driver holds.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
_EPS = np.finfo(float).eps
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps in their QR form."""
    d = len(a)
    size = np.abs(a).sum(axis=1).max()
    x = a / size
    try:
        low = 1 / (np.abs(np.linalg.inv(x)).sum(axis=1).max() * np.sqrt(d))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, _EPS / 4), 1.0)
    eye = np.eye(d)
    for _ in range(60):
        t = np.cbrt(max(4 * (1 - low**2), 0) / low**4)
        p = np.sqrt(1 + t) + 0.5 * np.sqrt(max(8 - 4 * t + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + t)), 0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.concatenate([np.sqrt(r) * x, eye]))
        new = q / r * x + (p - q / r) / np.sqrt(r) * both[:d] @ both[d:].T
        new = (new + new.T) / 2
        low = min(low * (p + q * low**2) / (1 + r * low**2), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 1e-9 and 1 - low < 10 * _EPS:
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Bases of the directions above and below ``shift``, and what still couples them."""
    d = len(a)
    u = polar(a - shift * np.eye(d))
    project = (u + np.eye(d)) / 2
    k = round(float(np.trace(project)))
    if not 0 < k < d:
        return None
    basis = np.random.default_rng(d).standard_normal((d, k))
    for _ in range(2):
        basis, _ = np.linalg.qr(project @ basis)
    whole, _ = np.linalg.qr(basis, mode="complete")
    upper, lower = basis, whole[:, k:]
    return upper, lower, float(np.linalg.norm(lower.T @ a @ upper))


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    scale = max(float(np.linalg.norm(a)), np.finfo(float).tiny)

    def split(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, diagonal = len(m), np.diag(m)
        if d == 1 or np.linalg.norm(m - np.diag(diagonal)) <= 2 * _EPS * scale:
            return diagonal.copy(), np.eye(d)
        best = None
        mean, middle = float(diagonal.mean()), float(np.median(diagonal))
        for shift in (middle, mean, (middle + mean) / 2, float(np.quantile(diagonal, 0.25)), float(np.quantile(diagonal, 0.75)), mean + 0.1 * float(diagonal.max() - mean)):
            found = _halves(m, shift)
            if found and (best is None or found[2] < best[2]):
                best = found
            if best and best[2] <= 4 * _EPS * scale * np.sqrt(d):
                break
        if best is None:
            return diagonal.copy(), np.eye(d)
        values, vectors = [], []
        for basis in best[:2]:
            inner = basis.T @ m @ basis
            e, v = split((inner + inner.T) / 2)
            values.append(e)
            vectors.append(basis @ v)
        return np.concatenate(values), np.concatenate(vectors, axis=1)

    values, vectors = split((a + a.T) / 2)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


class Whitening(NamedTuple):
    """A fit: the number of different vectors, their sums by dimension, eigenvalues, trace, and the d x k matrix."""

    n: int
    sums: list[int]
    values: np.ndarray
    trace: float
    matrix: np.ndarray


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the usable rows."""
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(2**57))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(~F.exists("v", lambda c: F.coalesce(entry(c), F.lit(True))))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (common.d if common else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _matrix(column: pa.Array, pivot: list[int] | None = None) -> np.ndarray:
    """The vectors as rows of int64, or of Python integers where sums of products could leave its range."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(column), -1)
    if pivot is not None:
        x = x.astype(object) - np.array(pivot, object) if np.abs(x).max(initial=0) >= 2**61 or max(map(abs, pivot)) >= 2**61 else x - np.array(pivot, np.int64)
    return x


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if x.size else 0.0


def _numbers(values) -> pa.Array:
    return pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            part = (x if _largest(x) * len(x) < 2**62 else x.astype(object)).sum(axis=0).astype(object)
            n, total = n + len(x), part if total is None else total + part
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), _numbers(total)], ["i", "n", "s"])


def _products(batches: Iterator[pa.RecordBatch], pivot: list[int]) -> Iterator[pa.RecordBatch]:
    """Sums of products of the entries beyond ``pivot``, exact: products of doubles below 2^53, else of integers."""
    total = None
    for batch in batches:
        if batch.num_rows:
            y = _matrix(batch.column("x"), pivot)
            big = _largest(y)
            if big * big * len(y) < 2**53:
                y = y.astype(float)
                part = np.rint(y.T @ y).astype(np.int64).astype(object)
            else:
                y = y.astype(object)
                part = y.T @ y
            total = part if total is None else total + part
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _numbers(total[i, j])], ["i", "j", "s"])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact."""
    s = np.array(sums, object)
    if n * _largest(x) + max(abs(v) for v in sums) < 2**62:
        return x * n - s.astype(np.int64)
    return x.astype(object) * n - s


def _scores(batches: Iterator[pa.RecordBatch], fit) -> Iterator[pa.RecordBatch]:
    """Sums of products of whitened entries."""
    model, total = fit.value, None
    for batch in batches:
        if batch.num_rows:
            y = _centred(_matrix(batch.column("x")), model.n, model.sums).astype(float) / model.n @ model.matrix
            part = y.T @ y
            total = part if total is None else total + part
    if total is not None:
        i, j = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])


def _whiten(batches: Iterator[pa.RecordBatch], fit, error: float) -> Iterator[pa.RecordBatch]:
    model = fit.value
    k = model.matrix.shape[1]
    share = model.values[:k] / model.trace
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        z = _centred(_matrix(batch.column("x")), model.n, model.sums)
        if z.dtype != object and _largest(z) ** 2 * z.shape[1] < 2**62:
            deviation = pa.array(np.repeat((z * z).sum(axis=1), k))
        else:
            exact = [sum(int(v) ** 2 for v in row) for row in z]
            deviation = pa.array([v if v < 2**63 else None for v in exact for _ in range(k)], pa.int64())
        y = z.astype(float) / model.n @ model.matrix
        ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k)))
        columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), deviation, pa.array(y.ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, error))]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the different vectors ``x``; None if there is no vector or none that differs."""
    totals = vectors.mapInArrow(_sums, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    if not totals:
        return None
    n, sums = totals[0].n, [int(r.s) for r in totals]
    pivot = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * p for s, p in zip(sums, pivot, strict=True)]
    covariance = np.zeros((len(sums), len(sums)))
    products = vectors.mapInArrow(partial(_products, pivot=pivot), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for r in products.collect():
        # both are centred on the pivot; what the mean is beyond it goes exactly, and one division rounds
        covariance[r.i, r.j] = covariance[r.j, r.i] = (n * int(r.s) - rest[r.i] * rest[r.j]) / (n * n)
    values, vectors_ = spectrum(covariance)
    k = min(components, int((values > len(values) * _EPS * max(values[0], 0)).sum()) if values[0] > 0 else 0)
    return Whitening(n, sums, values, float(np.trace(covariance)), vectors_[:, :k] / np.sqrt(values[:k])) if k else None


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """One row for each usable vector and component."""
    spark = vectors.sparkSession
    rows = integers(vectors, column)
    different = C.store(rows.select("x").distinct(), "vectors")
    model = fit(different, components)
    if model is None:
        return spark.createDataFrame([], _RESULT)
    shared = spark.sparkContext.broadcast(model)
    sums = different.mapInArrow(partial(_scores, fit=shared), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    error = max(abs(r.s / model.n - (r.i == r.j)) for r in sums)
    return rows.mapInArrow(partial(_whiten, fit=shared, error=error), _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(C.table(spark, sf_dir, "embeddings"))
