"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Floor of the scaled entry, and what is added to it.
SCALE, SHIFT = 1024, 100_000
#: Sums of products below this are exact in double precision.
_EXACT = 1 << 53


class Fit(NamedTuple):
    """Rows, sums per dimension, components as rows, and their eigenvalues (falling), of ``trace`` in all."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def scaled(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long") + SHIFT)


def fit_list(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): scaled vectors of the table's usual length without null or non-finite entries."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull()).filter(fine & (F.size("embedding") > 0)).select("vec_id", scaled(F.col("embedding")).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("x") == (usual["d"] if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L @ L.T = a; its rows are those of ``a``, its columns follow the pivots and end where rounding begins."""
    rest, columns = a.astype(np.float64), []
    left = rest.diagonal().copy()
    least = len(a) * np.finfo(np.float64).eps * max(left.max(initial=0.0), 0.0)
    while len(columns) < len(a):
        p = int(np.argmax(left))
        if not left[p] > least:
            break
        column = rest[:, p] - sum((c[p] * c for c in columns), np.zeros(len(a)))
        column /= np.sqrt(left[p])
        column[left == -np.inf] = 0.0
        columns.append(column)
        left = left - column * column
        left[p] = -np.inf
    return np.stack(columns, 1) if columns else np.zeros((len(a), 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, squared norms), norms falling: pairs of columns of ``factor`` are rotated until all are orthogonal.

    The rounds of a tournament rotate disjoint pairs at once.
    """
    u = factor.copy()
    d = u.shape[1]
    seats = list(range(d)) + ([-1] if d % 2 else [])
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:])) if a >= 0 and b >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            i, j = (np.array(x) for x in zip(*pairs))
            p, q = u[:, i], u[:, j]
            a, b, c = (p * p).sum(0), (q * q).sum(0), (p * q).sum(0)
            worst = max(worst, float((np.abs(c) / np.sqrt(np.maximum(a * b, np.finfo(np.float64).tiny))).max()))
            turned = np.abs(c) > 0
            tau = (b - a) / np.where(turned, 2 * c, 1.0)
            t = np.where(turned, np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            u[:, i], u[:, j] = cos * p - cos * t * q, cos * t * p + cos * q
        if worst < 1e-15 * max(d, 8):
            break
    norms = (u * u).sum(0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    components = (u[:, order] / np.sqrt(norms[order])).T
    lead = np.abs(components).argmax(1)
    return components * np.where(components[np.arange(len(order)), lead] < 0, -1.0, 1.0)[:, None], norms[order]


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension; a partition sends one row for each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["x"])
                x = x if float(np.abs(x).max()) * len(x) < 1 << 62 else x.astype(object)
                n, total = n + len(x), total + x.sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([str(v) for v in total]), pa.array([n] * len(total), pa.int64())], ["i", "s", "n"])

    sums = rows.select("x").mapInArrow(partial, "i int, s string, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    found = sums.orderBy("i").collect()
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def scatter(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of ``x`` (divisor n). Every entry is centred by the rounded mean before it is multiplied, products are summed
    exactly, and what rounding of the mean left is taken off in whole numbers: the result doesn't depend on partitions."""
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    d = len(sums)
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(upper[0]), object), False
        for batch in batches:
            if not batch.num_rows:
                continue
            y, seen = _matrix(batch["x"]) - middle, True
            step = max(1, _EXACT // max(1, int(np.abs(y).max()) ** 2))
            for at in range(0, len(y), step):
                part = y[at : at + step]
                whole = part.astype(object) if step == 1 else part.astype(np.float64)
                product = whole.T @ whole
                total = total + (product if step == 1 else product.astype(np.int64))[upper]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([str(v) for v in total])], ["c", "s"])

    sums_of = rows.select("x").mapInArrow(partial, "c int, s string").groupBy("c").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    out = np.zeros((d, d))
    for r in sums_of.collect():
        i, j = int(upper[0][r["c"]]), int(upper[1][r["c"]])
        out[i, j] = out[j, i] = (n * int(r["s"]) - rest[i] * rest[j]) / (n * n)
    return out


def fit(rows: DataFrame) -> Fit | None:
    """Components of the rows of :func:`fit_list`; None without rows. The driver holds dimension squared numbers."""
    n, sums = column_sums(rows)
    if not n:
        return None
    v = scatter(rows, n, sums)
    components, values = one_sided_jacobi(pivoted_cholesky(v))
    return Fit(n, sums, components, values, float(np.trace(v)))


def projector(fitted: Fit, k: int):
    """Whitened values of a matrix of x-vectors, for use inside tasks."""
    whole = np.array([s // fitted.n for s in fitted.sums], np.int64)
    part = np.array([s % fitted.n / fitted.n for s in fitted.sums])
    weights = (fitted.components[:k] / np.sqrt(fitted.values[:k])[:, None]).T
    return lambda x: ((x - whole).astype(np.float64) - part) @ weights


def identity_error(rows: DataFrame, fitted: Fit, k: int) -> float:
    """Largest absolute entry of the covariance of the first ``k`` whitened components minus the identity, from the rows themselves."""
    project, k = projector(fitted, k), len(fitted.values[:k])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = project(_matrix(batch["x"]))
                sums, products = sums + w.sum(0), products + w.T @ w
        flat = np.concatenate((sums, products.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["c", "s"])

    found = rows.select("x").mapInArrow(partial, "c int, s double").groupBy("c").agg(F.sum("s").alias("s")).orderBy("c").collect()
    flat = np.array([r["s"] for r in found]) / fitted.n
    covariance = flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k])
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, k: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and the first ``k`` components.

    Vectors that are null, empty, hold null or non-finite entries or have another than the table's usual length take no part.
    Every entry becomes ``floor(1024 * c) + 100000``; ``n * x - S`` is summed exactly, as ``deviation decimal(38,0)``. Partitions send
    sums of products only; the driver factors a matrix of dimension squared numbers (:func:`pivoted_cholesky`, then
    :func:`one_sided_jacobi` on the factor: squared column norms are eigenvalues, normalised columns components, the largest
    entry of each positive). Components without variance don't exist, so fewer than ``k`` may come, and none of a table of
    equal vectors; equal eigenvalues stand in column order. Repeated rows and rows without vec_id count and come back one by
    one, an empty table gives none, extra columns are not read.
    """
    rows = durable(fit_list(vectors))
    fitted = fit(rows)
    names = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.values):
        return vectors.sparkSession.createDataFrame([], names).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    error, project, k = identity_error(rows, fitted, k), projector(fitted, k), len(fitted.values[:k])
    n, sums, share = fitted.n, fitted.sums, fitted.values[:k] / fitted.trace
    small = max(abs(s) for s in sums) < 1 << 60

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"])
            far = n * x.astype(object) - np.array(sums, object)
            fits = small and n * float(np.abs(x).max()) < 1 << 60 and float(max(abs(far.max()), abs(far.min()))) ** 2 * len(sums) < 1 << 62
            far = far.astype(np.int64) if fits else far
            squares = [str(v) for v in (far * far).sum(1)]
            w = project(x)
            rows_of = np.repeat(np.arange(len(x)), k)
            component = np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_arrays([
                batch["vec_id"].take(pa.array(rows_of)), pa.array(component + 1, pa.int32()), pa.array(np.full(len(component), n)),
                pa.array(squares).take(pa.array(rows_of)), pa.array(w.ravel()), pa.array(share[component]), pa.array(np.full(len(component), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    done = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(give, names)
    return done.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
