"""Embedding whitening: principal components by MLlib's computeSVD on centred rows, exact deviations beside it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import materialize

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 52  # entries are held within this before the shift: whole numbers beyond it are not exact in a double
LEAST_SPREAD = 1e-5  # a component whose deviation is less than this part of the first one's counts as none
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x: entries as whole numbers, floor(64 c) + 1000000; rows with a null vector or an entry that is null or not finite are left out."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null")
    v = v.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(held(c)).cast("long") + SHIFT).alias("x"))


def totals(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows of fit and the exact sum of each dimension; sums beyond a long are taken again as decimals."""
    row = fit.agg(F.count(F.lit(1)), *(F.try_sum(F.get("x", F.lit(i))) for i in range(dim))).first()
    if None in row[1:]:
        row = fit.agg(F.count(F.lit(1)), *(F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")) for i in range(dim))).first()
    return int(row[0]), [int(v) for v in row[1:]]


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row the sum over dimensions of (n x - S)^2, as exact whole numbers."""
    low, high = x.min(axis=0, initial=0), x.max(axis=0, initial=0)
    most = max((max(abs(n * int(a) - s), abs(n * int(b) - s)) for a, b, s in zip(low, high, sums)), default=0)
    if most * most * max(len(sums), 1) < 1 << 62 and n * max(int(np.abs(x).max(initial=0)), 1) < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        gap = x * n - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", gap, gap).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist()]


def principal(fit: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (divisor n) and unit eigenvectors, one a row, of the covariance of fit's x, by falling eigenvalue."""
    mean = [s / n for s in sums]
    centred = F.zip_with("x", F.array(*(F.lit(m) for m in mean)), lambda a, m: a.cast("double") - m)
    rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("v")), "v")
    svd = RowMatrix(rows).computeSVD(len(sums), rCond=LEAST_SPREAD)
    return np.asarray(svd.s.toArray()) ** 2 / n, svd.V.toArray().T


def _projection(sums: list[int], n: int, values: np.ndarray, vectors: np.ndarray):
    mean, scaled = np.array([s / n for s in sums]), (vectors / np.sqrt(values)[:, None]).T
    return lambda x: (x - mean) @ scaled


def identity_error(fit: DataFrame, project, k: int) -> float:
    """The largest entry of the whitened rows' covariance (divisor n, centred) minus the identity."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, first, count = np.zeros((k, k)), np.zeros(k), 0
        for b in batches:
            z = project(_rows(b.column(0)))
            second, first, count = second + z.T @ z, first + z.sum(axis=0), count + len(z)
        value = np.concatenate([second.ravel(), first, [count]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], ["i", "v"])

    rows = fit.select("x").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    value = np.array([r["v"] for r in rows])
    n, mean = value[-1], value[k * k : -1] / value[-1]
    return float(np.abs(value[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def _whiten(rows: DataFrame, dim: int, most: int) -> DataFrame:
    fit, _ = materialize(rows.groupBy("x").count().select("x"), "distinct")
    n, sums = totals(fit, dim)
    empty = rows.sparkSession.createDataFrame([], RESULT)
    if n < 2:
        return empty
    values, vectors = principal(fit, n, sums)
    values, vectors = values[:most], vectors[:most]
    k = len(values)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(sum(deviations(_rows(b.column(0)), n, sums)) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["d"])

    total = sum(int(r["d"]) for r in fit.select("x").mapInArrow(exact, "d string").collect())  # one number of each task
    if not k or not total:
        return empty
    project = _projection(sums, n, values, vectors)
    error = identity_error(fit, project, k)
    explained = values * (float(n) ** 3 / total)  # trace(V) is the sum of all (n x - S)^2 over n^3

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column(1))
            dev = [d if d < 1 << 63 else None for d in deviations(x, n, sums)]
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                 pa.array(dev, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                [f.split()[0] for f in RESULT.split(", ")],
            )

    return rows.select("vec_id", "x").mapInArrow(result, RESULT)


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each row on each of at most `most` principal components.

    Fitted on every distinct vector of whole numbers x once (n of them, with sums S): covariances are centred first and
    have divisor n, so MLlib's singular values s of the centred rows become eigenvalues s^2 / n; the total variance does
    not come from them but from the exact deviations, sums of (n x - S)^2. Components of no variance (less than
    LEAST_SPREAD of the first one's standard deviation) are not returned, nor any where all vectors are equal.

    Vectors of each length are a fit of their own; empty ones have no components. Repeated ids and vectors are rows of
    their own, a null id stays null, an entry beyond 2^52 / 64 counts as that, and a deviation beyond a long is null.
    """
    rows, path = materialize(whole(vectors, id_col, vector_col).withColumn("dim", F.size("x")).filter("dim > 0"), "whole")
    dims = sorted(r["dim"] for r in rows.select("dim").distinct().collect())
    parts = [_whiten(rows.filter(F.col("dim") == d).drop("dim"), d, most) for d in dims]
    return reduce(DataFrame.unionByName, parts) if parts else vectors.sparkSession.createDataFrame([], RESULT)
