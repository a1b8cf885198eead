"""Whitening of embeddings by polarisation of exact covariances.

Entries become integers on a fixed grid, so that every sum is exact and does not depend on the order of rows. With z the
values centred on the whole part of each dimension's mean, tasks sum the squares of z for every dimension and of z[a] + z[b]
for every pair of dimensions; as (z[a] + z[b])**2 = z[a]**2 + z[b]**2 + 2 z[a] z[b], differences of these variances give
every cross-covariance. What centring on a whole number leaves is corrected exactly in whole numbers of any size, and only
the quotients that ``eigh`` gets are rounded.

* ``grid`` makes the integer vectors, ``fit_list`` has each distinct one once: repeats are dropped before the shuffle,
  which so moves a hot vector once for each task.
* ``fit`` takes two passes over the written fit list; from each task come one row of sums, then one for each pair of
  dimensions. The driver holds matrices of dimension x dimension, which do not grow with the rows.
* ``whitened`` projects each row where it stands, and ``identity_error`` measures the covariance of the projected fit list.

Defined cases: rows whose vector is null, empty, holds null or non-finite entries or entries beyond +-2**34, or has not the
most frequent length (ties: the longer) are left out; null ids and repeated rows stay, ties and copies count once in the fit
list; components whose eigenvalue is zero to double precision are left out, so fewer than two distinct vectors and an empty
table give an empty result; texts play no part; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this have no place on the grid.
LARGEST = 2**34
#: Rows of one vectorised step.
_STEP = 2048


def grid(vectors: DataFrame, value: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>): floor(64 * entry) + 1000000 of ``vectors(vec_id, value)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(value).cast("array<double>").alias("_v"))
    fine = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= float(LARGEST)))
    rows = rows.where(F.coalesce(fine & (F.size("_v") > 0), F.lit(False)))
    rows = rows.select("vec_id", F.transform("_v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (lengths.d if lengths else 0))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x once, written."""
    return cut(rows.select("x").distinct())


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _total(values: np.ndarray) -> np.ndarray:
    """Sums over rows as whole numbers: in 64 bits where they fit, else in Python's."""
    most = int(np.abs(values).max(initial=0))
    return values.sum(0).astype(object) if most * len(values) < 2**63 else values.astype(object).sum(0)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, 0
    for b in batches:
        x = _matrix(b.column("x"))
        n, sums = n + len(x), sums + _total(x)
    if n:
        yield batch({"a": (np.arange(len(sums)), pa.int32()), "n": ([n] * len(sums), pa.int64()), "s": ([Decimal(int(v)) for v in sums], pa.decimal128(38, 0))})


def _second_pass(middle: np.ndarray):
    """Sums of squares for each dimension (a = b) and of squared sums for each pair (a < b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(middle)
        totals = [np.zeros(d - a, object) for a in range(d)]
        seen = False
        for b in batches:
            z = _matrix(b.column("x")) - middle
            seen = seen or len(z) > 0
            for at in range(0, len(z), _STEP):
                part = z[at : at + _STEP]
                if 4 * int(np.abs(part).max(initial=0)) ** 2 >= 2**62:
                    part = part.astype(object)
                for a in range(d):
                    both = part[:, a:] + part[:, a : a + 1]
                    both[:, 0] = part[:, a]
                    totals[a] = totals[a] + _total(both * both)
        if seen:
            for a in range(d):
                yield batch({"a": ([a] * (d - a), pa.int32()), "b": (np.arange(a, d), pa.int32()), "q": ([Decimal(int(v)) for v in totals[a]], pa.decimal128(38, 0))})

    return run


@dataclass
class Whitening:
    """n and per-dimension sums of the fit list, eigenvalues and unit components (rows) by falling eigenvalue, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of a fit list; None where nothing varies."""
    per_dimension = vectors.mapInArrow(_first_pass, "a int, n long, s decimal(38,0)").groupBy("a").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("a").collect()  # one row a dimension
    if not per_dimension:
        return None
    n, sums = per_dimension[0].n, [int(r.s) for r in per_dimension]
    d = len(sums)
    middle = np.array([s // n for s in sums], np.int64)
    left = [s % n for s in sums]  # the sum of z
    squares = vectors.mapInArrow(_second_pass(middle), "a int, b int, q decimal(38,0)").groupBy("a", "b").agg(F.sum("q").alias("q")).collect()  # one row a pair of dimensions
    found = {(r.a, r.b): int(r.q) for r in squares}
    # n times the variance of a sum, as n**2 * variance; then by differences n**2 * covariance
    variance = {(a, b): n * q - (left[a] + (left[b] if a != b else 0)) ** 2 for (a, b), q in found.items()}
    exact = np.zeros((d, d))
    for (a, b), v in variance.items():
        exact[a, b] = exact[b, a] = v / n**2 if a == b else (v - variance[a, a] - variance[b, b]) / (2 * n**2)
    values, columns = np.linalg.eigh(exact)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0.0) * d * np.finfo(float).eps * 8]
    rows = columns[:, order].T
    rows = rows * np.where(rows[np.arange(len(rows)), np.abs(rows).argmax(1)] < 0, -1.0, 1.0)[:, None]
    trace = sum(variance[a, a] for a in range(d)) / n**2
    return Whitening(n, sums, values[order], rows, trace) if len(order) else None


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exact."""
    most = max(int(np.abs(x).max(initial=0)) * model.n, max(map(abs, model.sums)))
    if 2 * most < 2**63:
        return x * model.n - np.array(model.sums, np.int64)
    return x.astype(object) * model.n - np.array(model.sums, object)


def _project(y: np.ndarray, model: Whitening) -> np.ndarray:
    return (y / model.n).astype(float) @ (model.components / np.sqrt(model.values)[:, None]).T


def _moments(model: Whitening):
    """Sums and products of the projected fit list, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        sums, products, n = np.zeros(k), np.zeros((k, k)), 0
        for b in batches:
            w = _project(_centred(_matrix(b.column("x")), model), model)
            sums, products, n = sums + w.sum(0), products + w.T @ w, n + len(w)
        if n:
            i, j = np.indices((k, k)).reshape(2, -1)
            yield batch({"i": (i, pa.int32()), "j": (j, pa.int32()), "p": (products.ravel(), pa.float64()), "s": (sums[i], pa.float64()), "t": (sums[j], pa.float64())})

    return run


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the projected fit list's covariance minus the identity."""
    n = F.lit(float(model.n))
    sums = vectors.mapInArrow(_moments(model), "i int, j int, p double, s double, t double").groupBy("i", "j").agg(F.sum("p").alias("p"), F.sum("s").alias("s"), F.sum("t").alias("t"))
    error = F.abs(F.col("p") / n - F.col("s") / n * (F.col("t") / n) - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return sums.agg(F.max(error)).first()[0]


_OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, model: Whitening, error: float) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of grid rows(vec_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for b in batches:
            for at in range(0, b.num_rows, _STEP):
                part = b.slice(at, _STEP)
                y = _centred(_matrix(part.column("x")), model)
                large = y.dtype == object or int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 2**63
                deviation = ((y.astype(object) if large else y) ** 2).sum(1)
                m = part.num_rows
                yield batch({
                    "vec_id": (part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.int64()), "component": (np.tile(np.arange(1, k + 1), m), pa.int32()), "n": (np.full(m * k, model.n), pa.int64()),
                    "deviation": ([v for x in deviation.tolist() for v in [Decimal(x) if x < 10**38 else None] * k], pa.decimal128(38, 0)), "whitened": (_project(y, model).ravel(), pa.float64()),
                    "explained": (np.tile(model.values / model.trace, m), pa.float64()), "identity_error": (np.full(m * k, error), pa.float64()),
                })

    return rows.mapInArrow(run, _OUT)


def whiten(vectors: DataFrame, value: str = "embedding", components: int = 16) -> DataFrame:
    """Fit on the distinct vectors of ``vectors(vec_id, value)`` and project all rows; ``deviation`` is exact, null from 10**38 on."""
    rows = grid(vectors, value)
    distinct = fit_list(rows)
    model = fit(distinct, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    return whitened(rows, model, identity_error(distinct, model))
