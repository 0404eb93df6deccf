"""Whitening by the leading components of a covariance, which FEAST contour integration finds interval by interval.

Vectors become whole numbers x = floor(scale * c). Each distinct x is fitted once: equal vectors are joined before and after
one shuffle, so a vector that many rows share loads no task. Two passes over the distinct vectors, written to the shared
checkpoint folder, add up whole numbers only: first the sums S, then the products of the vectors centred at floor(S/n). From
these the covariance (divisor n) follows as exact fractions, rounded once to doubles, whatever the order of the tasks.

The spectrum is cut into intervals by inertia: an LDL' factorisation of V - s I with symmetric pivots of order 1 and 2 has as
many negative pivots as V has eigenvalues below s, so a bisection on s finds cuts with few eigenvalues between them. Intervals
are independent and are solved by Spark tasks. In each, FEAST applies the Gauss-Legendre quadrature of the resolvent on a
circle around the interval to a block of vectors (complex shifted solves), which damps all eigenvectors outside; a
Rayleigh-Ritz step on what is left gives eigenpairs, and both are repeated until the residuals are those of double
precision. An interval is done when it gave exactly as many pairs as the inertia says; else its block grows until it does.

The covariance, d * d numbers, is the one thing that goes through the driver and to the tasks; dimensions above MOST_DIMENSIONS are
refused.

Defined results: vectors that are null or hold null or non-finite entries give no row. Vectors of another length than the
commonest (of equally common ones the longest) among the distinct vectors share no covariance with the others and give no
row either, nor do empty ones. Every other row gives one row for each component, repeated rows and those with a null id too.
Components are numbered by falling eigenvalue; those whose eigenvalue is no more than rounding (a single distinct vector,
dimensions that others imply) cannot be whitened and are left out. The sign makes the first of the largest entries
positive. A deviation that fits no long is null. Entries beyond 2^31 in size are refused with an error. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.shared import cut, plain
from llm.vectors import doubles, finite

MOST_DIMENSIONS = 4096
#: Entries up to this size have products and sums that whole numbers of 63 bits hold in a batch.
LARGEST = 1 << 31
#: Distinct vectors that a task adds up at least, for each dimension at least so many, so that sums are few beside vectors.
IN_TASK, IN_TASK_BY_DIMENSION = 50_000, 64
#: Eigenvalues that an interval should hold at most, and nodes of the quadrature on its half circle.
IN_INTERVAL, NODES = 8, 8
#: Refinements of an interval before its block grows.
REFINEMENTS = 30
EPSILON = float(np.finfo(np.float64).eps)


# whole vectors


def _whole(matrix: np.ndarray, scale: int) -> np.ndarray:
    whole = np.floor(scale * matrix)
    if whole.size and np.abs(whole).max() > LARGEST:
        raise ValueError(f"entries beyond {LARGEST} are not whitened")
    return whole.astype(np.int64)


def _cells(whole: np.ndarray) -> pa.Array:
    """Each row as little-endian numbers of 1, 2, 4 or 8 bytes, the least that hold the row, after a byte that says which:
    equal vectors have equal cells."""
    most, least = whole.max(axis=1, initial=0), whole.min(axis=1, initial=0)
    out: list[bytes] = [b""] * len(whole)
    done = np.zeros(len(whole), bool)
    for size in (1, 2, 4, 8):
        info = np.iinfo(f"i{size}")
        now = ~done & (most <= info.max) & (least >= info.min)
        for i, row in zip(np.flatnonzero(now), whole[now].astype(f"<i{size}")):
            out[i] = bytes([size]) + row.tobytes()
        done |= now
    return pa.array(out, pa.binary())


def _matrix(cells: list[bytes]) -> np.ndarray:
    """Cells of vectors of one length as a matrix."""
    return np.stack([np.frombuffer(c, f"<i{c[0]}", offset=1).astype(np.int64) for c in cells])


def _distinct(vectors: DataFrame, scale: int) -> DataFrame:
    """(dimensions, cell) of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, matrix in finite(batch.column(1)):
                if matrix.shape[1]:
                    cells = _cells(_whole(matrix, scale))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(matrix), matrix.shape[1], np.int32)), cells], ["dimensions", "cell"])

    return vectors.mapInArrow(run, "dimensions int, cell binary").distinct()


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield _matrix(batch.column(0).to_pylist())


def _added(parts: DataFrame) -> list:
    """Sums of (i, j, total) rows by place; no more rows than places, whatever the number of tasks."""
    return parts.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()


def _sums(fit: DataFrame, dimensions: int) -> list[int]:
    """Sums of each dimension over the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dimensions, object)
        for whole in _batches(batches):  # below 2^31 times the rows of a batch
            total = total + whole.sum(axis=0).astype(object)
        columns = [pa.array(np.arange(dimensions)), pa.array(np.zeros(dimensions, np.int64)), pa.array([str(x) for x in total], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "total"])

    out = [0] * dimensions
    for row in _added(fit.mapInArrow(run, "i bigint, j bigint, total string")):
        out[row.i] = int(row.total)
    return out


def products(centred: np.ndarray) -> np.ndarray:
    """Exact sums of products of each two columns, as whole numbers; Python's own where 63 bits need not hold them."""
    bound = float(np.abs(centred).max(initial=0)) ** 2 * len(centred)
    if bound < 2**53:
        real = centred.astype(np.float64)
        return (real.T @ real).astype(np.int64)
    if bound < 2**62:
        return centred.T @ centred
    wide = centred.astype(object)
    return wide.T @ wide


def _centred_products(fit: DataFrame, centre: np.ndarray) -> list[list[int]]:
    """Sums of products of the vectors less the centre."""
    dimensions = len(centre)
    rows, columns = np.triu_indices(dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rows), object)
        for whole in _batches(batches):
            total = total + products(whole - centre)[rows, columns].astype(object)
        decimals = pa.array([str(x) for x in total], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(columns, pa.int64()), decimals], ["i", "j", "total"])

    out = [[0] * dimensions for _ in range(dimensions)]
    for row in _added(fit.mapInArrow(run, "i bigint, j bigint, total string")):
        out[row.i][row.j] = out[row.j][row.i] = int(row.total)
    return out


@dataclass
class Fit:
    """The vectors that were fitted: how many, their sums, their covariance, and the table of them."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    vectors: DataFrame

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))


def fit_covariance(vectors: DataFrame, scale: int) -> Fit | None:
    """Covariance of the distinct vectors of the commonest length; none without vectors."""
    distinct = cut(_distinct(vectors, scale))
    lengths = distinct.groupBy("dimensions").count().orderBy(F.desc("count"), F.desc("dimensions")).limit(1).collect()
    if not lengths:
        return None
    dimensions, n = lengths[0]
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} entries; the covariance of at most {MOST_DIMENSIONS} goes through the driver")
    tasks = math.ceil(n / max(IN_TASK, IN_TASK_BY_DIMENSION * dimensions))
    fit = distinct.where(F.col("dimensions") == dimensions).select("cell").coalesce(tasks)
    sums = _sums(fit, dimensions)
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    raw = _centred_products(fit, np.array(centre, np.int64))
    covariance = np.array([[float(Fraction(n * raw[i][j] - rest[i] * rest[j], n * n)) for j in range(dimensions)] for i in range(dimensions)])
    return Fit(n, sums, covariance, fit)


# eigenpairs


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie below the shift: negative pivots of its LDL' factorisation, with
    symmetric pivots of order 1 or 2, the largest ones first."""
    a = matrix - shift * np.eye(len(matrix))
    below = 0
    while (n := len(a)) > 0:
        size = np.abs(a)
        on = np.diagonal(size)
        best = int(on.argmax())
        off = size - np.diag(on)
        i, j = divmod(int(off.argmax()), n)
        if on[best] >= 0.64 * off[i, j]:  # the usual bound on growth, (1 + sqrt 17) / 8
            pivot = [best]
            below += a[best, best] < 0
        else:
            pivot = [i, j]
            below += 1  # the determinant is negative: one eigenvalue on each side
        rest = np.setdiff1d(np.arange(n), pivot)
        block = a[np.ix_(pivot, pivot)]
        if not block.any():  # nothing but zeros is left: no more eigenvalues below
            break
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return int(below)


def leading_intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues between them) that together hold at least the wanted largest eigenvalues.

    Cuts are found by bisecting on the inertia. An interval holds at most IN_INTERVAL eigenvalues, unless more of them are
    so close that no double tells them apart well.
    """
    n = len(matrix)
    reach = float(np.abs(matrix).sum(axis=1).max())  # no eigenvalue is larger
    # an uneven margin, so that a cut does not meet an eigenvalue such as 0 or the bound itself
    floor, top = -0.01 * reach, 1.0371 * reach
    below = {floor: 0, top: n}
    tiny = 64 * EPSILON * reach

    def split(low: float, high: float) -> list[tuple[float, float, int]]:
        """The interval or, if it holds too many, its halves; halves below the wanted ones are left alone."""
        inside = below[high] - below[low]
        if inside == 0 or n - below[high] >= wanted:
            return []
        if inside <= IN_INTERVAL and n - below[low] <= wanted + IN_INTERVAL or high - low <= tiny:
            return [(low, high, inside)]
        middle = low + 0.4871 * (high - low)
        below[middle] = inertia(matrix, middle)
        return split(middle, high) + split(low, middle)

    return split(floor, top) if reach else []


def contour_pairs(matrix: np.ndarray, low: float, high: float, expected: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues between low and high, and their unit eigenvectors as columns, by FEAST; as many as expected."""
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max())
    points, shares = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = np.exp(1j * np.pi / 2 * (1 - points))  # the upper half circle; the lower one gives the complex conjugate
    resolvents = [(z, w) for z, w in zip(radius * turns, shares)]
    inside, rand = min(n, max(expected + 4, (3 * expected + 1) // 2)), np.random.default_rng(0)
    while True:
        block = rand.standard_normal((n, inside))
        for _ in range(REFINEMENTS):
            image = np.zeros_like(block)
            for turn, share in resolvents:
                image += share / 4 * 2 * np.real(turn * np.linalg.solve((centre + turn) * np.eye(n) - matrix, block.astype(complex)))
            basis, _ = np.linalg.qr(image)
            values, mix = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ mix
            chosen = (values > low) & (values < high)
            residual = np.linalg.norm(matrix @ block[:, chosen] - block[:, chosen] * values[chosen], axis=0)
            if chosen.sum() == expected and (residual <= 32 * EPSILON * norm).all():
                return values[chosen], block[:, chosen]
        if inside == n:
            raise ArithmeticError(f"{chosen.sum()} eigenvalues found between {low} and {high}, {expected} counted")
        inside = min(n, 2 * inside)


def leading_pairs(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; each interval is a task of Spark."""
    intervals = leading_intervals(matrix, wanted)
    if not intervals:
        return np.empty(0), np.empty((len(matrix), 0))
    shared = spark.sparkContext.broadcast(matrix)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for low, high, expected in part.itertuples(index=False):
                values, vectors = contour_pairs(shared.value, low, high, int(expected))
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    rows = spark.createDataFrame(intervals, "low double, high double, expected int").repartition(len(intervals))
    found = rows.mapInPandas(run, "value double, vector array<double>").collect()
    found.sort(key=lambda r: -r.value)
    values = np.array([r.value for r in found[:wanted]])
    # eigenvectors of neighbouring intervals are orthogonal but for rounding over their distance; the last step removes that
    vectors, upper = np.linalg.qr(np.array([r.vector for r in found[:wanted]]).T)
    vectors = vectors * np.where(np.diagonal(upper) < 0, -1.0, 1.0)
    first = np.abs(vectors).round(9).argmax(axis=0)
    return values, vectors * np.where(vectors[first, np.arange(len(values))] < 0, -1.0, 1.0)


# whitening


def _projection(n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
    """x to the projections of x - S/n, each over the root of its eigenvalue; differences are taken before any rounding."""
    whole, part = np.array([s // n for s in sums], np.int64), np.array([float(Fraction(s % n, n)) for s in sums])
    loads = vectors / np.sqrt(values)
    return lambda x: ((x - whole).astype(np.float64) - part) @ loads


def _identity_error(fit: Fit, values: np.ndarray, vectors: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity, measured over that list."""
    n, sums, many = fit.n, fit.sums, len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whiten, total = _projection(n, sums, values, vectors), np.zeros((many, many))
        for whole in _batches(batches):
            white = whiten(whole)  # centred, as x is
            total += white.T @ white
        i, j = np.indices((many, many))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "total"])

    out = np.zeros((many, many))
    for row in fit.vectors.mapInArrow(run, "i bigint, j bigint, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        out[row.i, row.j] = row.total / n
    return float(np.abs(out - np.eye(many)).max())


def deviations(whole: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each vector the sum over dimensions of (n * x - S)^2; null where it fits no long."""
    largest = n * int(np.abs(whole).max(initial=0)) + max(map(abs, sums))
    if largest**2 * whole.shape[1] < 2**63:
        apart = n * whole - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = n * whole.astype(object) - np.array(sums, object)
    return [int(d) if d < 2**63 else None for d in (apart * apart).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row and component: id, component, n (vectors fitted), deviation, whitened, explained, identity_error."""
    rows = vectors.select(plain(id_col).alias("id"), doubles(vectors, vector_col).alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    fit = fit_covariance(rows, scale)
    if fit is None:
        return spark.createDataFrame([], schema)
    values, axes = leading_pairs(spark, fit.covariance, min(components, len(fit.sums)))
    real = values > len(fit.sums) * EPSILON * max(fit.trace, 0.0)
    values, axes = values[real], axes[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    error = _identity_error(fit, values, axes)
    n, sums, trace, many = fit.n, fit.sums, fit.trace, len(values)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _projection(n, sums, values, axes)
        for batch in batches:
            for places, matrix in finite(batch.column(1)):
                if matrix.shape[1] != len(sums):
                    continue
                whole, count = _whole(matrix, scale), len(matrix) * many
                columns = [
                    batch.column(0).take(pa.array(np.repeat(places, many))),
                    pa.array(np.tile(np.arange(1, many + 1), len(matrix)), pa.int32()),
                    pa.array(np.full(count, n), pa.int64()),
                    pa.array(deviations(whole, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(matrix)), many))),
                    pa.array(project(whole).ravel()),
                    pa.array(np.tile(values / trace, len(matrix))),
                    pa.array(np.full(count, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)
