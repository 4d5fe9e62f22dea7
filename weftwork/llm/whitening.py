"""Embedding whitening: exact distributed covariance, float32 eigenvectors refined by Ogita-Aishima iterations in extended precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.llm.common import col, free, query, read, stage

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROUNDS = 50
EXACT = 1 << 53     # integers up to here are exact in double precision
FULL = 1 << 62      # sums are sent on before they can leave a long
_LENGTHS = "vectors of different lengths cannot be whitened together"


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def integers(column: pa.Array, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """floor(scale · c) + shift of an Arrow column of equally long vectors, as a matrix of longs."""
    flat = scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(1, len(column))
    if len(flat) != width * len(column) or any(n != width for n in column.value_lengths().unique().to_pylist()):
        raise ValueError(_LENGTHS)
    if len(flat) and np.abs(flat).max() >= FULL:
        raise ValueError(f"an entry times {scale} does not fit a long")
    return np.floor(flat).astype(np.int64).reshape(len(column), width) + shift


def _summed(rows: DataFrame, vector: str, name: str, per_row) -> list:
    """Exact sums over all rows of what ``per_row`` gives a block of vectors: cells (i, j, longs), a decimal each, on the driver.

    A task sends one row a cell, so the driver gets cells of one matrix, never rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in per_row(integers(batch.column(0)) for batch in batches):
            i, j = np.nonzero(np.ones(held.shape, bool))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(held.ravel(), pa.int64())], names=["i", "j", "s"])

    cells = rows.select(col(vector)).mapInArrow(run, "i int, j int, s bigint")
    return stage(cells.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), name).collect()


def _sums(blocks):
    """For each dimension its sum and the number of vectors that have it."""
    total, bound = None, 0
    for x in blocks:
        big = int(np.abs(x).max(initial=1)) * max(1, len(x))
        if big >= FULL:
            raise ValueError("an entry is too large for exact sums")
        if total is None or len(total) != x.shape[1]:
            if total is not None:
                yield total
            total = np.zeros((x.shape[1], 2), np.int64)
        if bound + big >= FULL:
            yield total
            total, bound = np.zeros_like(total), 0
        total[:, 0] += x.sum(0)
        total[:, 1] += len(x)
        bound += big
    if total is not None:
        yield total


def _products(centre: np.ndarray):
    """Upper triangle of y yᵀ and, in the last column, y, where y is a vector minus ``centre`` (longs); all exact."""
    def run(blocks):
        total, bound = np.zeros((len(centre), len(centre) + 1), np.int64), 0
        for x in blocks:
            y = x - centre
            big = int(np.abs(y).max(initial=1))
            if big * big >= EXACT:
                raise ValueError("an entry is too far from the mean for exact products")
            step = max(1, EXACT // (big * big))
            for at in range(0, len(y), step):   # so few rows that their products are exact in double precision
                part = y[at:at + step].astype(np.float64)
                if bound + EXACT >= FULL:
                    yield total
                    total, bound = np.zeros_like(total), 0
                total[:, :-1] += (part.T @ part).astype(np.int64)
                total[:, -1] += part.sum(0).astype(np.int64)
                bound += EXACT
        yield total
    return run


def covariance(rows: DataFrame, vector: str) -> tuple[int, list[int], np.ndarray]:
    """(n, sums S a dimension, covariance with divisor n) of the integer vectors, in extended precision.

    Vectors are centred at the rounded mean before they are multiplied; what rounding leaves of the mean is taken out of
    integer sums, which are exact. So the matrix does not depend on how rows are dealt, and has no cancellation.
    """
    sums = {(r.i, r.j): int(r.s) for r in _summed(rows, vector, "sums", _sums)}
    if not sums:
        return 0, [], np.zeros((0, 0), np.longdouble)
    total, counts = [[sums[i, j] for i in range(len(sums) // 2)] for j in (0, 1)]
    n = counts[0]
    if set(counts) != {n}:
        raise ValueError(_LENGTHS)
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    size = len(total)
    cells = {(r.i, r.j): int(r.s) for r in _summed(rows, vector, "products", _products(centre))}
    rest = [cells[i, size] for i in range(size)]
    v = np.zeros((size, size), np.longdouble)
    for i in range(size):
        for j in range(size):
            exact = n * cells[i, j] - rest[i] * rest[j]          # n² times the covariance, a whole number
            v[i, j] = np.longdouble(exact // (n * n)) + np.longdouble(exact % (n * n)) / np.longdouble(n * n)
    return n, total, v


def _clusters(values: np.ndarray, gap) -> list[np.ndarray]:
    """Places of ``values`` in runs whose neighbours, in falling order, are no more than ``gap`` apart; runs of two or more."""
    order = np.argsort(-values, kind="stable")
    runs = np.split(order, np.flatnonzero(-np.diff(values[order]) > gap) + 1)
    return [r for r in runs if len(r) > 1]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: better (eigenvectors, eigenvalues) from approximate ones ``x``, and the size of the correction.

    The residuals of orthogonality and of diagonality, two matrix products each, give the first-order correction X + XE. Columns whose
    eigenvalues are closer than the residuals can tell apart are only made orthogonal.
    """
    eye = np.eye(len(a), dtype=a.dtype)
    r = eye - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    size = np.abs(a).sum(1).max()
    delta = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + size * np.linalg.norm(r.astype(float)))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > delta
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
    return x + x @ e, values, float(np.abs(e).max())


def sub_solve(a: np.ndarray, x: np.ndarray, gap: float) -> np.ndarray:
    """Turn the columns of each cluster of eigenvalues closer than ``gap`` to the eigenvectors of the matrix restricted to them.

    The restricted matrix is shifted by the cluster's mean in extended precision first, so that what is left
    are the cluster's own differences, which double precision then tells apart.
    """
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    x = x.copy()
    for place in _clusters(values, gap):
        part = x[:, place]
        mean = values[place].mean()
        inner = part.T @ (a @ part) - mean * (part.T @ part)
        inner = (inner + inner.T) / 2
        size = np.abs(inner).max()
        if size > 0:
            x[:, place] = part @ np.linalg.eigh((inner / size).astype(np.float64))[1].astype(x.dtype)
    return x


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision.

    Start: float32. Each round solves clusters on their own, then corrects all vectors. It ends when the correction
    is below double precision or no longer falls. The largest entry of each vector is positive.
    """
    size = np.abs(v).max(initial=0)
    if not len(v) or size == 0:
        return np.zeros(len(v)), np.eye(len(v))
    a = ((v + v.T) / 2 / size).astype(np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    best, loose = np.inf, np.sqrt(np.finfo(np.float32).eps)
    for _ in range(ROUNDS):
        x, values, change = refine(a, sub_solve(a, x, loose))
        loose = max(min(loose, change), np.finfo(np.float64).eps)
        if change < np.finfo(np.float64).eps / 16 or (change < 1e-12 and change >= best):
            break
        best = min(best, change)
    for _ in range(2):   # what clusters leave of orthogonality
        x = x + x @ (np.eye(len(a), dtype=a.dtype) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    lead = x[np.abs(x).argmax(0), np.arange(len(x))]
    return (values * size).astype(np.float64), (x * np.where(lead < 0, -1, 1)).astype(np.float64)


def whiten(rows: DataFrame, vector="embedding", components: int = COMPONENTS) -> DataFrame:
    """The usable rows of ``rows`` with ``n``, ``deviation``, ``whitened`` and ``explained`` (arrays, component 1 first) added last.

    Rows whose vector is NULL, empty or holds a NULL or non-finite entry are left out. The others are all fitted, repeated rows too. Entries
    become whole numbers, floor(1024 c) + 100000. ``whitened`` is the centred vector on each eigenvector of the covariance by falling
    eigenvalue, over the root of the eigenvalue; components without variance (rank below ``components``, one row, equal rows) are left out.
    ``deviation`` is the exact sum of (n x - S)² and an error if it does not fit a long. Vectors of different lengths are an error.
    An empty table, and one without a usable row, give no rows. A clashing column keeps its name.

    The driver holds one matrix of the dimension's square. Rows are read three times and never shuffled.
    """
    fit = rows.where(usable(col(vector)))
    n, total, v = covariance(fit, vector)
    values, vectors = eigen(v)
    trace = float(np.trace(v)) if len(v) else 0.0
    keep = int(np.count_nonzero(values[:components] > len(values) * np.finfo(np.float64).eps * max(trace, 0.0)))
    weights = vectors[:, :keep] / np.sqrt(values[:keep])
    sums = np.array(total, object)

    def run(column: pa.Array) -> pa.Array:
        x = integers(column)
        d = n * x.astype(object) - sums if n * int(np.abs(x).max(initial=1)) >= FULL else n * x - sums.astype(np.int64)
        near = int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < FULL
        squares = (d * d if near else d.astype(object) ** 2).sum(1)
        if not near and len(squares) and max(squares) >= 1 << 63:
            raise OverflowError("the deviation does not fit a long")
        y = (d.astype(np.float64) / n) @ weights
        offsets = pa.array(np.arange(0, keep * len(y) + 1, keep) if keep else np.zeros(len(y) + 1), pa.int32())
        return pa.StructArray.from_arrays([pa.array(squares.tolist(), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(y.ravel(), pa.float64()))],
                                          ["deviation", "whitened"])

    w = free(rows, "_white")
    explained = F.array(*[F.lit(float(e / trace)) for e in values[:keep]]).cast("array<double>")
    made = F.arrow_udf(run, "deviation bigint, whitened array<double>")(col(vector))
    return fit.withColumn(w, made).select(*[col(c) for c in rows.columns], F.lit(n).cast("bigint").alias(free(rows, "n")), F.col(w)["deviation"].alias(free(rows, "deviation")),
                                          F.col(w)["whitened"].alias(free(rows, "whitened")), explained.alias(free(rows, "explained")))


def identity_error(white: DataFrame, whitened="whitened") -> float:
    """Largest absolute entry of the covariance (divisor n, centred) of an array column minus the identity; 0 without components.

    Means come from a first pass, products of centred values from a second; both are sums inside tasks first.
    """
    size = white.agg(F.max(F.size(col(whitened)))).first()[0] or 0
    if size <= 0:
        return 0.0
    parts = [F.get(col(whitened), i) for i in range(size)]
    means = white.agg(*[F.avg(p) for p in parts]).first()
    centred = [p - F.lit(m) for p, m in zip(parts, means)]
    cells = {(i, j): F.avg(centred[i] * centred[j]) for i in range(size) for j in range(i, size)}
    got = white.agg(*[c.alias(f"c{i}_{j}") for (i, j), c in cells.items()]).first()
    return max(abs(g - (i == j)) for g, (i, j) in zip(got, cells))


@query("op12_refined_whitening")
def op12(spark, root):
    white = stage(whiten(read(spark, root, "embeddings").select("vec_id", "embedding")).drop("embedding"), "whitened")
    error = identity_error(white)
    one = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return (white.select("vec_id", "n", "deviation", one)
            .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c")["whitened"].alias("whitened"),
                    F.col("c")["explained"].alias("explained"), F.lit(error).alias("identity_error")))
