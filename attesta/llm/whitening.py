"""Whitening of embeddings by shifted CholeskyQR.

Every entry becomes a whole number, floor(scale * c) + offset, and the fit uses each distinct vector of whole numbers once.  The
centred fit rows A are never factored in one place: a pass over them yields their Gram matrix (d x d, one partial sum a task), its
Cholesky factor R1 after a small shift turns the rows into A R1^-1 by triangular solves inside the tasks, and further passes do the
same to the turned rows until their Gram matrix is the identity to rounding.  The composed factor R = Rk ... R1 has A's
singular values and right singular vectors, to double precision even where A's Gram matrix alone would lose half the digits;
its SVD gives the components.

Only matrices of d x d numbers and sums of d numbers reach the driver, so d is to be some thousands at most; rows stay distributed,
and the only shuffle is the one that finds the distinct vectors (combined map-side, so a hot vector costs nothing).

Rows whose vector is null, empty, or holds null or non-finite entries take no part; neither do those with an entry of 2^31 or more
after scaling, which have no exact sums.  Vectors of different lengths are different tables: each length is fitted by itself.
Repeated rows and null or repeated ids stay, each with its own result.  An empty table gives none.  Where the fit
rows leave a component without variance (a constant dimension, fewer rows than dimensions), it has ``explained`` 0 and ``whitened``
null; ``identity_error`` is over the others.  A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import written

#: Passes at most, and the share of the largest singular value below which a direction has no variance.
PASSES, NOTHING = 8, 1e-12
LIMIT = float(1 << 31)
_EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitener:
    """n, sums per dimension, components as columns, and their eigenvalues."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    total: float
    identity_error: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centred(x) @ self.components / np.sqrt(self.values), np.nan)


def whole(vec: Column, scale: int, offset: int) -> Column:
    """The whole-number vector, null where the vector takes no part."""
    ok = F.forall(vec, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double") * scale) < LIMIT), F.lit(False)))
    return F.when(F.coalesce(ok & (F.size(vec) > 0), F.lit(False)), F.transform(vec, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long")))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(fit: DataFrame, part, size: int) -> np.ndarray:
    """Sum over all tasks of the float array that ``part`` makes of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                total += part(matrix(batch.column(0).slice(a, 4096)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["cell", "x"])

    out = np.zeros(size)
    for r in fit.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():  # size rows
        out[r.cell] = r.x
    return out


def solve_right(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``factor``, by substitution."""
    out = np.empty_like(rows)
    for j in range(factor.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def gram_pass(fit: DataFrame, n: int, sums: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the centred rows after the triangular solves with ``factors``: upper triangles summed over the tasks."""
    d = len(sums)
    upper = np.triu_indices(d)

    def part(x: np.ndarray) -> np.ndarray:
        rows = (n * x - sums) / n
        for f in factors:
            rows = solve_right(rows, f)
        return (rows.T @ rows)[upper]

    gram = np.zeros((d, d))
    gram[upper] = _summed(fit, part, len(upper[0]))
    return gram + np.triu(gram, 1).T


def triangular_factor(fit: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, int]:
    """(R, passes) with R^T R the Gram matrix of the centred rows, from shifted and then plain CholeskyQR passes."""
    d = len(sums)
    gram = gram_pass(fit, n, sums, [])
    size = np.linalg.norm(gram, 2)
    if size == 0:
        return np.zeros((d, d)), 1
    shift = 11 * (n * d + d * (d + 1)) * _EPS / 2 * size
    factors = [np.linalg.cholesky(gram + shift * np.eye(d)).T]
    composed = factors[0]
    for passes in range(2, PASSES + 1):
        gram = gram_pass(fit, n, sums, factors)
        value, vector = np.linalg.eigh(gram)
        if value[0] < 1e-8:
            # directions without variance stay empty after the shift: the root of what is there ends the chain
            return np.sqrt(np.maximum(value, 0))[:, None] * vector.T @ composed, passes
        factors.append(np.linalg.cholesky(gram).T)
        composed = factors[-1] @ composed
        if np.abs(gram - np.eye(d)).max() <= 64 * d * _EPS:
            break
    return composed, passes


def fit_whitener(fit: DataFrame, dims: int, keep: int) -> Whitener:
    """The ``keep`` components of largest variance of the distinct whole-number vectors in the column ``x``."""

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims + 1, np.int64), 0
        for batch in batches:
            total[:dims] += matrix(batch.column(0)).sum(0) if batch.num_rows else 0
            n += batch.num_rows
        total[dims] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(total)], names=["cell", "x"])

    whole_sums = np.zeros(dims + 1, np.int64)
    for r in fit.mapInArrow(sums_of, "cell long, x long").groupBy("cell").agg(F.sum("x").alias("x")).collect():  # dims + 1 rows
        whole_sums[r.cell] = r.x
    n, sums = int(whole_sums[dims]), whole_sums[:dims]
    factor, passes = triangular_factor(fit, n, sums)
    _, root, turned = np.linalg.svd(factor)
    root = np.where(root > NOTHING * max(root[0], 0.0), root, 0.0)
    values, components = root ** 2 / n, turned.T
    total, values, components = float(values.sum()), values[:keep], np.ascontiguousarray(components[:, :keep])
    found = Whitener(n, sums, components, values, total, 0.0, passes)
    k = int((values > 0).sum())
    error = 0.0
    if k:
        def part(x: np.ndarray) -> np.ndarray:
            z = found.whiten(x)[:, :k]
            return (z.T @ z).ravel()

        error = float(np.abs(_summed(fit, part, k * k).reshape(k, k) / n - np.eye(k)).max())
    return Whitener(n, sums, components, values, total, error, passes)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact sums of (n x - S)^2 over the dimensions; null where they exceed 64 bits."""
    apart = n * x - sums
    if not apart.size or float(np.abs(apart).max()) ** 2 * x.shape[1] < 2.0 ** 62:
        return pa.array((apart * apart).sum(1))
    exact = [sum(v * v for v in row) for row in apart.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(df: DataFrame, keep: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and each of the ``keep`` first components."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = df.select(F.col(id_col), whole(F.col(vec_col), scale, offset).alias("x")).where("x IS NOT NULL")
    distinct = written(rows.select("x").distinct(), "whitening-fit")
    out = None
    for dims in [r.d for r in distinct.groupBy(F.size("x").alias("d")).count().orderBy("d").collect()]:  # one row a vector length
        found = fit_whitener(distinct.where(F.size("x") == dims), dims, min(keep, dims))
        part = rows.where(F.size("x") == dims).mapInArrow(_apply(found, id_col), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def _apply(found: Whitener, id_col: str):
    k = len(found.values)
    explained = found.values / found.total if found.total > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                piece = batch.slice(a, 4096)
                x = matrix(piece.column(1))
                m = len(x)
                row = np.repeat(np.arange(m), k)
                z = found.whiten(x).ravel()
                yield pa.RecordBatch.from_arrays([
                    piece.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n)),
                    deviations(x, found.n, found.sums).take(pa.array(row)), pa.array(z, mask=np.isnan(z)), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, found.identity_error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run
