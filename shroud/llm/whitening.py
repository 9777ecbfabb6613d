"""Operator 11: whitening of embeddings by pivoted Cholesky of the centred scatter and one-sided Jacobi on its factor.

Entries become integers x = floor(64 c) + 1,000,000.  Two passes over the vectors gather exact integers, so results do not
depend on how Spark deals the rows: counts and sums; then products of entries that are centred first, at the integer next
to the mean, with the rest of the mean (less than one) taken off exactly at the end.  What is gathered has one entry
per pair of dimensions, summed by pair in Spark, whatever the number of rows.

From the scatter on all is a matrix of dims x dims on the driver.  Cholesky with pivoting gives a triangular factor;
one-sided Jacobi rotates the factor's columns, many disjoint pairs at once, until they are orthogonal: their squared norms
are the scatter's eigenvalues and the columns, normalised, its eigenvectors.  The scatter is never rotated itself, so
small eigenvalues keep their relative precision.  Another pass projects every row, and one more measures the covariance of
what came out.

Defined results: a null vector, or one that holds a null, NaN or infinite entry (or one beyond 1e150, whose square
is close to infinite), is left out.  Ids are carried along, null
or repeated ones too; a repeated row counts each time.  Vectors of different lengths go on with entries of zero.  Equal
eigenvalues: any orthogonal choice, the same for all rows.  Directions without variance (one row, equal rows, fewer rows
than dimensions; less than 1e-13 of the largest pivot) have no component, so an empty table, one row or empty vectors give no rows.  A deviation beyond 63 bits is null.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
ROWS = 1024  # vectors handled at once
EXACT = 1 << 53  # integers below are exact as double
SMALL = 1 << 42  # a batch of integers below adds up within 53 bits
LARGEST = 1e150
LIMB = 32  # bits
RANK = 1e-13  # a pivot below this share of the largest one has no variance left
SWEEPS, ORTHOGONAL = 60, 1e-15
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def remaining(df: DataFrame, vector_col: str) -> Column:
    fine = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST))
    return F.col(vector_col).isNotNull() & F.coalesce(fine, F.lit(False))


def matrices(batch: pa.RecordBatch, column: int, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, its integer entries without the shift and up to ``ROWS - 1`` following rows') of a batch."""
    for at in range(0, batch.num_rows, ROWS):
        lists = batch.column(column).slice(at, ROWS)
        length = np.diff(lists.offsets.to_numpy())
        values = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        kind = np.int64 if not len(values) or np.abs(values).max() < SMALL else object
        x = np.zeros((len(lists), dims), kind)
        x[np.arange(dims) < length[:, None]] = values.astype(np.int64) if kind is np.int64 else [int(v) for v in values]
        yield at, x


def product(z: np.ndarray) -> np.ndarray:
    """z' z, exact: in doubles where every sum stays below 2^53, else in integers without limit."""
    top = int(np.abs(z).max(initial=0))
    if top * top * max(1, len(z)) < EXACT:
        d = z.astype(np.float64)
        return (d.T @ d).astype(np.int64)
    wide = z.astype(object)
    return wide.T @ wide


def _summed(df: DataFrame, vector_col: str, dims: int, figures, pairs: int) -> list[int]:
    """Sums over all rows of integer ``figures`` (matrix -> ``pairs`` integers): added up per task, then by index.  An
    integer of any size travels as limbs of 32 bits, whose sums stay within a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(pairs, object)
        for batch in batches:
            for _, x in matrices(batch, 0, dims):
                total = total + figures(x)
        index, limb, value = [], [], []
        for k in np.flatnonzero(total).tolist():
            rest, sign = abs(int(total[k])), 1 if total[k] > 0 else -1
            for place in range(-(-rest.bit_length() // LIMB)):
                index.append(k)
                limb.append(place)
                value.append(sign * (rest >> place * LIMB & (1 << LIMB) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["k", "limb", "v"])

    parts = df.select(vector_col).mapInArrow(run, "k long, limb int, v long")
    out = [0] * pairs
    for r in parts.groupBy("k", "limb").agg(F.sum("v").alias("v")).collect():  # a few rows per pair of dimensions
        out[r["k"]] += r["v"] << r["limb"] * LIMB
    return out


def exact_scatter(df: DataFrame, vector_col: str) -> tuple[int, list[int], list[list[Fraction]]]:
    """(n, sums per dimension of floor(64 c), scatter around the mean), all exact."""
    shape = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_col)).alias("dims")).first()
    n, dims = shape["n"], shape["dims"] or 0
    if not n or not dims:
        return n, [], []
    sums = _summed(df, vector_col, dims, lambda x: x.sum(axis=0).astype(object), dims)
    near = [(2 * s + n) // (2 * n) for s in sums]  # the integer next to the mean
    kind = np.int64 if max(map(abs, near)) < SMALL else object
    centre = np.array(near, kind)
    upper = np.triu_indices(dims)
    products = _summed(df, vector_col, dims, lambda x: product(x - centre)[upper].astype(object), len(upper[0]))
    left = [s - n * c for s, c in zip(sums, near)]  # what the centred entries sum to
    scatter = [[Fraction(0)] * dims for _ in range(dims)]
    for i, j, p in zip(*upper, products):
        scatter[i][j] = scatter[j][i] = p - Fraction(left[i] * left[j], n)
    return n, sums, scatter


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L', the rows in a's order: columns by falling pivot, as many as ``a`` has rank."""
    rest, columns = a.astype(float).copy(), []
    first = rest.diagonal().max(initial=0.0)
    while len(columns) < len(a):
        p = int(np.argmax(rest.diagonal()))
        if rest[p, p] <= RANK * first:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        columns.append(column)
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0
    return np.stack(columns, axis=1) if columns else np.zeros((len(a), 0))


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of factor factor', falling: columns are rotated in pairs until orthogonal.
    A round rotates disjoint pairs together; the rounds of a sweep, dealt as in a tournament, meet every pair once."""
    g = factor.copy()
    k = g.shape[1]
    players = np.arange(k + k % 2)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(1, len(players) - 1)):
            one, two = players[:len(players) // 2], players[len(players) // 2:][::-1]
            real = (one < k) & (two < k)
            i, j = one[real], two[real]
            a, b = (g[:, i] ** 2).sum(axis=0), (g[:, j] ** 2).sum(axis=0)
            c = (g[:, i] * g[:, j]).sum(axis=0)
            size = np.abs(c) / np.sqrt(np.maximum(a * b, np.finfo(float).tiny))
            worst = max(worst, float(size.max(initial=0)))
            turn = size > ORTHOGONAL
            zeta = (b - a) / np.where(turn, 2 * c, 1)
            tan = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            cos = 1 / np.hypot(1, tan)
            sin = cos * tan
            g[:, i], g[:, j] = cos * g[:, i] - sin * g[:, j], sin * g[:, i] + cos * g[:, j]
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if worst <= ORTHOGONAL * 16:
            break
    norms = np.sqrt((g ** 2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


@dataclass
class Whitening:
    """What every task needs: dims x components numbers, whatever the number of rows."""

    n: int
    sums: list[int]  # of floor(64 c) by dimension
    basis: np.ndarray  # components as columns, each over the root of its eigenvalue
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of floor(64 c) whitened: centred (whole part exactly) before they are multiplied."""
        whole = [s // self.n for s in self.sums]
        whole = np.array(whole, np.int64 if max(map(abs, whole)) < SMALL else object)
        part = np.array([s % self.n / self.n for s in self.sums])
        return ((x - whole).astype(np.float64) - part) @ self.basis

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2; the shift of x cancels."""
        top = (int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))) if len(x) else 0
        kind = np.int64 if top * top * len(self.sums) < 1 << 63 else object
        y = self.n * x.astype(kind) - np.array(self.sums, kind)
        return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]


def fit(df: DataFrame, vector_col: str, components: int = COMPONENTS) -> Whitening | None:
    """Eigenvalues are those of the covariance: scatter over n."""
    n, sums, scatter = exact_scatter(df, vector_col)
    trace = sum((scatter[i][i] for i in range(len(scatter))), Fraction(0))
    if not trace:
        return None
    shares = np.array([[float(v / trace) for v in row] for row in scatter])  # the covariance over its trace
    values, vectors = one_sided_jacobi(pivoted_cholesky(shares))
    values, vectors = values[:components], vectors[:, :components]
    return Whitening(n, sums, vectors / np.sqrt(values * float(trace / n)), values)


def identity_error(df: DataFrame, vector_col: str, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity, from the rows themselves."""
    k, dims = model.basis.shape[1], len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for _, x in matrices(batch, 0, dims):
                w = model.project(x)
                total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["k", "v"])

    total = np.zeros((k + 1) * k)
    sums = df.select(vector_col).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
    for r in sums.collect():  # (components + 1) * components rows
        total[r["k"]] = r["v"]
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every remaining row and component."""
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {RESULT}"
    rows = df.select(id_col, vector_col).where(remaining(df, vector_col))
    model = fit(rows, vector_col, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, vector_col, model)
    k, dims = model.basis.shape[1], len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch, 1, dims):
                m = len(x)
                row = pa.array(np.repeat(np.arange(at, at + m), k))
                deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation,
                     pa.array(model.project(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))],
                    [id_col, *(c.split()[0] for c in RESULT.split(", "))])

    return rows.mapInArrow(run, schema)
