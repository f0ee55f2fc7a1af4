"""Whitening of embeddings by contour integration.

The covariance of the distinct vectors is summed up by the tasks, one matrix of the
dimension's size each.  Its largest eigenvalues are bracketed by inertia: the signs of the
pivots of a shifted matrix say how many eigenvalues lie above the shift.  A circle around
that interval is integrated along: solves with the covariance shifted by complex points
project onto the space of the eigenvalues inside, and Rayleigh-Ritz extracts them there.
The number found must be the inertia count, else the space is enlarged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reqsift.llm.vectors import matrix, whole
from reqsift.workspace import materialize

#: Points of the quadrature on the upper half of the circle, and most rounds of projection.
POINTS, ROUNDS = 8, 40
#: Share of the trace below which an eigenvalue counts as none.
NOTHING = 1e-12


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` exceed ``shift``, from the signs of pivots.

    Pivots are single entries or blocks of two, whichever is larger (Bunch and Parlett).
    """
    m = a - shift * np.eye(len(a))
    count, ratio = 0, (1 + math.sqrt(17)) / 8
    while len(m):
        diagonal = np.abs(np.diag(m))
        k = int(diagonal.argmax())
        off = np.abs(m)
        np.fill_diagonal(off, 0)
        i, j = divmod(int(off.argmax()), len(m))
        if diagonal[k] >= ratio * off[i, j]:
            if diagonal[k] == 0:
                return count
            pivot, rest = [k], [r for r in range(len(m)) if r != k]
            count += bool(m[k, k] > 0)
        else:
            # The block's determinant is negative: one eigenvalue on either side.
            pivot, rest = [i, j], [r for r in range(len(m)) if r not in (i, j)]
            count += 1
        side = m[np.ix_(rest, pivot)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(m[np.ix_(pivot, pivot)], side.T)
        m = (m + m.T) / 2
    return count


def bracket(a: np.ndarray, rank: int, low: float, high: float) -> tuple[float, float]:
    """Two shifts closely around the eigenvalue of that rank, counted from the largest."""
    for _ in range(60):
        if high - low <= 1e-4 * high:
            break
        middle = (low + high) / 2
        low, high = (middle, high) if above(a, middle) >= rank else (low, middle)
    return low, high


def eigenpairs(a: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``a`` in ``(low, high)``, falling, and their unit vectors as columns."""
    wanted = above(a, low) - above(a, high)
    n = len(a)
    x, w = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(0.5j * math.pi * (1 + x))
    centre, radius = (low + high) / 2, (high - low) / 2
    size = min(n, wanted + max(4, wanted // 2))
    while True:
        basis = np.random.default_rng(n).standard_normal((n, size))
        best, found = np.inf, None
        for _ in range(ROUNDS):
            space = sum(
                0.5 * weight * np.real(radius * t * np.linalg.solve((centre + radius * t) * np.eye(n) - a, basis))
                for weight, t in zip(w, turn)
            )
            q, _ = np.linalg.qr(space)
            values, inner = np.linalg.eigh(q.T @ a @ q)
            basis = q @ inner
            inside = (values > low) & (values < high)
            if inside.sum() != wanted:
                continue
            error = np.abs(a @ basis[:, inside] - basis[:, inside] * values[inside]).max(initial=0)
            if error >= best / 2 and best < 1e-10 * high:
                break
            if error < best:
                best, found = error, (values[inside][::-1], basis[:, inside][:, ::-1])
        if found is not None and best < 1e-10 * high:
            return found
        if size == n:
            raise ArithmeticError("eigenvalues and inertia disagree")
        size = min(n, 2 * size)


def principal(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a positive semidefinite matrix, falling, with vectors."""
    trace = float(np.trace(a))
    if trace <= 0:
        return np.zeros(0), np.zeros((len(a), 0))
    scaled = a / trace
    most = min(most, above(scaled, NOTHING))
    last, _ = bracket(scaled, most, 0.0, 1.0)
    _, top = bracket(scaled, 1, last, 1.0 + 1e-9)
    inside = above(scaled, last)
    # The circle crosses the line between the last eigenvalue inside and the next one.
    low = last
    if inside < len(a):
        _, after = bracket(scaled, inside + 1, 0.0, last)
        low = (last + after) / 2
    values, vectors = eigenpairs(scaled, min(low, last), top * 1.01)
    return values[:most] * trace, vectors[:, :most]


class Whitening:
    """What ``fit`` learned: number of vectors, exact sums, eigenvalues, vectors, trace."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on the components, each of variance one."""
        return centred(x, self.n, self.sums) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 per row, exact; null where a long can't hold it."""
        if _fits(x, self.n, self.sums, 2):
            off = self.n * x - np.asarray(self.sums, dtype=np.int64)
            return np.einsum("ij,ij->i", off, off).tolist()
        off = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        exact = (off * off).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]


def _fits(x: np.ndarray, n: int, sums: list[int], power: int) -> bool:
    largest = n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
    return largest**power * max(1, x.shape[1]) < 2.0**62


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, in doubles."""
    if _fits(x, n, sums, 1):
        return (n * x - np.asarray(sums, dtype=np.int64)) / n
    return x.astype(np.float64) - np.array([s / n for s in sums])


def _summed(fit: DataFrame, size: int, part) -> np.ndarray:
    """Sum over all rows of the square matrices ``part(x)`` of a batch ``x``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                total += part(matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size * size, dtype=np.int64)), pa.array(total.ravel())], names=["at", "value"]
        )

    cells = fit.select("x").mapInArrow(work, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(size * size)
    for at, value in cells.collect():
        out[at] = value
    return out.reshape(size, size)


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """Components of the rows ``x`` of a table of distinct vectors; none if there are no rows."""
    cells = vectors.select(F.posexplode("x").alias("at", "value")).groupBy("at").agg(
        F.sum(F.col("value").cast("decimal(20,0)")).alias("sum"), F.count("*").alias("n")
    )
    # One row per dimension, and one matrix of the dimension's size, come to the driver.
    rows = sorted(cells.collect())
    if not rows:
        return None
    n, sums = rows[0]["n"], [int(r["sum"]) for r in rows]

    def part(x: np.ndarray) -> np.ndarray:
        off = centred(x, n, sums)
        return off.T @ off

    cov = _summed(vectors, len(sums), part) / n
    cov = (cov + cov.T) / 2
    values, axes = principal(cov, components)
    return Whitening(n, sums, values, axes, float(np.trace(cov)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    size = len(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = np.concatenate([model.whiten(x), np.ones((len(x), 1))], axis=1)
        return w.T @ w

    total = _summed(vectors, size + 1, part) / model.n
    mean = total[:size, size]
    return float(np.abs(total[:size, :size] - np.outer(mean, mean) - np.eye(size)).max(initial=0))


def whitened(rows: DataFrame, components: int = 4) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    One row per row of ``rows(vec_id, embedding, …)`` that takes part (see ``vectors.whole``)
    and per component, numbered from 1 by falling eigenvalue of the covariance of the
    distinct vectors.  Directions without variance are no components, so a table of equal
    vectors, or an empty one, has no rows.  ``deviation`` is the exact sum of (n x - S)^2,
    null where a long can't hold it.  Null and repeated ids are kept as they come; other
    columns are ignored.
    """
    taken = whole(rows, F.col("vec_id").cast("long").alias("vec_id"))
    distinct = materialize(taken.select("x").distinct())
    model = fit(distinct, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model)
    count = len(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            row = np.repeat(np.arange(len(x)), count)
            columns = {
                "vec_id": batch.column(0).take(pa.array(row)),
                "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(row), model.n)),
                "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(row)),
                "whitened": pa.array(model.whiten(x).ravel()),
                "explained": pa.array(np.tile(model.values / model.trace, len(x))),
                "identity_error": pa.array(np.full(len(row), error)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return taken.select("vec_id", "x").mapInArrow(work, schema)
