"""Embedding whitening by QDWH spectral divide and conquer.

Spark does what grows with the table: vectors become integers, each distinct vector is kept once
(the fit list, written down), and its sums and centred products are added up per task, then
by about the square root of as many tasks, so the driver receives few small matrices.  All counts and
sums of integers are exact.

The covariance is a matrix of dimension x dimension, whatever the table's size; it is taken
apart where it is.  For a shift s, the QR-based dynamically weighted Halley iteration gives
the unitary polar factor U of V - sI; (U + I) / 2 projects on the subspace of eigenvalues
above s.  An orthonormal basis of it and of its complement cuts the matrix into two
smaller ones, which are cut again until single components are left; parts that hold none of the
greatest components asked for are not cut further.  The components are broadcast and whiten all rows.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are left
out; so are vectors whose length is not the one most rows have (of equals, the longer);
equal vectors count once in the fit list and each of their rows is returned; a component without
variance (eigenvalue not above rounding) cannot be whitened and is not returned, so constant tables
and a single vector give no rows, as do empty tables; ``deviation`` is null where it does not fit
64 bits; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_fold, arrow_map, stored

COMPONENTS = 4
SCALE = 256
EPS = np.finfo(np.float64).eps
LONG_MAX = 2**63 - 1


# --- the matrix ---------------------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix, by QR-based dynamically weighted Halley."""
    d = len(a)
    x = a / max(np.linalg.norm(a, 2), np.finfo(np.float64).tiny)
    low = max(np.linalg.norm(x, -2) / 1.1, EPS)  # a lower bound of the least singular value
    while True:
        # Weights that lift the least singular value the most in one step.
        square = low * low
        c0 = (4 * max(1 - square, 0.0) / (square * square)) ** (1 / 3)
        root = math.sqrt(1 + c0)
        wa = root + 0.5 * math.sqrt(max(8 - 4 * c0 + 8 * (2 - square) / (square * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, np.eye(d)]))
        step = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:d] @ q[d:].T)
        step = (step + step.T) / 2
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        moved = np.linalg.norm(step - x)
        x = step
        if moved <= (4 * EPS) ** (1 / 3) * np.linalg.norm(x) and 1 - low <= 10 * EPS:
            return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement."""
    columns = np.argsort(-np.einsum("ij,ij->j", projector, projector), kind="stable")
    basis, _ = np.linalg.qr(projector[:, columns[:rank]])
    # Once more from the range, with all columns mixed in, against a poor choice of them.
    mixed = np.random.default_rng(rank).standard_normal((len(projector), rank))
    basis, _ = np.linalg.qr(projector @ (basis + 1e-3 * mixed))
    full, _ = np.linalg.qr(basis, mode="complete")
    return full[:, :rank], full[:, rank:]


def spectral_components(v: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix: the
    ``wanted`` greatest, or all."""
    scale = np.linalg.norm(v)

    def split(a: np.ndarray, basis: np.ndarray, need: int) -> list[tuple[float, np.ndarray]]:
        d = len(a)
        if need <= 0 or d == 0:
            return []
        mean = np.trace(a) / d
        if d == 1 or np.linalg.norm(a - mean * np.eye(d)) <= d * EPS * scale:
            return [(float(a[k, k]), basis[:, k]) for k in range(d)][:need]
        # The median halves the work.  A shift that hits an eigenvalue does not separate, which
        # shows in what is left between the two sides; then others are tried.
        values = np.diag(a)
        low, high = values.min(), values.max()
        tries = [np.median(values), mean, *(low + (high - low) * np.arange(1, 16, 2) / 16),
                 *(mean + np.linalg.norm(a - mean * np.eye(d)) * 0.3 ** np.arange(1, 30))]
        best = None
        for shift in tries:
            projector = (polar_factor(a - shift * np.eye(d)) + np.eye(d)) / 2
            rank = round(float(np.trace(projector)))
            if not 0 < rank < d:
                continue
            upper, lower = _bases(projector, rank)
            left = np.linalg.norm(lower.T @ a @ upper)
            if best is None or left < best[0]:
                best = left, upper, lower
            if left <= 4 * d * EPS * scale:
                break
        if best is None:
            raise ArithmeticError("no shift separates the spectrum")
        _, upper, lower = best
        found = split(_symmetric(upper.T @ a @ upper), basis @ upper, need)
        return found + split(_symmetric(lower.T @ a @ lower), basis @ lower, need - len(found))

    found = split(_symmetric(v), np.eye(len(v)), len(v) if wanted is None else wanted)
    found.sort(key=lambda pair: -pair[0])
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    vectors = np.column_stack([vector for _, vector in found])
    vectors /= np.linalg.norm(vectors, axis=0)
    return np.einsum("ij,ik,kj->j", vectors, v, vectors), vectors


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


# --- the table ------------------------------------------------------------------

def integer_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that remain, their entries as integers."""
    c = F.col(vector)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = rows.filter(c.isNotNull() & (F.size(c) > 0) & finite).select(
        "vec_id", F.transform(c, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("x"))
    lengths = good.groupBy(F.size("x").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return good.filter(F.size("x") == (usual.length if usual else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _summed(fit: DataFrame, part, size: int, name: str) -> np.ndarray:
    """Sum of ``part`` (batch to float64 array of ``size`` entries) over the table: per task,
    then per group of tasks, then the groups here."""

    def per_task(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def per_group(batches):
        total = np.zeros(size)
        for batch in batches:
            for entry in batch.column("total").to_pylist():
                total += np.frombuffer(entry)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    partial = stored(arrow_fold(fit, per_task, "total binary"), name)
    groups = max(1, math.isqrt(partial.count()))
    few = arrow_fold(partial.repartition(groups), per_group, "total binary").collect()
    return np.sum([np.frombuffer(r.total) for r in few], axis=0) if few else np.zeros(size)


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: exact count and sums, and the components."""

    n: int
    sums: list[int]
    values: np.ndarray   # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors, columns
    trace: float
    identity_error: float

    @property
    def factors(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array([s / self.n for s in self.sums])) @ self.factors


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From the distinct vectors of (x); None if there is nothing to whiten."""
    # Repeats of a vector merge before the shuffle, so a frequent one is no hot key.
    fit = stored(vectors.select("x").distinct(), "fit-vectors")
    # Sums are exact: decimals of 38 digits, one per dimension.
    facts = fit.select(F.posexplode("x").alias("dimension", "entry")).groupBy("dimension").agg(
        F.sum(F.col("entry").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n")
    ).orderBy("dimension").collect()
    if not facts:
        return None
    n, sums = facts[0].n, [int(f.total) for f in facts]
    mean = np.array([s / n for s in sums])

    def products(batch):
        centred = _matrix(batch) - mean
        return centred.T @ centred

    size = len(sums) ** 2
    covariance = _symmetric(_summed(fit, products, size, "covariance").reshape(len(sums), -1) / n)
    values, basis = spectral_components(covariance, components)
    trace = float(np.trace(covariance))
    usable = values > len(sums) * EPS * max(trace, 0.0)
    values, basis = values[usable], basis[:, usable]
    if not len(values):
        return None
    found = Whitening(n, sums, values, basis, trace, 0.0)

    def whitened_products(batch):
        white = found.whiten(_matrix(batch))
        return white.T @ white

    k = len(values)
    check = _summed(fit, whitened_products, k * k, "whitened").reshape(k, k) / n
    return Whitening(n, sums, values, basis, trace, float(np.abs(check - np.eye(k)).max()))


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row; None where it needs more than 64 bits."""
    widest = n * max(int(abs(int(x.max()))), int(abs(int(x.min()))), 1) + max(map(abs, sums))
    if widest * widest * x.shape[1] <= LONG_MAX:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(axis=1).tolist()
    exact = [sum((n * e - s) ** 2 for e, s in zip(row, sums)) for row in x.tolist()]
    return [e if e <= LONG_MAX else None for e in exact]


def whiten(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    schema = ("vec_id long, component int, n long, deviation long, whitened double, "
              "explained double, identity_error double")
    view = integer_vectors(rows.withColumn("vec_id", F.col("vec_id").cast("long")), vector)
    model = fit_whitening(view, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def body(batch):
        m = shared.value
        x, k = _matrix(batch), len(m.values)
        ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
        deviation = pa.array(exact_deviation(x, m.n, m.sums), pa.int64())
        yield pa.RecordBatch.from_arrays([
            ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
            pa.array(np.full(len(x) * k, m.n)),
            deviation.take(pa.array(np.repeat(np.arange(len(x)), k))),
            pa.array(m.whiten(x).ravel()), pa.array(np.tile(m.values / m.trace, len(x))),
            pa.array(np.full(len(x) * k, m.identity_error)),
        ], [c.split()[0] for c in schema.split(", ")])

    return arrow_map(view, body, schema)
