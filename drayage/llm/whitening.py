"""Whitened vectors: projected on the principal components of all vectors, each to variance one.

Every component of a vector is a whole number, floor(SCALE * c) + SHIFT, so counts, sums and squared
deviations are exact. The components are found in three steps.

1. Partitions keep the spectrum of the vectors they have seen: their number, sums, and the
   eigenvalues and vectors of their scatter. A block of vectors, centred on its own mean, is brought
   to triangular form, whose few rows have the same scatter; each is a rank-one update of the
   spectrum, and so is the step between the two means. An update solves the secular equation
   ``1 + sum(z^2 / (d - x)) = 0`` for all eigenvalues at once, each within the interval that it is
   known to lie in, by steps that agree with the function at its two nearest poles; directions that the update does not touch and values that are equal are
   deflated first; the new vectors come from the z that fits the values found, which keeps them
   orthogonal.
2. Spectra of ``FAN_IN`` partitions are combined in one task by the same rank-one updates, in as many
   rounds as needed. A spectrum is as large as the square of the dimension, and so is all that the
   driver sees.
3. Rayleigh-Ritz: all vectors are projected on the basis found, centred on the exact mean, and the
   small covariance there is summed over partitions and solved, which leaves the components exact to
   double precision.

Defined cases: vectors that are null, empty, or hold null or non-finite entries, or entries whose whole
number is outside +-2**52, are left out; of vectors of several lengths, those of the most frequent
length count (of several such, the longest) and the others are left out; components without variance
(below ``NO_VARIANCE`` of all) are not returned, so equal vectors, a single one or none give no rows;
a squared deviation beyond 63 bits is null; ids are carried only, and rows that repeat an id or a
vector stay rows of their own.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drayage.llm.common import stage

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
# Vectors brought to triangular form at a time (at least the dimension), spectra combined in a task.
BLOCK, FAN_IN = 16_384, 16
NO_VARIANCE = 1e-13
LARGEST = float(1 << 52)
_EPS = np.finfo(float).eps


# --- one spectrum --------------------------------------------------------------------------------

@dataclass
class Spectrum:
    """Of ``n`` vectors: their sums (whole numbers, without the shift), and eigenvalues, rising, and
    eigenvectors, in columns, of their scatter about the mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dims: int) -> Spectrum:
        return Spectrum(0, [0] * dims, np.zeros(dims), np.eye(dims))

    def mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums])

    def combined(self, n: int, sums: list[int], rows: np.ndarray) -> Spectrum:
        """With ``n`` more vectors, whose scatter about their mean is that of the given rows."""
        if not n:
            return self
        out = Spectrum(self.n + n, [a + b for a, b in zip(self.sums, sums, strict=True)], self.values, self.vectors)
        if self.n:
            step = self.mean() - np.array([s / n for s in sums])
            rows = np.vstack([rows, step * np.sqrt(self.n / (self.n + n) * n)])
        for row in rows:
            out.values, out.vectors = rank_one(out.values, out.vectors, row)
        return out

    def with_vectors(self, x: np.ndarray) -> Spectrum:
        """With more vectors, given as whole numbers."""
        sums = [int(s) for s in x.astype(object).sum(axis=0)] if np.abs(x).max() * len(x) > 2**62 else x.sum(axis=0).tolist()
        centred = x - np.array([s / len(x) for s in sums])
        return self.combined(len(x), sums, triangular(centred.T @ centred))

    def with_spectrum(self, other: Spectrum) -> Spectrum:
        if not self.n:
            return other
        return self.combined(other.n, other.sums, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)


def triangular(products: np.ndarray) -> np.ndarray:
    """Rows whose products are the given ones: a Cholesky factor, the largest diagonal entry first, as
    far as there is anything left."""
    left, rows = products.copy(), []
    least = len(left) * _EPS * left.diagonal().max()
    for _ in range(len(left)):
        k = int(left.diagonal().argmax())
        if left[k, k] <= least:
            break
        rows.append(left[k] / np.sqrt(left[k, k]))
        left -= np.outer(rows[-1], rows[-1])
    return np.array(rows).reshape(-1, len(left))


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum(z^2 / (d - x))`` for rising, different d and z without zeros: for each,
    which d is its nearest, and how far it is from that. Root i is between d[i] and d[i + 1]."""
    square, n = z * z, len(d)
    gap = np.append(np.diff(d), square.sum())
    # The sign in the middle says which end is nearer; the distance from there is found without loss.
    mid = d + gap / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        low_half = 1 + (square / (d - mid[:, None])).sum(axis=1) >= 0
    low_half[-1] = True
    origin = np.where(low_half, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    lo = np.where(low_half, 0.0, -gap / 2)
    hi = np.where(low_half, np.where(np.arange(n) == n - 1, gap, gap / 2), 0.0)
    from_origin = d - d[origin][:, None]
    row = np.arange(n)
    lower_poles = np.tri(n, n, 0, dtype=bool)
    x = (lo + hi) / 2
    for _ in range(200):
        apart = from_origin - x[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            part = square / apart
            value = 1 + part.sum(axis=1)
            slope = part / apart
            left = np.where(lower_poles, slope, 0).sum(axis=1)
            right = slope.sum(axis=1) - left
            above = value >= 0  # the function rises between two poles
            hi, lo = np.where(above, x, hi), np.where(above, lo, x)
            # The root of the function with these two neighbouring poles that agrees in value and slopes.
            one, two = apart[row, row], apart[row, np.minimum(row + 1, n - 1)]
            c = value - one * left - two * right
            a = (one + two) * value - one * two * (left + right)
            b = one * two * value
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = one[-1] + one[-1] ** 2 * left[-1] / (value[-1] - one[-1] * left[-1])
        new = x + step
        inside = (new > lo) & (new < hi)
        done = (np.abs(value) <= 4 * n * _EPS * (1 + np.abs(part).sum(axis=1))) | (hi - lo <= 2 * _EPS * np.abs(x))
        if done.all():
            break
        x = np.where(done, x, np.where(inside, new, (lo + hi) / 2))
    return origin, x


def _deflated(d: np.ndarray, q: np.ndarray, z: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Turns the vectors of values that are equal so that one of them takes the whole update."""
    begin = 0
    same = np.diff(d) <= tolerance
    for end in [*(np.flatnonzero(~same) + 1), len(d)]:
        if end - begin > 1:
            part = z[begin:end].copy()
            size = np.linalg.norm(part)
            if size > 0:
                mirror = part.copy()
                mirror[-1] += np.copysign(size, part[-1])
                mirror /= np.linalg.norm(mirror)
                columns = q[:, begin:end]
                q[:, begin:end] = columns - 2 * np.outer(columns @ mirror, mirror)
                z[begin:end] = 0
                z[end - 1] = -np.copysign(size, part[-1])
        begin = end
    return q, z


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and vectors of ``vectors diag(values) vectors' + row row'``."""
    z = vectors.T @ row
    size = float(z @ z)
    if size == 0:
        return values, vectors
    tolerance = 8 * _EPS * max(abs(values[-1]), size)
    d, q = values, vectors.copy()
    q, z = _deflated(d, q, z.copy(), tolerance)
    touched = np.abs(z) * np.sqrt(size) > tolerance
    if not touched.any():
        return d, q
    dt, zt = d[touched], z[touched]
    origin, shift = secular_roots(dt, zt)
    # Differences d[j] - root[i], exact near the poles.
    apart = (dt - dt[origin][:, None]) - shift[:, None]
    roots = dt[origin] + shift
    # The z for which the roots found are the exact ones; every ratio below is between two neighbours.
    if len(dt) > 1:
        below = np.tri(len(dt), len(dt), -1, dtype=bool).T[:-1]  # roots before the pole
        poles = np.where(below, dt[:-1, None] - dt, dt[1:, None] - dt)
        square = np.prod(-apart[:-1] / poles, axis=0) * -apart[-1]
        zt = np.copysign(np.sqrt(np.abs(square)), zt)
    w = zt / apart
    w /= np.linalg.norm(w, axis=1)[:, None]
    d = d.copy()
    d[touched] = roots
    q[:, touched] = q[:, touched] @ w.T
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


# --- over partitions -----------------------------------------------------------------------------

def _whole(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The vectors of a batch as whole numbers, without the shift."""
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.floor(SCALE * values).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    block = max(BLOCK, 2 * dims)
    for batch in batches:
        x = _whole(batch, dims)
        for k in range(0, len(x), block):
            yield x[k:k + block]


def reduced(rows: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], object], merge: Callable[[object, object], object],
            purpose: str, fan_in: int = FAN_IN) -> object | None:
    """What ``fold`` makes of each partition, merged ``fan_in`` at a time; None without rows."""
    schema = "part long, state binary"

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = fold(b for b in batches if b.num_rows)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "state": [pickle.dumps(state)]})

    def merged(table: pa.Table) -> pa.Table:
        states = [pickle.loads(s) for _, s in sorted(zip(*table.to_pydict().values(), strict=True))]
        out = states[0]
        for state in states[1:]:
            out = merge(out, state)
        return pa.table({"part": [min(table.column("part").to_pylist()) // fan_in], "state": [pickle.dumps(out)]})

    states = stage(rows.mapInArrow(folded, schema), purpose)
    while True:
        last = states.agg(F.max("part")).first()[0]
        if last is None:
            return None
        if last == 0:
            return pickle.loads(states.first()["state"])
        states = stage(states.groupBy(F.floor(F.col("part") / fan_in).alias("group")).applyInArrow(
            lambda _, table: merged(table), schema), purpose)


def _spectra(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Spectrum | None]:
    def fold(batches: Iterator[pa.RecordBatch]) -> Spectrum | None:
        out = Spectrum.empty(dims)
        for x in _blocks(batches, dims):
            out = out.with_vectors(x)
        return out if out.n else None

    return fold


def _projected(dims: int, mean: np.ndarray, basis) -> Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]:
    """Sums of products of the vectors' places on a broadcast basis."""

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for x in _blocks(batches, dims):
            y = (x - mean) @ basis.value
            out = y.T @ y if out is None else out + y.T @ y
        return out

    return fold


def squared_deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """For rows x, the sum of (n x - S)^2 over the dimensions, exact, null beyond 63 bits."""
    most = max(n * int(np.abs(x).max()) + max(map(abs, sums)), 1)
    if most * most * x.shape[1] < 1 << 63:
        apart = n * x - np.array(sums, np.int64)
        return pa.array((apart * apart).sum(axis=1))
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int | None]:
    """(id, vector) of the vectors that count, and their dimension."""
    vector = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).alias("id"), vector.alias("vector"))
    fine = F.forall("vector", lambda c: F.coalesce(F.abs(SCALE * c) <= LARGEST, F.lit(False)))
    rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)
    dims = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if dims is None:
        return rows, None
    return rows.filter(F.size("vector") == dims["dims"]), dims["dims"]


@dataclass
class Components:
    """Of ``n`` vectors with these sums: variances, falling, their shares, and unit vectors in columns."""

    n: int
    sums: list[int]
    variances: np.ndarray
    shares: np.ndarray
    vectors: np.ndarray

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def fitted(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Components | None:
    """The principal components of all vectors."""
    found = reduced(vectors, _spectra(dims), Spectrum.with_spectrum, "spectra")
    if found is None:
        return None
    mean, context = found.mean(), vectors.sparkSession.sparkContext
    basis, _ = np.linalg.qr(found.vectors[:, ::-1])
    inside = reduced(vectors, _projected(dims, mean, context.broadcast(basis)), np.add, "ritz")
    variances, turn = np.linalg.eigh(inside / found.n)
    variances, turn = variances[::-1], turn[:, ::-1]
    total = variances.sum()
    some = variances[:components] > NO_VARIANCE * total
    return Components(found.n, found.sums, variances[:components][some], variances[:components][some] / total,
                      (basis @ turn)[:, :components][:, some])


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    schema = T.StructType([rows.select(F.col(id_col).alias("id")).schema["id"]] + [
        T.StructField(name, kind) for name, kind in (
            ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()),
            ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))])
    vectors, dims = valid_vectors(rows, id_col, vector_col)
    fit = fitted(vectors, dims, components) if dims else None
    if fit is None or not len(fit.variances):
        return rows.sparkSession.createDataFrame([], schema)
    mean, k = fit.mean(), len(fit.variances)
    scaled = rows.sparkSession.sparkContext.broadcast(fit.vectors / np.sqrt(fit.variances))
    products = reduced(vectors, _projected(dims, mean, scaled), np.add, "whitened-products")
    error = float(np.abs(products / fit.n - np.eye(k)).max())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch, dims)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(row), fit.n)), squared_deviations(x, fit.n, fit.sums).take(row),
                 pa.array(((x - mean) @ scaled.value).ravel()), pa.array(np.tile(fit.shares, len(x))),
                 pa.array(np.full(len(row), error))], names=schema.names)

    return vectors.mapInArrow(spread, schema)
