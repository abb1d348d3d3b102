"""Embedding whitening: the leading components of a distributed covariance, scaled to unit variance.

Entries become whole numbers, ``floor(256 * c)``, held at plus or minus 2**62. The components are fitted on the distinct
vectors. Tasks sum centred outer products; the sum, as large as the square of the dimension whatever the number of rows,
is solved on the driver: Householder reflections to a tridiagonal matrix, bisection by Sturm counts for the leading
eigenvalues, inverse iteration for their vectors, made orthogonal anew within a cluster of close eigenvalues. The rows are
then projected where they lie.

Rows with a null vector or a null or non-finite entry are dropped. A vector shorter than the longest one ends in zeros.
A component without variance has no rows, so tables without rows, with one distinct vector, or with empty vectors only
give none. Every row has results of its own, also one whose vec_id is null or repeated. A ``deviation`` beyond 64 bits is
null. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from teleledger.llm import common

SCALE, COMPONENTS = 256, 4
_LIMIT = 2**62
#: A component whose share of the variance is within rounding is none.
_NO_SHARE = 1e-13
#: Eigenvalues closer than this share of the matrix's norm make one cluster.
_CLOSE = 1e-3
_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_SUMS = "dim int, n long, high long, low long"
_PART = "i int, line array<double>"


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with per-dimension sums; components as columns of ``vectors``, largest eigenvalue first."""

    n: int
    sums: tuple[int, ...]
    total: float  # trace of the covariance
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], dtype=float)

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.vectors) / np.sqrt(self.values)


def whole_numbers(batch: pa.Array, width: int) -> np.ndarray:
    """A row of ``width`` whole numbers for each list; what a list lacks is zero."""
    lengths = np.diff(batch.offsets.to_numpy())
    entries = batch.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(batch), width), dtype=np.int64)
    filled = np.arange(width) < lengths[:, None]
    out[filled] = np.clip(np.floor(SCALE * entries), -_LIMIT, _LIMIT).astype(np.int64)
    return out


def _usable(vector: Column) -> Column:
    """Not null, and no entry null, infinite or no number."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def _clean(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).filter(_usable(F.col("embedding")))


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, int, str]:
    """The distinct rows of whole numbers as bytes, their dimension, and the narrowest type that holds every entry."""
    size = F.transform("embedding", lambda c: F.abs(c.cast("double")))
    seen = vectors.agg(F.max(F.size("embedding")), F.max(F.array_max(size))).first()
    width, most = seen[0] or 0, min(SCALE * (seen[1] or 0.0) + 1, float(_LIMIT))
    dtype = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch.column(0), width).astype(dtype)
            yield pa.RecordBatch.from_pydict({"x": pa.array([r.tobytes() for r in x], pa.binary())})

    return vectors.select("embedding").mapInArrow(encode, "x binary").distinct(), width, dtype


def _decoded(batches: Iterator[pa.RecordBatch], width: int, dtype: str) -> Iterator[np.ndarray]:
    for batch in batches:
        data = b"".join(batch.column(0).to_pylist())
        yield np.frombuffer(data, dtype=dtype).reshape(batch.num_rows, width).astype(np.int64)


def sums(distinct: DataFrame, width: int, dtype: str) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums of each dimension; tasks add high and low halves, which stay within 64 bits."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for x in _decoded(batches, width, dtype):
            n += len(x)
            high += (x >> 31).sum(axis=0)
            low += (x & 0x7FFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array(np.arange(width), pa.int32()), "n": pa.array(np.full(width, n), pa.int64()),
            "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())})

    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    rows = distinct.mapInArrow(add, _SUMS).groupBy("dim").agg(*exact).orderBy("dim").collect()
    return int(rows[0]["n"]), tuple((int(r["high"]) << 31) + int(r["low"]) for r in rows)


def covariance(distinct: DataFrame, width: int, dtype: str, n: int, mean: np.ndarray, through=None) -> np.ndarray:
    """Covariance of the vectors, or of what ``through`` makes of them, centred on ``mean`` before multiplying."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for x in _decoded(batches, width, dtype):
            y = (through(x) if through else x) - mean
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(np.arange(len(mean)), pa.int32()), "line": pa.array(list(total), pa.list_(pa.float64()))})

    cells = distinct.mapInArrow(multiply, _PART).select("i", F.posexplode("line").alias("j", "v"))
    out = np.zeros((len(mean), len(mean)))
    summed = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out[summed["i"].to_numpy(), summed["j"].to_numpy()] = summed["v"].to_numpy()
    return (out + out.T) / (2 * n)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, second diagonal and the unit Householder vectors that lead there; the k-th one acts on entries k + 1 and on."""
    a, mirrors = matrix.astype(float).copy(), []
    for k in range(len(a) - 2):
        x = a[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        length = np.linalg.norm(x)
        v = x / length if length else x
        p = a[k + 1:, k + 1:] @ v
        w = p - (v @ p) * v
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def _below(diagonal: np.ndarray, beside: np.ndarray, shifts: np.ndarray, floor: float) -> np.ndarray:
    """Sturm counts: the eigenvalues below each shift, as the negative pivots of the shifted matrix."""
    count, pivot = np.zeros(len(shifts), dtype=int), np.ones_like(shifts)
    for d, b in zip(diagonal, np.append(0.0, beside)):
        pivot = d - shifts - b * b / pivot
        pivot[np.abs(pivot) < floor] = -floor
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its interval is within rounding."""
    n = len(diagonal)
    reach = np.abs(np.append(beside, 0.0)) + np.abs(np.append(0.0, beside))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    size = max(np.abs(low).max(), np.abs(high).max(), np.finfo(float).tiny)
    low, high = low - 1e-14 * size, high + 1e-14 * size
    floor = max(np.finfo(float).eps ** 2 * size, np.finfo(float).tiny)
    rank = n - 1 - np.arange(k)  # so many eigenvalues are smaller
    for _ in range(2000):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        under = _below(diagonal, beside, middle, floor) > rank
        high, low = np.where(under, middle, high), np.where(under, low, middle)
    return low + (high - low) / 2


def _solve(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Tridiagonal system by elimination with row exchanges; a pivot of zero becomes a tiny one."""
    n = len(diagonal)
    d, u1, u2 = diagonal - shift, np.append(beside, 0.0), np.zeros(n)
    y = right.copy()
    for k in range(n - 1):
        row, below = [d[k], u1[k], u2[k]], [beside[k], d[k + 1], u1[k + 1]]
        if abs(below[0]) > abs(row[0]):
            row, below, y[k], y[k + 1] = below, row, y[k + 1], y[k]
        pivot = row[0] if abs(row[0]) > least else least
        f = below[0] / pivot
        d[k], u1[k], u2[k] = pivot, row[1], row[2]
        d[k + 1], u1[k + 1] = below[1] - f * row[1], below[2] - f * row[2]
        y[k + 1] -= f * y[k]
    if abs(d[-1]) <= least:
        d[-1] = least
    for k in range(n - 1, -1, -1):
        y[k] -= (u1[k] * y[k + 1] if k + 1 < n else 0.0) + (u2[k] * y[k + 2] if k + 2 < n else 0.0)
        y[k] /= d[k]
    return y


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    diagonal, beside, mirrors = tridiagonal(matrix)
    values, n = leading_values(diagonal, beside, k), len(matrix)
    size = max(np.abs(diagonal).max(), np.abs(beside).max(initial=0.0), 1e-200)
    vectors, random = np.zeros((n, k)), np.random.default_rng(13)
    for c, value in enumerate(values):
        first = c
        while first and values[first - 1] - values[first] <= _CLOSE * size:
            first -= 1
        y = random.standard_normal(n)
        # Equal eigenvalues would give one solution again and again; they are told apart by a step within rounding.
        shift = value - (c - first) * 2 * np.finfo(float).eps * size
        for _ in range(6):
            for _ in range(2):
                y -= vectors[:, first:c] @ (vectors[:, first:c].T @ y)
            y /= np.linalg.norm(y)
            y = _solve(diagonal, beside, shift, y, np.finfo(float).eps * size)
            y /= np.abs(y).max()
        for _ in range(2):
            y -= vectors[:, first:c] @ (vectors[:, first:c].T @ y)
            y /= np.linalg.norm(y)
        vectors[:, c] = y
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        vectors[at + 1:] -= 2 * np.outer(v, v @ vectors[at + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return values, vectors


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The first ``k`` components of the distinct vectors; None if nothing varies."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    distinct, width, dtype = distinct_vectors(_clean(vectors))
    if not width:
        return None
    with common.Scratch(spark) as scratch:
        distinct = scratch.stored(distinct, "distinct-vectors")
        n, total = sums(distinct, width, dtype)
        mean = np.array([s / n for s in total])
        matrix = covariance(distinct, width, dtype, n, mean)
        trace = float(np.trace(matrix))
        if not trace > 0:
            return None
        values, found = components(matrix, min(k, width))
        real = values > _NO_SHARE * trace
        model = Whitening(n, total, trace, values[real], found[:, real])
        own = covariance(distinct, width, dtype, n, np.zeros(int(real.sum())), model.project)
        return Whitening(n, total, trace, values[real], found[:, real], float(np.abs(own - np.eye(len(own))).max()))


def deviations(x: np.ndarray, n: int, total: tuple[int, ...]) -> list[int | None]:
    """Exact sums of ``(n * x - S) ** 2``; null beyond 64 bits."""
    reach = max([n * int(max(x.max(initial=0), -x.min(initial=0))), *map(abs, total)]) * 2
    if len(total) * reach * reach < 2**63:
        y = n * x - np.array(total, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, total)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each usable vector and component."""
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                continue
            x, k = whole_numbers(batch.column(1), len(model.sums)), len(model.values)
            rows = len(x) * k
            off = np.repeat(np.array(deviations(x, model.n, model.sums), dtype=object), k).tolist()
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                "n": pa.array(np.full(rows, model.n), pa.int64()), "deviation": pa.array(off, pa.int64()),
                "whitened": pa.array(model.project(x).reshape(-1), pa.float64()),
                "explained": pa.array(np.tile(model.values / model.total, len(x)), pa.float64()),
                "identity_error": pa.array(np.full(rows, model.identity_error), pa.float64())})

    common.small_batches(vectors.sparkSession)
    return _clean(vectors).mapInArrow(project, _ROWS)


def report(spark: SparkSession, vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Fit on all distinct vectors, then whiten every row."""
    return whiten(vectors, fit(vectors, k))
