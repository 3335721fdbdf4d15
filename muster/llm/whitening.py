"""Embedding whitening: Welford moments by partition, merged in pairs of partitions, and a symmetric QR eigen-solve.

Each entry c becomes the integer x = floor(scale * c) + shift.  The fit list is each distinct vector of x once.

1. Distinct vectors meet by a shuffle of the vectors, combined before it, so a vector that a third of all rows have is
   one row a task.
2. Each partition's iterator keeps a count, a mean and the centred sums of products, updated by one rank-one step
   a vector (Welford), relative to the partition's first vector: no sums of squares of uncentred numbers, which lose
   the digits of a large shift.  Sums of the integers are exact besides, and so is the distance of two parts' means.
3. The moments of partitions are merged by the parallel update formula (Chan, Golub and LeVeque), ``FAN_IN`` at a
   time, in rounds, until one row is left: tasks and driver hold a few matrices of dim x dim, whatever the rows are.
4. The covariance's eigenvectors come from Householder tridiagonalisation and implicit QR steps with Wilkinson's
   shift, sorted by falling eigenvalue; the sign makes the largest entry positive.
5. Rows are projected in Arrow batches; steps 2 and 3 over the whitened fit list measure how far its covariance is from
   the identity.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are rows of
another length than the one that most rows have (of ties the longest).  Rows with a null vec_id and repeated rows are
returned like others and count once in the fit.  Components whose variance is zero (within rounding) have whitened null
and explained 0 and take no part in identity_error; if all have, identity_error and explained are null.  deviation is null where
it doesn't fit a long; x must fit one (else the job fails).  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import kept, scratch, table

FAN_IN = 16
MOMENTS = "n long, sums array<long>, mean array<double>, spread array<double>"


def scaled(vector: Column, scale: int, shift: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows that take part: whole, finite vectors of the usual length."""
    top = F.lit(float("inf"))
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < top))
    whole = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite)
    usual = whole.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).first()
    return whole.where(F.size(vector) == (usual["dim"] if usual else 0))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def _row(n: int, sums: list[int], mean: np.ndarray, spread: np.ndarray) -> pa.RecordBatch:
    names = ["n", "sums", "mean", "spread"]
    lists = [pa.array([x], kind) for x, kind in ((sums, pa.list_(pa.int64())), (mean, pa.list_(pa.float64())), (spread.ravel(), pa.list_(pa.float64())))]
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *lists], names)


def welford(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The moments of the vectors in column x of a partition: one row, or none."""
    n, sums, mean, spread, origin = 0, None, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch, "x")
        if origin is None:
            origin, dim = x[0].copy(), x.shape[1]
            mean, spread, sums = np.zeros(dim), np.zeros((dim, dim)), np.zeros(dim, object)
        if x.dtype.kind == "i":
            sums += x.sum(0, dtype=object) if np.abs(x).max() > (1 << 62) // len(x) else x.sum(0)
        for v in (x - origin).astype(float):
            n += 1
            before = v - mean
            mean += before / n
            spread += np.outer(before, v - mean)
    if n:
        yield _row(n, [int(s) for s in sums], mean + origin, (spread + spread.T) / 2)


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The moments of several parts as those of one (parallel update formula)."""
    n, sums, mean, spread = 0, None, None, None
    for batch in batches:
        for part in batch.to_pylist():
            m, other = part["n"], np.array(part["mean"])
            if not n:
                n, sums, mean, spread = m, part["sums"], other, np.array(part["spread"])
                continue
            exact = any(sums) or any(part["sums"])
            gap = np.array([(b * n - a * m) / (n * m) for a, b in zip(sums, part["sums"], strict=True)]) if exact else other - mean
            spread = spread + np.array(part["spread"]) + np.outer(gap, gap).ravel() * (n * m / (n + m))
            mean = mean + gap * (m / (n + m))
            n, sums = n + m, [a + b for a, b in zip(sums, part["sums"], strict=True)]
    if n:
        yield _row(n, sums, mean, spread)


def moments(vectors: DataFrame, keep) -> dict | None:
    """n, sums, mean and the centred sums of products of column x; None without rows."""
    parts = keep(vectors.select("x").mapInArrow(welford, MOMENTS).withColumn("part", F.spark_partition_id()))
    left = parts.count()
    while left > 1:
        groups = -(-left // FAN_IN)
        parts = keep(parts.repartition(groups, F.col("part") % groups).mapInArrow(merge, MOMENTS).withColumn("part", F.spark_partition_id()))
        left = parts.count()
    row = parts.first()
    return row and row.asDict()


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and q with a = q T q' (Householder)."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix."""
    d, e, q = _tridiagonal(a)
    n, tiny = len(d), np.finfo(float).eps
    q = np.ascontiguousarray(q.T)  # rows are the vectors, so that a rotation touches two rows
    hi, rounds = n - 1, 0
    while hi > 0:
        small = np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if small[hi - 1]:
            hi, rounds = hi - 1, 0
            continue
        rounds += 1
        if rounds > 100:
            raise ArithmeticError("the QR iteration didn't converge")
        zeros = np.flatnonzero(e[:hi] == 0)
        lo = zeros[-1] + 1 if len(zeros) else 0
        half, off = (d[hi - 1] - d[hi]) / 2, e[hi - 1]
        shift = d[hi] - off * off / (half + np.copysign(np.hypot(half, off), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            one, two, mid = d[k], d[k + 1], e[k]
            d[k] = c * c * one + 2 * c * s * mid + s * s * two
            d[k + 1] = s * s * one - 2 * c * s * mid + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * mid
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    vectors = q[order]
    signs = np.sign(vectors[np.arange(n), np.abs(vectors).argmax(1)])
    return d[order], (vectors * signs[:, None]).T


class Whitening:
    """A fitted whitening: n, sums, the eigenvalues of the first components and their vectors."""

    def __init__(self, n: int, sums: list[int], spread: list[float], components: int):
        dim = len(sums)
        covariance = np.array(spread).reshape(dim, dim) / n
        values, vectors = symmetric_qr(covariance)
        count = min(components, dim)
        self.n, self.sums, self.trace = n, sums, float(np.trace(covariance))
        self.values, self.vectors = values[:count], vectors[:, :count]
        self.live = self.values > dim * np.finfo(float).eps * max(self.trace, 0.0)
        self.identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of integers, NaN where the variance is zero."""
        shift = np.array([s // self.n for s in self.sums], np.int64)  # whole parts of the means come off exactly
        part = np.array([s % self.n / self.n for s in self.sums])
        scores = ((x - shift) - part) @ self.vectors
        return scores / np.where(self.live, np.sqrt(np.where(self.live, self.values, 1)), np.nan)


def fit(distinct: DataFrame, components: int, keep) -> Whitening | None:
    """The whitening of distinct vectors x of integers; None without rows."""
    got = moments(distinct, keep)
    if got is None:
        return None
    model = Whitening(got["n"], got["sums"], got["spread"], components)
    if model.live.any():
        live = model.live

        def projected(batches):
            for batch in batches:
                if batch.num_rows:
                    rows = model.project(_matrix(batch, "x"))[:, live]
                    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64()))], ["x"])

        check = moments(distinct.mapInArrow(projected, "x array<double>"), keep)
        size = int(live.sum())
        model.identity_error = float(np.abs(np.array(check["spread"]).reshape(size, size) / check["n"] - np.eye(size)).max())
    return model


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each row and component."""
    names = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = usable(vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector")), "vector").select("vec_id", scaled(F.col("vector"), scale, shift).alias("x"))
    with scratch(spark) as keep:
        model = fit(keep(rows.select("x").distinct()), components, keep)
    if model is None:
        return spark.createDataFrame([], names.format(kind))
    return kept(_applied(rows, model, names.format(kind)))


def _applied(rows: DataFrame, model: Whitening, schema: str) -> DataFrame:
    n, sums, error, limit = model.n, np.array(model.sums, object), model.identity_error, (1 << 63) - 1
    explained = [float(v) / model.trace if live else 0.0 for v, live in zip(model.values, model.live, strict=True)] if model.trace > 0 else [None] * len(model.values)
    low, high = -(1 << 62) // max(n, 1), (1 << 62) // max(n, 1)
    whole, dim = np.array([abs(s) < 1 << 62 for s in model.sums]).all(), len(model.sums)

    def deviations(x: np.ndarray) -> list[int | None]:
        if whole and x.min() > low and x.max() < high:
            gap = x * n - sums.astype(np.int64)
            if max(abs(int(gap.min())), abs(int(gap.max()))) ** 2 * dim <= limit:
                return (gap * gap).sum(1).tolist()
        exact = ((x.astype(object) * n - sums) ** 2).sum(1)
        return [int(v) if v <= limit else None for v in exact]

    def apply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "x")
            scores, count = model.project(x), len(model.values)
            rows = np.repeat(np.arange(len(x)), count)
            whitened = scores.ravel()
            columns = [
                batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n)),
                pa.array(deviations(x), pa.int64()).take(pa.array(rows)), pa.array(whitened, mask=np.isnan(whitened)),
                pa.array(explained * len(x), pa.float64()), pa.array([error] * len(rows), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
