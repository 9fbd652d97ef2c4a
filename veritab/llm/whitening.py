"""Whitening of embeddings: streaming moments, a symmetric QR eigen-solver, and whitened coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import dropped, saved, table

#: Entries are floor(SCALE * c) + OFFSET; beyond +-LIMIT they are held at it.
SCALE, OFFSET, LIMIT = 64, 1_000_000, 2**60
#: Partial moments that are merged at a time.
FAN = 8
#: An eigenvalue of at most this share of the largest counts as zero: nothing can be whitened along it.
ZERO = 1e-13
STATE = "part long, n long, mean binary, m2 binary, sums array<decimal(38,0)>"
_STATE = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("m2", pa.binary()), ("sums", pa.list_(pa.decimal128(38, 0)))])


class Moments(NamedTuple):
    """Of n vectors: sums per dimension (exact if they are integers), means, and centred products."""

    n: int
    sums: list[int]
    mean: np.ndarray
    m2: np.ndarray


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _int_sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns: high and low halves apart, so that 64 bits suffice for 2**31 rows."""
    return [(int(a) << 32) + int(b) for a, b in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]


def add_one(n: int, mean: np.ndarray, m2: np.ndarray, x: np.ndarray) -> int:
    """Welford: one more vector; ``mean`` and ``m2`` change in place, by a rank-one update."""
    n += 1
    before = x - mean
    mean += before / n
    m2 += np.multiply.outer(before, x - mean)
    return n


def merge(a: Moments, b: Moments) -> Moments:
    """Moments of two disjoint sets of vectors, by the parallel update formula."""
    n, apart = a.n + b.n, b.mean - a.mean
    m2 = a.m2 + b.m2 + np.multiply.outer(apart, apart) * (a.n * (b.n / n))
    return Moments(n, [p + q for p, q in zip(a.sums, b.sums, strict=True)], a.mean + apart * (b.n / n), m2)


def _row(part: int, m: Moments) -> pa.RecordBatch:
    sums = [[Decimal(s) for s in m.sums]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([part], [m.n], [m.mean.tobytes()], [m.m2.tobytes()], sums), _STATE.types, strict=True)], schema=_STATE)


def _moments(row: dict) -> Moments:
    mean = np.frombuffer(row["mean"])
    return Moments(row["n"], [int(s) for s in row["sums"]], mean, np.frombuffer(row["m2"]).reshape(len(mean), -1))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors -> one row with the moments of the partition."""
    n, mean, m2, sums = 0, None, None, None
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column(0))
            if mean is None:
                mean, m2, sums = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2), [0] * x.shape[1]
            if x.dtype == np.int64:
                sums = [p + q for p, q in zip(sums, _int_sums(x), strict=True)]
            for v in x.astype(np.float64):
                n = add_one(n, mean, m2, v)
    if n:
        yield _row(TaskContext.get().partitionId(), Moments(n, sums, mean, m2))


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    states = [_moments(r) for r in rows.sort_by("part").to_pylist()]
    out = states[0]
    for s in states[1:]:
        out = merge(out, s)
    return pa.Table.from_batches([_row(key[0].as_py(), out)])


def moments(vectors: DataFrame) -> Moments | None:
    """Moments of the only column of ``vectors`` (arrays of equal length; null if there are none).

    Each partition streams its vectors into one row; rows are merged FAN at a time, in tasks, until FAN are left for
    the driver: FAN matrices of dimensions squared, however many vectors there are.
    """
    states = saved(vectors.mapInArrow(_stream, STATE), "moments")
    while (left := states.count()) > FAN:
        after = saved(states.groupBy(F.floor(F.col("part") / FAN).alias("up")).applyInArrow(_merged, STATE), "moments")
        dropped(states)
        states = after
    rows = [r.asDict() for r in states.orderBy("part").collect()] if left else []
    dropped(states)
    out = None
    for r in rows:
        out = _moments(r) if out is None else merge(out, _moments(r))
    return out


def _tridiagonal(a: np.ndarray) -> tuple[list[float], list[float], np.ndarray]:
    """(diagonal, side diagonal, rows of Q) with Q a Q' tridiagonal, by reflections."""
    d = len(a)
    a, q = a.copy(), np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        long = -math.copysign(float(np.linalg.norm(x)), x[0])
        x[0] -= long
        if not (size := float(np.linalg.norm(x))):
            continue
        v = x / size
        rest = a[k + 1 :, k + 1 :]
        p = 2 * rest @ v
        w = p - (v @ p) * v
        rest -= np.multiply.outer(v, w) + np.multiply.outer(w, v)
        a[k + 1 :, k] = a[k, k + 1 :] = 0
        a[k + 1, k] = a[k, k + 1] = long
        q[k + 1 :] -= 2 * np.multiply.outer(v, v @ q[k + 1 :])
    return np.diag(a).tolist(), np.diag(a, 1).tolist(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    Reflections make the matrix tridiagonal; implicit QR steps with Wilkinson's shift then clear its side diagonal.
    """
    d = len(a)
    if not (size := float(np.abs(a).max(initial=0))):
        return np.zeros(d), np.eye(d)
    main, side, q = _tridiagonal(a / size)
    tiny = lambda i: abs(side[i]) <= 2.3e-16 * (abs(main[i]) + abs(main[i + 1]))
    hi = d - 1
    for _ in range(100 * d):
        while hi > 0 and tiny(hi - 1):
            hi -= 1
        if hi <= 0:
            break
        lo = hi - 1
        while lo > 0 and not tiny(lo - 1):
            lo -= 1
        half, e = (main[hi - 1] - main[hi]) / 2, side[hi - 1]
        x, z = main[lo] - (main[hi] - e * e / (half + math.copysign(math.hypot(half, e), half))), side[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                side[k - 1] = r
            p, t, e = main[k], main[k + 1], side[k]
            main[k], main[k + 1] = c * c * p + 2 * c * s * e + s * s * t, s * s * p - 2 * c * s * e + c * c * t
            side[k] = (c * c - s * s) * e + c * s * (t - p)
            if k < hi - 1:
                x, z = side[k], s * side[k + 1]
                side[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    else:
        raise ArithmeticError("the eigenvalues do not converge")
    order = np.argsort(np.array(main))[::-1]
    return np.array(main)[order] * size, q[order]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """(x - S/n as doubles, sum of (n*x - S)**2 as exact integers) of the rows of x."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums)) < 2**62:
        apart = n * x - np.array(sums, np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2**62:
            return apart / n, (apart * apart).sum(1).tolist()
        exact = apart.astype(object)
    else:
        exact = n * x.astype(object) - np.array(sums, object)
    return (exact / n).astype(np.float64), [sum(v * v for v in row) for row in exact.tolist()]


def _entries(col: Column) -> Column:
    return F.transform(col, lambda c: F.least(F.greatest(F.floor(c * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)) + OFFSET)


def whitened(df: DataFrame, id_col: str, vec_col: str, components: int = 16) -> DataFrame:
    """(id, component, n, deviation, deviation_exact, whitened, explained, identity_error) of each row and component.

    Entries become integers (see SCALE); the covariance is fitted on each distinct integer vector once. Partitions
    stream their vectors by rank-one updates, the partial moments are merged by the parallel formula, and the driver
    solves one matrix of dimensions squared. ``identity_error`` is measured: a second pass takes the covariance of
    the whitened fit list. Components are numbered from 1 by falling eigenvalue.

    Rows whose vector is null or holds null or non-finite entries are dropped, and so are vectors of another length
    than most distinct ones have (ties: the longer). Repeated rows and null ids stay. Along a component without
    variance ``whitened`` is null, since nothing can be divided by zero. ``deviation`` is null where it passes 64
    bits, ``deviation_exact`` (decimal) where it passes 38 digits. No rows, or vectors without entries: no rows.
    """
    spark, vec = df.sparkSession, F.col(f"`{vec_col}`").cast("array<double>")
    whole = vec.isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(whole).select(F.col(f"`{id_col}`").alias("id"), _entries(vec).alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"
    fit = saved(rows.select("x").distinct(), "fit-list")
    most = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or most["d"] == 0:
        dropped(fit)
        return spark.createDataFrame([], shape).withColumnRenamed("id", id_col)
    same = F.size("x") == most["d"]
    m = moments(fit.filter(same))
    n, sums, k = m.n, m.sums, min(components, most["d"])
    values, vectors = symmetric_qr((m.m2 + m.m2.T) / (2 * n))
    values, vectors, total = np.maximum(values[:k], 0), vectors[:k], float(np.trace(m.m2)) / n
    live = values > ZERO * max(values[0], 0)
    turn = np.where(live, 1 / np.sqrt(np.where(live, values, 1)), 0)[:, None] * vectors
    share = values / total if total else np.zeros(k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _deviations(_matrix(b.column(0)), n, sums)[0] @ turn[live].T
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.array(y.ravel()))], names=["y"])

    error = 0.0
    if live.any():
        after = moments(fit.filter(same).mapInArrow(project, "y array<double>"))
        error = float(np.abs(after.m2 / n - np.eye(int(live.sum()))).max())
    dropped(fit)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            apart, far = _deviations(_matrix(b.column(1)), n, sums)
            repeat = pa.array(np.repeat(np.arange(b.num_rows), k))
            y = apart @ turn.T
            cols = [b.column(0).take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(len(repeat), n))]
            cols += [pa.array([v if v < 2**63 else None for v in far], pa.int64()).take(repeat), pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0)).take(repeat)]
            cols += [pa.array(y.ravel(), mask=~np.tile(live, b.num_rows)), pa.array(np.tile(share, b.num_rows)), pa.array(np.full(len(repeat), error))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"])

    return rows.filter(same).mapInArrow(result, shape).withColumnRenamed("id", id_col)


def op12_welford_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
