"""Whitening of vectors by the cyclic Jacobi method.

Entries become integers, so sums and centred products are exact whatever the order of tasks: each task adds products of rows that are centred at the rounded
mean, and the covariance is the exact quotient of integers, rounded once. The driver gets one number for each pair of dimensions and turns pairs of
dimensions by symmetric rotations, sweep after sweep, until every off-diagonal entry vanishes against its diagonal entries, which keeps small eigenvalues
accurate. Eigenvectors over the roots of their eigenvalues, sorted, are broadcast and applied to all rows.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, without
from .vectors import as_integers, matrix, usual_length

SCALE, SHIFT, TOP = 1024.0, 100_000, 8
#: Half the bits of a centred entry; rows of one product, so that sums of products stay below 2**53 in doubles and are exact.
BITS, ROWS = 21, 1024
LIMIT = 2.0**40
#: Dimensions at most: a task holds three square matrices of them.
DIMENSIONS = 4096


def jacobi(v: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of a symmetric positive matrix by cyclic Jacobi rotations.

    Pairs are turned row by row until each off-diagonal entry is below a rounding error of the root of its two diagonal entries' product; entries against
    a zero on the diagonal are below a rounding error of the trace.
    """
    a, q = np.array(v, np.float64), np.eye(len(v))
    eps, floor = np.finfo(np.float64).eps, np.finfo(np.float64).eps ** 2 * max(float(np.trace(v)), 0.0)
    for _ in range(sweeps):
        turned = False
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                x = a[i, j]
                if abs(x) <= eps * np.sqrt(abs(a[i, i] * a[j, j])) or abs(x) <= floor:
                    continue
                turned = True
                theta = (a[j, j] - a[i, i]) / (2 * x)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                ii, jj = a[i, i] - t * x, a[j, j] + t * x
                row = c * a[i] - s * a[j]
                a[j] = s * a[i] + c * a[j]
                a[i] = row
                a[:, i], a[:, j] = a[i], a[j]
                a[i, i], a[j, j], a[i, j], a[j, i] = ii, jj, 0.0, 0.0
                q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], q[:, order]


def _products(y: np.ndarray) -> list[np.ndarray]:
    """Exact sums of products of the columns of at most ROWS rows, in units of 1, 2**BITS and 2**(2 BITS)."""
    high = y >> BITS
    low = (y - (high << BITS)).astype(np.float64)
    out = [low.T @ low]
    if high.any():
        high = high.astype(np.float64)
        cross = high.T @ low
        out += [cross + cross.T, high.T @ high]
    return [m.astype(np.int64) for m in out]


def moments(rows: DataFrame, dim: int, x: str = "x") -> tuple[int, list[int], list[list[int]]]:
    """(n, sums S, centred scatter times n) of packed integers, all exact: entry (i, j) of the last is n times the sum of (x_i - S_i/n)(x_j - S_j/n)."""
    first = rows.select(F.col(x)).mapInArrow(_sums(dim), "pos int, s decimal(38,0)").groupBy("pos").agg(F.sum("s").alias("s")).collect()
    found = {r.pos: int(r.s) for r in first}
    n = found.pop(-1, 0)
    if not n:
        return 0, [0] * dim, [[0] * dim for _ in range(dim)]
    sums = [found[i] for i in range(dim)]
    middle = np.array([s // n for s in sums], np.int64)
    upper = np.triu_indices(dim)

    def run(batches):
        total: list[np.ndarray | None] = [None, None, None]
        adds = 0

        def parts():
            for unit, m in enumerate(total):
                if m is not None:
                    flat = m[upper]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array([Decimal(int(z) << (unit * BITS)) for z in flat], pa.decimal128(38, 0))], names=["pos", "s"])

        for b in batches:
            y = matrix(b.column(0), dim) - middle
            for lo in range(0, len(y), ROWS):
                for unit, m in enumerate(_products(y[lo : lo + ROWS])):
                    total[unit] = m if total[unit] is None else total[unit] + m
                adds += 1
                if adds == 256:  # sums of 256 products fit into 64 bits
                    yield from parts()
                    total, adds = [None, None, None], 0
        yield from parts()

    pairs = rows.select(F.col(x)).mapInArrow(run, "pos int, s decimal(38,0)").groupBy("pos").agg(F.sum("s").alias("s")).collect()
    scatter = [[0] * dim for _ in range(dim)]
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]  # sums of the rows centred at the rounded mean
    for r in pairs:
        i, j = int(upper[0][r.pos]), int(upper[1][r.pos])
        scatter[i][j] = scatter[j][i] = n * int(r.s) - rest[i] * rest[j]
    return n, sums, scatter


def _sums(dim: int):
    def run(batches):
        total, n = [0] * dim, 0
        for b in batches:
            x = matrix(b.column(0), dim)
            n += len(x)
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim, dtype=np.int32)), pa.array([Decimal(z) for z in (n, *total)], pa.decimal128(38, 0))], names=["pos", "s"])

    return run


def whiten(rows: DataFrame, components: int = TOP, vector: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """rows without the vector, with n, deviation (decimal, exact), whitened and explained (arrays, an entry for each of the first components) and identity_error.

    x = floor(scale * entry) + shift. Rows with a null vector or null or non-finite entries go, and so do vectors of another length than the most frequent and
    entries beyond 2**40 after scaling. Every other row counts, repeated ones too, whatever its other columns hold; columns named like results are replaced.
    Vectors of fewer dimensions have as many components; a component without variance has null in whitened, and explained is null if none has any. An
    empty table gives an empty one.
    """
    made = ["n", "deviation", "whitened", "explained", "identity_error"]
    spark = rows.sparkSession
    dim = usual_length(rows, vector)
    if dim > DIMENSIONS:
        raise ValueError(f"vectors of {dim} dimensions; at most {DIMENSIONS}")
    keep = without(rows.withColumnRenamed(vector, "_vector"), made)
    ints = cut(as_integers(keep, "_vector", dim, scale, shift, LIMIT, "_x"))
    n, sums, scatter = moments(ints, dim, "_x")
    k = min(components, dim)
    square = max(n, 1) ** 2
    v = np.array([[float(Fraction(z, square)) for z in r] for r in scatter]).reshape(dim, dim)
    values, axes = jacobi(v)
    trace = float(Fraction(sum(scatter[i][i] for i in range(dim)), square))
    # no variance: below what rounding the entries of v can do to the eigenvalue
    flat = values <= 4 * np.finfo(np.float64).eps * (np.abs(axes).T @ np.sqrt(np.diag(v))) ** 2
    explained = [float(values[i] / trace) if trace > 0 else None for i in range(k)]
    usable = [i for i in range(k) if not flat[i]]
    middle = np.array([s // max(n, 1) for s in sums], np.int64)
    plan = spark.sparkContext.broadcast((middle, np.array(sums, object) - n * middle.astype(object), axes[:, usable] / np.sqrt(values[usable])))

    def centred(x: np.ndarray) -> np.ndarray:
        """n x - S, exact: n times what is beyond the rounded mean, less the rest of S."""
        middle, rest, _ = plan.value
        y = x - middle
        if n * (float(np.abs(y).max(initial=0)) + 1) < 2.0**62:
            return y * np.int64(n) - rest.astype(np.int64)
        return y.astype(object) * n - rest

    def projected(d: np.ndarray) -> np.ndarray:
        return (d / n).astype(np.float64) @ plan.value[2]

    def measure(batches):
        total = np.zeros(len(usable) + len(usable) ** 2)
        for b in batches:
            w = projected(centred(matrix(b.column(0), dim)))
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["pos", "s"])

    error = None
    if n and usable:
        got = {r.pos: r.s for r in ints.select("_x").mapInArrow(measure, "pos int, s double").groupBy("pos").agg(F.sum("s").alias("s")).collect()}
        mean = np.array([got[i] for i in range(len(usable))]) / n
        second = np.array([got[len(usable) + i] for i in range(len(usable) ** 2)]).reshape(len(usable), -1) / n
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(usable))).max())
    names = [c for c in ints.columns if c != "_x"]
    place = ints.columns.index("_x")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ints.schema if f.name != "_x"), "deviation decimal(38,0), whitened array<double>"])

    def run(batches):
        for b in batches:
            d = centred(matrix(b.column(place), dim))
            w = projected(d)
            # d = high * 2**24 + low: partial sums of squares fit into 64 bits, their total is a Python integer
            if d.dtype == object:
                squares = [Decimal(int((r * r).sum())) for r in d]
            else:
                high = d >> 24
                low = d - (high << 24)
                wide = (high.astype(object) ** 2).sum(axis=1) if np.abs(high).max(initial=0) >= 1 << 25 else (high * high).sum(axis=1)
                mid = (high.astype(object) * low).sum(axis=1) if np.abs(high).max(initial=0) >= 1 << 25 else (high * low).sum(axis=1)
                squares = [Decimal((int(h) << 48) + (int(m) << 25) + int(z)) for h, m, z in zip(wide, mid, (low * low).sum(axis=1), strict=True)]
            full: list[list | None] = [w[:, usable.index(i)].tolist() if i in usable else [None] * len(d) for i in range(k)]
            cells = pa.array([list(r) for r in zip(*full, strict=True)] if k else [[] for _ in range(len(d))], pa.list_(pa.float64()))
            kept = [b.column(b.schema.names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(squares, pa.decimal128(38, 0)), cells], names=[*names, "deviation", "whitened"])

    out = ints.mapInArrow(run, schema)
    none = F.lit(None).cast("double")
    shares = F.array(*[none if e is None else F.lit(e) for e in explained]).cast("array<double>")
    return out.withColumns({"n": F.lit(n).cast("long"), "explained": shares, "identity_error": none if error is None else F.lit(error)})


def whitened_rows(rows: DataFrame, components: int = TOP, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    out = whiten(rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding")), components)
    each = out.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select("vec_id", (F.col("_at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("_at")).alias("explained"), "identity_error")
