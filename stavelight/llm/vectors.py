"""Vectors of equal length with finite entries, as fixed integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_length(rows: DataFrame, vector: str) -> int:
    """The most frequent length of vectors, of equally frequent ones the largest; 0 without any."""
    best = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return best[0].d if best else 0


def as_integers(rows: DataFrame, vector: str, dim: int, scale: float, shift: int = 0, limit: float = 2.0**28, name: str = "x") -> DataFrame:
    """rows with name, floor(scale * entry) + shift of each entry as packed 64-bit integers, instead of the vector.

    Rows whose vector is null, is not of dim entries, or holds null or non-finite entries go; so do those with a scaled entry of limit or more in size, of which
    exact products would not fit.
    """
    names = [c for c in rows.columns if c != vector]
    rows = rows.select(*[f"`{c}`" for c in names], F.col(vector).cast("array<double>").alias("_v")).where(F.size("_v") == dim)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_v"), f"`{name}` binary"])

    def run(batches):
        for b in batches:
            v = b.column(len(names))
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(scale * x)
                good = (np.abs(x) < limit).all(axis=1)  # false for NaN, which nulls become
            x = x[good].astype(np.int64) + shift
            kept = b.filter(pa.array(good))
            cells = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*(kept.column(i) for i in range(len(names))), cells], names=[*names, name])

    return rows.mapInArrow(run, schema)


def matrix(cells: pa.Array, dim: int) -> np.ndarray:
    """Packed integers as a matrix, a row a cell."""
    return np.frombuffer(b"".join(cells.to_pylist()), np.int64).reshape(len(cells), dim)
