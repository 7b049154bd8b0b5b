"""Squared Euclidean distance as Spark expressions and as numpy kernels.

Both add up in the order of dimensions, in double precision, so they agree to the last bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_squared(a: Column, b: Column) -> Column:
    """Null if the lengths differ or an element is null."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def l2_partial(a: Column, b: Column, start: int, stop: int) -> Column:
    """The share of dimensions [start, stop)."""
    return l2_squared(F.slice(a, start + 1, stop - start), F.slice(b, start + 1, stop - start))


def slice_bounds(dim: int, n_slices: int) -> list[tuple[int, int]]:
    """[start, stop) of n_slices slices that tile dim, also if it doesn't divide; with more slices than dims some are empty."""
    if n_slices < 1:
        raise ValueError("n_slices must be at least 1")
    return [(s * dim // n_slices, (s + 1) * dim // n_slices) for s in range(n_slices)]


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a column of equally long arrays, in double precision."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors have different lengths")
    return flat.reshape(n, -1)


def distances(x: np.ndarray, q: np.ndarray, start: int = 0, stop: int | None = None, out: np.ndarray | None = None) -> np.ndarray:
    """(len(q), len(x)) squared distances over dimensions [start, stop), added to out if given."""
    if x.shape[1] != q.shape[1]:
        raise ValueError(f"dimensions differ: {x.shape[1]} and {q.shape[1]}")
    total = np.zeros((len(q), len(x))) if out is None else out
    columns = np.ascontiguousarray(x.T)
    for d in range(start, x.shape[1] if stop is None else stop):
        diff = columns[d][None, :] - q[:, d][:, None]
        total += diff * diff
    return total


def pair_distances(x: np.ndarray, q: np.ndarray, start: int, stop: int, out: np.ndarray, at_x=slice(None), at_q=slice(None)) -> np.ndarray:
    """Adds to out the squared distances of rows at_x of x and at_q of q, pair by pair, over dimensions [start, stop)."""
    for d in range(start, stop):
        diff = x[:, d][at_x] - q[:, d][at_q]
        out += diff * diff
    return out


def register_sql(spark) -> None:
    """l2sq(a, b) as a temporary SQL function."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION l2sq(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN "
        "aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x)"
    )
