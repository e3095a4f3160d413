"""What the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def dimensions(df: DataFrame, vector: str) -> int:
    """The longest vector's length; shorter ones count as filled up with zeros."""
    return df.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors without nulls as rows of width doubles."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = flat
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A matrix from binary values of equal length."""
    size = np.dtype(kind).itemsize * width
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    if not len(column) or data is None or not width:
        return np.zeros((len(column), width), kind)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(len(column), size).copy().view(kind)
