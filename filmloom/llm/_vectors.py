"""Vectors in columns: which are valid, and batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(v: Column) -> Column:
    """Whether an array of doubles is neither null nor holds null, NaN or infinite entries."""
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def matrix(col: pa.ListArray, width: int) -> np.ndarray:
    """A row per list; shorter lists are filled with zeros."""
    sizes, flat = np.diff(col.offsets.to_numpy()), col.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == width * len(col) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(col), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def lists(rows: np.ndarray) -> pa.ListArray:
    """A list per row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))
