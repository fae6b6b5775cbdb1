"""Vectors of Arrow lists as dense numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(vec: str | Column) -> Column:
    """True for vectors without null, NaN or infinite components; false for null ones."""
    v = F.col(vec) if isinstance(vec, str) else vec
    good = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The components of all lists of a column, one after another; null lists have none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False)


def block(column: pa.Array, dims: int) -> np.ndarray:
    """A row of `dims` components for each list, all of which have that many."""
    return flat(column).reshape(-1, dims)


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))
