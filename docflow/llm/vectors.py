"""Vectors as whole numbers, shared by the operators over ``embeddings``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Components are held in 32 bits; what lies beyond counts as this bound.
LIMIT = (1 << 31) - 1


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; never null."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of every component, x as double, as ``array<int>``."""
    whole = lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(factor)) * x.cast("double"))))
    return F.transform(vector, lambda x: whole(x).cast("int"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of equally long lists of int as rows of a matrix."""
    found = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), width)
