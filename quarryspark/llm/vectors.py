"""What the operators on vectors share: which rows count, and matrices of Arrow lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.runtime import quoted


def whole_vector(vec_col: str = "embedding") -> Column:
    """Whether a row has a vector without null, NaN or infinite entries."""
    v = F.col(quoted([vec_col])[0])
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def doubles(df: DataFrame, vec_col: str) -> Column:
    """The vector as floats or doubles, whichever it has, integers as doubles."""
    v = F.col(quoted([vec_col])[0])
    return v if df.schema[vec_col].dataType.elementType.typeName() in ("float", "double") else v.cast("array<double>")


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of doubles; shorter lists are filled up with zeros."""
    n = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(n.max(initial=0))
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out
