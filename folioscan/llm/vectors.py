"""What operators on embeddings share: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of equally long lists."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return values.reshape(len(lists), -1)


def kind_of(table: DataFrame, vector: str) -> str:
    """Single precision where the column has it, which loses nothing; else double."""
    element = getattr(table.schema[vector].dataType, "elementType", None)
    return "array<float>" if isinstance(element, FloatType) else "array<double>"


def lists(values: np.ndarray, kind: str = "array<float>") -> pa.Array:
    n, d = values.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)),
        pa.array(values.ravel().astype(np.float32 if kind == "array<float>" else np.float64)))
