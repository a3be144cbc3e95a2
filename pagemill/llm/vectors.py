"""Vectors as Spark columns and as numpy rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric(df: DataFrame, name: str) -> Column:
    """The column as an array of floats as stored, or of doubles if it holds anything else."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
        return F.col(name)
    return F.col(name).cast("array<double>")


def usable(vector: Column) -> Column:
    """False for null, empty and zero vectors and for those with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Equally long lists as the rows of a double matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow for large components."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
