"""Integer forms of vector columns, for the operators that compare vectors exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components beyond it count as it, so that squared distances fit a long.
LARGEST = 1 << 27


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x * scale))).cast("int"))


def padded(df: DataFrame, column: str, multiple: int = 1) -> tuple[DataFrame, int, int]:
    """df with all vectors as long as the longest (a multiple), zeros at their ends; that length, and the largest magnitude."""
    seen = df.agg(F.coalesce(F.max(F.size(column)), F.lit(0)).alias("n"), F.coalesce(F.max(F.array_max(F.transform(column, F.abs))), F.lit(0)).alias("m")).first()
    width = -(-seen["n"] // multiple) * multiple
    more = F.array_repeat(F.lit(0), F.lit(width) - F.size(column))
    return df.withColumn(column, F.concat(column, more.cast("array<int>"))), width, seen["m"]


def exact_type(width: int, largest: int) -> type:
    """The type in which products of such vectors are exact: float64 while they stay below 2**52, as that multiplies fast."""
    return np.float64 if 4 * max(1, width) * max(1, largest) ** 2 < 1 << 52 else np.int64


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
