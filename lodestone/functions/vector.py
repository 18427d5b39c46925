"""Vector functions over ``array<float>`` columns, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_NORM = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length; 1e-10 for a null vector's sake of division."""
    n = F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n == 0, LEAST_NORM).otherwise(n)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1]; all zero where the range is below 1e-12."""
    return F.when(high - low < 1e-12, 0.0).otherwise((value - low) / (high - low))
