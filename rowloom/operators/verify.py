"""Differential check of two relations that should be equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def differences(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Rows whose key is on one side only, or whose values differ by more than the tolerance (null-safe keys)."""
    left = a.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.col("value").alias("a_value"), F.lit(True).alias("in_a"))
    right = b.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col("value").alias("b_value"), F.lit(True).alias("in_b"))
    on = reduce(lambda x, y: x & y, (F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys))
    both = left.join(right, on, "full")
    nan = F.isnan("a_value") & F.isnan("b_value")
    apart = (F.abs(F.col("a_value") - F.col("b_value")) > tolerance) & ~nan
    bad = F.col("in_a").isNull() | F.col("in_b").isNull() | F.coalesce(apart, ~F.col("a_value").eqNullSafe(F.col("b_value")))
    return both.where(bad).select(*(F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys), "a_value", "b_value")


def summary(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """One row: how many rows differ and the largest difference among matched ones."""
    bad = differences(a, b, keys, tolerance)
    return bad.agg(F.count(F.lit(1)).alias("mismatches"), F.coalesce(F.max(F.abs(F.col("a_value") - F.col("b_value"))), F.lit(0.0)).alias("max_error"))
