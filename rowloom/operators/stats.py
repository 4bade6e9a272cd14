"""Summaries of vectors, matrices and tensors, each in a single aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import not_zero


def dimensions(coo: DataFrame) -> DataFrame:
    """num_rows, num_cols, nnz and sparsity, as far as entries go."""
    d = coo.agg((F.max("row") + 1).alias("num_rows"), (F.max("col") + 1).alias("num_cols"), F.count(F.lit(1)).alias("nnz"))
    return d.withColumn("sparsity", F.lit(1.0) - F.col("nnz").cast("double") / (F.col("num_rows") * F.col("num_cols")).cast("double"))


def _extremes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Largest and smallest magnitude (the smallest over non-zeros), ties to the smallest index."""
    size = F.abs("value")
    least_first = F.struct(size.alias("m"), *keys, "value")
    most_first = F.struct((-size).alias("m"), *keys, "value")
    out = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
        F.min(most_first).alias("top"),
        F.min(F.when(not_zero("value"), least_first)).alias("low"),
    )
    picked = [F.col(f"{s}.{k}").alias(f"{name}_{k}") for s, name in (("top", "max"), ("low", "min")) for k in (*keys, "value")]
    return out.select("n", "total", *picked)


def vector_stats(v: DataFrame) -> DataFrame:
    """Count, sum and the entries of largest and smallest magnitude; an empty vector gives a count of 0 and nulls."""
    return _extremes(v, ["idx"])


def matrix_stats(coo: DataFrame) -> DataFrame:
    return _extremes(coo, ["row", "col"])


def tensor_stats(t: DataFrame) -> DataFrame:
    out = t.agg(*((F.max(c) + 1).alias(f"dim_{c}") for c in "ijk"), F.count(F.lit(1)).alias("nnz"))
    cells = F.col("dim_i") * F.col("dim_j") * F.col("dim_k")
    return out.withColumn("total_elements", cells).withColumn("sparsity", F.lit(1.0) - F.col("nnz").cast("double") / cells.cast("double"))


def estimate_size(df: DataFrame, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """A row count scaled up from a sample, beside the partitions it came from: this is the sampling operator."""
    counted = df.sample(False, fraction, seed).agg(F.count(F.lit(1)).alias("sampled"))
    return counted.select("sampled", F.round(F.col("sampled") / F.lit(fraction)).cast("long").alias("estimated"))
