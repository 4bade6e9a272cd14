"""Seeded synthetic inputs, generated in parallel from spark.range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _unit(seed: int, *cols: str) -> Column:
    """A number in [0, 1) that depends on the cell alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(2**52)) / F.lit(float(2**52))).cast("double")


def sparse_matrix(spark: SparkSession, rows: int, cols: int, sparsity: float = 0.95, seed: int = 42) -> DataFrame:
    """Each cell is kept with chance 1 - sparsity, so coordinates are unique; values are roughly normal, times 10."""
    cells = spark.range(rows * cols).where(_unit(seed, "id") >= F.lit(sparsity))
    spread = sum((_unit(seed + k, "id") for k in range(1, 13)), F.lit(-6.0)) * 10
    return cells.select(F.expr(f"id div {cols}L").alias("row"), F.expr(f"id % {cols}L").alias("col"), spread.alias("value"))


def dense_matrix(spark: SparkSession, rows: int, cols: int, seed: int = 42) -> DataFrame:
    return sparse_matrix(spark, rows, cols, 0.0, seed)


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value"))


def dense_vector(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), (_unit(seed, "id") * 30 - 15).alias("value"))


def sparse_vector(spark: SparkSession, n: int, sparsity: float = 0.95, seed: int = 42) -> DataFrame:
    return dense_vector(spark, n, seed).where(_unit(seed + 7, "idx") >= F.lit(sparsity))


def tensor(spark: SparkSession, dims: tuple[int, int, int], density: float = 0.05, seed: int = 42) -> DataFrame:
    i, j, k = dims
    cells = spark.range(i * j * k).where(_unit(seed, "id") < F.lit(density))
    value = F.round(_unit(seed + 1, "id") * 9.9 + 0.1, 6)
    return cells.select(F.expr(f"id div {j * k}L").alias("i"), F.expr(f"(id div {k}L) % {j}L").alias("j"), F.expr(f"id % {k}L").alias("k"), value.alias("value"))


def factor(spark: SparkSession, rows: int, rank: int, seed: int = 42) -> DataFrame:
    cells = spark.range(rows * rank)
    return cells.select(F.expr(f"id div {rank}L").alias("idx"), F.expr(f"id % {rank}L").alias("r"), _unit(seed, "id").alias("value"))
