"""Index-value text files.

Lenient readers skip malformed lines and drop zeros; strict readers fail the job on the first malformed line and keep
zeros. Both skip header lines by prefix and blank lines, trim fields and ignore extra ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import not_zero

LENIENT, DENSE = "lenient", "strict"


def _lines(spark: SparkSession, path: str, header: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.where(~F.col("value").startswith(header) & (F.trim("value") != ""))


def _parse(lines: DataFrame, names: list[str], strict: bool) -> DataFrame:
    parts: Column = F.split("value", ",", -1)
    fields = lines.select(F.col("value").alias("line"), parts.alias("p"))

    def field(k: int, kind: str) -> Column:
        # an index like 1.0 is malformed: integer text only
        raw = F.trim(F.get("p", F.lit(k)))
        if kind == "long":
            raw = F.when(raw.rlike(r"^[+-]?\d+$"), raw)
        return raw.try_cast(kind)

    kinds = ["long"] * (len(names) - 1) + ["double"]
    parsed = fields.select("line", *(field(k, kind).alias(n) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))))
    complete = " and ".join(f"{n} is not null" for n in names)
    if not strict:
        return parsed.where(complete).select(*names)
    checked = F.when(F.expr(complete), F.col(names[-1])).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.col("line"))).cast("double"))
    # the check sits in the value column, and the index columns are re-read from it so that pruning cannot skip it
    return parsed.select(F.struct(*names[:-1], checked.alias(names[-1])).alias("s")).select(*(F.col(f"s.{n}").alias(n) for n in names)).where(F.col(names[-1]).isNotNull())


def load_sparse_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Lenient (row, col, value)."""
    return _parse(_lines(spark, path, "row"), ["row", "col", "value"], strict=False).where(not_zero("value"))


def load_dense_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Strict (row, col, value)."""
    return _parse(_lines(spark, path, "row"), ["row", "col", "value"], strict=True)


def load_sparse_vector(spark: SparkSession, path: str) -> DataFrame:
    """Lenient (idx, value)."""
    return _parse(_lines(spark, path, "index"), ["idx", "value"], strict=False).where(not_zero("value"))


def load_dense_vector(spark: SparkSession, path: str) -> DataFrame:
    """Strict (idx, value)."""
    return _parse(_lines(spark, path, "index"), ["idx", "value"], strict=True)


def load_tensor(spark: SparkSession, path: str) -> DataFrame:
    """Strict (i, j, k, value) without zeros."""
    return _parse(_lines(spark, path, "i"), ["i", "j", "k", "value"], strict=True).where(not_zero("value"))
