"""Layout conversions, all with built-in array functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: layout -> (key column, packed index column, unpacked index column)
PACKED = {"csr": ("row", "col_indices", "col"), "csc": ("col", "row_indices", "row")}


def pack(coo: DataFrame, target: str) -> DataFrame:
    """One record for each row (csr) or column (csc) that has entries, sorted by the inner index; duplicates are kept."""
    if target == "coo":
        return coo
    key, packed, inner = PACKED[target]
    grouped = coo.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(inner, "value"))).alias("e"))
    return grouped.select(key, F.col(f"e.{inner}").alias(packed), F.col("e.value").alias("values"))


def unpack(df: DataFrame, layout: str) -> DataFrame:
    """Back to (row, col, value)."""
    if layout in ("coo", "dense"):
        return df.select("row", "col", "value")
    key, packed, inner = PACKED[layout]
    flat = df.select(key, F.inline(F.arrays_zip(packed, "values")))
    flat = flat.select(key, F.col(packed).alias(inner), F.col("values").alias("value"))
    return flat.select("row", "col", "value")


def fill(coo: DataFrame, num_rows: int, num_cols: int) -> DataFrame:
    """Every cell of the grid; absent ones are 0.0, duplicates stay as several rows.

    The grid is one spark.range over cell numbers, so it is generated in parallel and never on the driver.
    """
    cells = coo.sparkSession.range(num_rows * num_cols)
    grid = cells.select(F.floor(F.col("id") / F.lit(num_cols)).cast("long").alias("row"), (F.col("id") % F.lit(num_cols)).alias("col"))
    if num_rows * num_cols > 2**52:  # a double quotient is exact only below this
        grid = cells.selectExpr(f"id div {num_cols}L as row", f"id % {num_cols}L as col")
    return grid.join(coo, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def row_entries(csr: DataFrame, row: int) -> DataFrame:
    """The (col, value) entries of one packed row."""
    return unpack(csr.where(F.col("row") == row), "csr").select("col", "value")


def cell(coo: DataFrame, row: int, col: int) -> float:
    """First match or 0.0."""
    found = coo.where((F.col("row") == row) & (F.col("col") == col)).select("value").take(1)
    return found[0][0] if found else 0.0
