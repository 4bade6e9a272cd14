"""Text results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_vector(v: DataFrame, path: str, mode: str = "error") -> None:
    """idx,value lines in index order across part files (a range-partitioned sort, not a single task)."""
    v.orderBy("idx").select(F.concat_ws(",", "idx", "value").alias("value")).write.mode(mode).text(path)


def save_matrix(m: DataFrame, path: str, ordered: bool = True, mode: str = "error") -> None:
    """row,col,value lines; unordered saves skip the sort."""
    m = m.orderBy("row", "col") if ordered else m
    m.select(F.concat_ws(",", "row", "col", "value").alias("value")).write.mode(mode).text(path)
