"""Products over streams: the matrix arrives as a stream of entries, the vector is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_spmv(entries: DataFrame, x: DataFrame) -> DataFrame:
    """A streaming (row, col, value) relation times a static vector, as a running grouped sum.

    The product is linear in the entries, so each micro-batch adds its own part: the state is one sum for each output
    index, and the stream-static join keeps none. Write with output mode "update" or "complete".
    """
    x = x.select(F.col("idx").alias("col"), F.col("value").alias("x"))
    products = entries.join(x, "col").select(F.col("row").alias("idx"), (F.col("value") * F.col("x")).alias("value"))
    return products.groupBy("idx").agg(F.sum("value").alias("value"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event-time counts by key and tumbling window; state older than the watermark is dropped."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs an instant, not a wall-clock time
    windowed = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key))
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
