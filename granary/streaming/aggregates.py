"""Incremental GROUP BY on streams; batch and stream share the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_per_window(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Rows per key and tumbling window; state older than the watermark is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
