"""Streaming composites: scenes as they come, one value per pixel and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_composites(observations: DataFrame, width: str = "30 days", late: str = "10 days", accuracy: int = 10000) -> DataFrame:
    """pixel_id, start, end, value, n_valid, n_masked of closed time windows.

    ``observations`` is a stream (or a table) with pixel_id, obs_ts and value; a
    null value was masked.  Rows later than the watermark are dropped.  The
    median of a stream cannot be merged exactly, so the value is an approximate
    percentile whose state is bounded; use ``operators.windows.composite`` on
    stored rows for the exact one.
    """
    held = observations.withWatermark("obs_ts", late)
    out = held.groupBy("pixel_id", F.window("obs_ts", width)).agg(
        F.percentile_approx("value", 0.5, accuracy).alias("value"), F.count("value").alias("n_valid"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_masked")
    )
    return out.select("pixel_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "value", "n_valid", "n_masked")
