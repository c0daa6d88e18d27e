"""Windowed composites of an event stream: the streaming form of interval aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def composite(events: DataFrame, width: str = "7 days", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """start, r, c, n and mean of each window and cell; works on a stream (rows later than ``late`` are dropped) and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    cell = [(F.col("user_id") % 8).cast("int").alias("r"), (F.floor(F.col("user_id") / 8).cast("int") % 8).alias("c")]
    return rows.groupBy(window.alias("w"), *cell).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "r", "c", "n", "mean")
