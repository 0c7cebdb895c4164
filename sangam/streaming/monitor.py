"""Daily drift monitor as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """(day, event_type, n, total) per day; works on streams (late rows within ``delay``) and tables."""
    w = events.withWatermark("ts", delay) if events.isStreaming else events
    g = w.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n", "total")
