"""Events as a stream: windowed statistics with a watermark. The batch engine has no such operator; this is beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events (ts, event_type, value), batch or streaming -> start, event_type, n, total: counts and sums by window and type."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", late) if events.isStreaming else events
    return w.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
