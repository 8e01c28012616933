"""Streams of events: counts by window, and the latest reading of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; works on a stream (late rows dropped past the watermark) and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each user and type, by time then id: a partial maximum, no sort."""
    last = F.max(F.struct("ts", "event_id")).alias("last")
    return events.groupBy("user_id", "event_type").agg(last, F.count(F.lit(1)).alias("n")).select("user_id", "event_type", F.col("last.event_id").alias("event_id"), "n")
