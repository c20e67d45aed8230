"""Event-time windows over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, by: list[str], size: str, slide: str | None = None, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts by group in tumbling or sliding windows: start, by, n. Rows later than late may be dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(stream: DataFrame, by: list[str], gap: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Counts by group in sessions that end after a gap: start, by, n."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def dedup_approximate(stream: DataFrame, key: str, ttl: str = "24 hours", ts: str = "ts") -> DataFrame:
    """First sightings within a time to live, by the watermark: a key may stay suppressed for a batch too long."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
