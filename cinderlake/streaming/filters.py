"""Streaming extension: the structured event filter and windowed counts on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_filter(events: DataFrame, types: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive time range and IN-list; an empty list sets no bound, null never matches a list. Batch or stream."""
    out = events.where(F.col("event_type").isin(types)) if types else events
    out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz")) if start else out
    return out.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz")) if end else out


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window; rows later than the watermark are dropped. ts must be a timestamp."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
