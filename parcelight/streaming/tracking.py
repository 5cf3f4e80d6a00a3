"""Tracking events as a stream (an extension: the engine is otherwise batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, lateness: str = "3 days") -> DataFrame:
    """Events once per id within the watermark; later ones are dropped by it."""
    return stream.withWatermark("event_ts", lateness).dropDuplicatesWithinWatermark(["tracking_event_id"])


def windowed_counts(stream: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    return stream.groupBy(F.window("event_ts", size, slide or size), "event_code").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_code", "n")


def sessions(stream: DataFrame, gap: str = "2 days", lateness: str = "3 days") -> DataFrame:
    """Bursts of scans per shipment; a session closes when the watermark has passed it."""
    return stream.withWatermark("event_ts", lateness).groupBy(F.session_window("event_ts", gap), "shipment_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "shipment_id", "n")
