"""Structured Streaming forms of a few features; the batch functions are the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def onset_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, piece_id, onsets): tumbling windows over a stream of (piece_id, ts, velocity)."""
    return events.withWatermark("ts", late).where("velocity > 0").groupBy(F.window("ts", window), "piece_id").agg(F.count(F.lit(1)).alias("onsets"))


def phrases(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(session, piece_id, notes): phrases are runs of onsets without a silence of ``gap``."""
    return events.withWatermark("ts", late).where("velocity > 0").groupBy(F.session_window("ts", gap), "piece_id").agg(F.count(F.lit(1)).alias("notes"))
