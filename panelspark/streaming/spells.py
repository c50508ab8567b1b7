"""Streams: the batch operators' sessions and counts with watermarks. An addition; batch results don't depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_spells(events: DataFrame, ts: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Spells by time: sessions of each key that end after ``gap`` without an event; events later than ``late`` are left out."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), *keys)
        .agg(F.count("*").alias("n_observations"))
        .select(*keys, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n_observations")
    )


def stream_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts in tumbling windows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")
