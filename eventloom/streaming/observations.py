"""Structured Streaming over observations with an event time: spans, windowed counts, first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_spans(obs: DataFrame, gap: str = "6 hours", late: str = "1 hour", time: str = "event_time") -> DataFrame:
    """Sessions of a clip's observations that lie less than gap apart; a span is emitted once the watermark passes its end."""
    spans = obs.withWatermark(time, late).groupBy("clip_id", F.session_window(time, gap)).agg(F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.count("*").alias("n"))
    return spans.drop("session_window")


def window_counts(obs: DataFrame, length: str = "1 day", slide: str = "12 hours", late: str = "1 hour", time: str = "event_time") -> DataFrame:
    """Observations of a clip per sliding window."""
    counts = obs.withWatermark(time, late).groupBy("clip_id", F.window(time, length, slide)).agg(F.count("*").alias("n"))
    return counts.select("clip_id", F.col("window.start").alias("t_start"), F.col("window.end").alias("t_end"), "n")


def first_rows(events: DataFrame, key: str = "event_id", late: str = "1 hour", time: str = "event_time") -> DataFrame:
    """The first row of each key; state is dropped once the watermark passes."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
