"""Plain statistics of an event's window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import millis
from tidemark.operators.rules import velocity_rate


def window_stats(frames: DataFrame) -> DataFrame:
    """count, mean, population deviation, span and rate of each frame's window; the ids of
    the newest point and the one before. Mean is 0 when empty, deviation and span are 0
    below two points. ``frames`` come with statistics (see ``frames.event_frames``)."""
    span_us = F.col("newest_us") - F.col("oldest_us")
    return frames.select(
        "*",
        F.col("points").cast("long").alias("count"),
        millis(span_us).alias("span_ms"),
        velocity_rate(F.col("points"), span_us).alias("per_second"),
        F.try_element_at("last_ids", F.lit(-2)).alias("previous_id"),
        F.try_element_at("last_ids", F.lit(-1)).alias("last_id"),
    )
