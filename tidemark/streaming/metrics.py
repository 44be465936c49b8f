"""Tumbling metrics on a stream: each window once, when its grace is over."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame

from tidemark.operators.metrics import interval, tumbling
from tidemark.sources.records import metric_inputs

WINDOW, GRACE = timedelta(seconds=10), timedelta(seconds=5)  # fixed values


def metrics_stream(raw: DataFrame, size: timedelta = WINDOW, grace: timedelta = GRACE) -> DataFrame:
    """Metrics rows of raw records; write them in append mode.

    The watermark trails the newest event by ``grace`` and append mode holds a window
    back until the watermark has passed its end. The watermark is one for the whole
    query and moves between micro-batches, so a record later than the grace may still
    be counted, never the other way round.
    """
    return tumbling(metric_inputs(raw).withWatermark("at", interval(grace)), size)
