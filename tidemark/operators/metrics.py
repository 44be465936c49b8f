"""Tumbling-window aggregates per stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import round2_up
from tidemark.profiles import micros


def interval(d: timedelta) -> str:
    return f"{micros(d)} microseconds"


def tumbling(inputs: DataFrame, size: timedelta = timedelta(seconds=10)) -> DataFrame:
    """count, sum, mean, min, max and rate per (stream, window) of (stream, at, value).

    Spark aggregates inside every task first, so what is shuffled is one row per stream,
    window and task, however the events are spread. On a stream, put ``withWatermark``
    before it (see ``streaming.metrics``). Rows without a value are left out.
    """
    grouped = inputs.filter("value is not null").groupBy(F.window("at", interval(size)), "stream").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("value").alias("total"),
        F.avg("value").alias("average"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    )
    ms = micros(size) / 1000
    return grouped.select(
        "stream",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "count",
        round2_up(F.col("total")).alias("sum"),
        round2_up(F.col("average")).alias("mean"),
        round2_up(F.col("least")).alias("min"),
        round2_up(F.col("most")).alias("max"),
        round2_up(F.col("count") * 1000.0 / ms).alias("per_second"),
    )


def closed(metrics: DataFrame, inputs: DataFrame, grace: timedelta = timedelta(seconds=5)) -> DataFrame:
    """Windows that no row can join any more: the newest time of ``inputs`` is ``grace`` past their end. The stream emits them by the same rule."""
    mark = inputs.agg((F.max("at") - F.expr(f"INTERVAL {micros(grace) / 1e6:.6f} SECOND")).alias("mark"))
    return metrics.join(F.broadcast(mark), F.col("window_end") <= F.col("mark")).drop("mark")


def latest_windows(metrics: DataFrame) -> DataFrame:
    """The newest window of each stream; of ``closed`` ones the newest that is final."""
    rest = [c for c in metrics.columns if c != "stream"]
    newest = F.max_by(F.struct(*rest), F.col("window_end"))
    return metrics.groupBy("stream").agg(newest.alias("w")).select("stream", "w.*")
