"""The plain ``events`` table (event_id, ts, user_id, event_type, value, props) seen as
detection input, alert history and raw log.

Users' events are hours apart, so the profiles here work on days. Values are taken in
hundredths: whole numbers, whose sums are exact in any order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.rules import EVALUATORS, Finding
from tidemark.profiles import (
    PAYMENTS, SENSORS, VIDEO, GeoVelocity, Profile, Stall, Threshold, Velocity, ZScore,
)
from tidemark.sources.records import rfc3339

_d, _h = (lambda n: timedelta(days=n)), (lambda n: timedelta(hours=n))

AS_OF = datetime(2024, 2, 1)

PROFILES = (
    Profile(PAYMENTS, _d(7), _h(1), 256, _d(1),
            (Velocity(3, _d(7)), GeoVelocity(150, 100), ZScore(1.5, 2, min_delta=1000, below=True))),
    Profile(VIDEO, _d(7), _h(2), 256, _d(1),
            (Velocity(7, _d(7)), Stall(_d(2)), Threshold(6000, False, _h(36))), sweep_every=_h(1)),
    Profile(SENSORS, _d(7), _h(3), 8, _d(1),
            (Threshold(2000, True, _h(24)), ZScore(2, 5, min_delta=1000), Velocity(6, _d(7)), Stall(_d(3))),
            sweep_every=_h(1)),
)


@dataclass(frozen=True)
class Offline(Stall):
    """Silence with a sentence of its own."""

    name: str = field(default="offline", init=False)


def _offline(frames: DataFrame, of) -> tuple[DataFrame, Finding]:
    idle = (F.col("stall_us") - F.col("at_us")) / 1e6
    return frames, Finding(
        "offline", of.here() & F.col("stalled"), idle, of.get(lambda r: r.after.total_seconds()), F.array("id"), absence=True,
        detail=F.concat(F.lit("last value "), F.col("value").cast("long")), evidence=F.to_json(F.struct("value")),
    )


EVALUATORS[Offline] = _offline
#: A high and a low bound on one stream, and a sweeper of our own.
BOUNDS = (
    Profile(SENSORS, _d(7), _h(3), 8, _d(1), (Threshold(2000, True, _h(24)), Threshold(3000, False, _h(12)), Offline(_d(3))), sweep_every=_h(1)),
)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _stream() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "purchase", PAYMENTS)
        .when(kind.isin("view", "click"), VIDEO)
        .when(kind.isin("error", "signup"), SENSORS)
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return as_events(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def as_events(table: DataFrame) -> DataFrame:
    """Events; an id's order is its number, so ``seq`` is that number."""
    k = _k()
    stream = _stream()
    unit = F.when(stream == PAYMENTS, "BRL").when(stream == VIDEO, "fps").otherwise("µg/m³")
    geo = F.struct((k * 1.6 - 80).cast("double").alias("lat"), (k * 3.6 - 180).cast("double").alias("lon"), F.lit("").alias("place"))
    return table.select(
        F.col("event_id").cast("string").alias("id"),
        stream.alias("stream"),
        F.concat(F.lit("user-"), F.col("user_id")).alias("key"),
        F.col("ts").cast("timestamp").alias("at"),
        F.round(F.col("value") * 100).alias("value"),
        unit.alias("unit"),
        F.when(stream != VIDEO, geo).alias("geo"),
        F.create_map(F.lit("status"), F.when(k >= 98, "done").otherwise("running")).alias("labels"),
        F.col("event_id").alias("seq"),
    )


def in_arrival_order(rows: DataFrame) -> DataFrame:
    """Delay each record by up to 499 places; ``seq`` numbers the arrivals."""
    n = F.col("id").cast("long")
    return rows.withColumn("seq", (n + (n * 7919) % 499) * 10000 + n % 10000)


def with_faults(rows: DataFrame) -> DataFrame:
    """One record in fifty each without id, key, time or a known stream."""
    m = F.col("id").cast("long") % 50
    return rows.select(
        F.col("seq").alias("event_id"),
        F.when(m == 7, "").otherwise(F.col("id")).alias("id"),
        F.when(m == 13, "telemetry").otherwise(F.col("stream")).alias("stream"),
        F.when(m == 11, "").otherwise(F.col("key")).alias("key"),
        F.when(m != 17, F.col("at")).alias("at"),
        "value", "unit", "geo", "labels", "seq",
    )


def raw_records(rows: DataFrame) -> DataFrame:
    """The events as JSON log records, some of them broken."""
    n = F.col("id").cast("long")
    m = n % 40
    body = F.to_json(F.struct("id", "stream", "key", rfc3339(F.col("at")).alias("at"), "value", "unit", "geo", "labels"))
    broken = (
        F.when(m == 3, F.lit('{"broken":'))
        .when(m == 5, F.concat(F.lit('{"id":'), n, F.lit("}")))
        .when(m == 9, F.lit('{"id":"x","value":"12"}'))
        .when(m == 15, F.lit("[1,2]"))
        .when(m == 21, F.lit('{"stream":"video"}'))
        .otherwise(body)
    )
    return rows.select(
        "key", broken.alias("value"), F.lit("events").alias("topic"),
        (n % 4).cast("int").alias("partition"), n.alias("offset"), F.col("at").alias("timestamp"),
    )


def alert_history(rows: DataFrame) -> DataFrame:
    """Alerts one might have stored: a rule, severity and detection delay per event."""
    n = F.col("id").cast("long")
    # Up to a second later; every 17th detected before it happened, every 11th a silence.
    delay_us = F.when(n % 17 == 0, F.lit(-1_500_000)).otherwise((n * 7919) % 1_000_003)
    rule = F.when(n % 11 == 0, "stall").when(n % 3 == 0, "velocity").when(n % 3 == 1, "zscore").otherwise("threshold")
    severity = F.when(n % 7 == 0, "critical").when(n % 7 < 3, "warn").otherwise("info")
    return rows.select(
        F.concat(F.lit("a-"), n).alias("id"), rule.alias("rule"), "stream", "key", "at",
        F.timestamp_micros(F.unix_micros("at") + delay_us).alias("detected_at"),
        severity.alias("severity"), rule.alias("title"), F.concat(F.lit("value "), F.col("value").cast("long")).alias("detail"),
        F.to_json(F.struct(F.col("value").cast("long").alias("value"))).alias("evidence"),
        F.array("id").alias("event_ids"), (n % 11 == 0).alias("absence"),
    )
