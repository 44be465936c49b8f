from datetime import datetime, timedelta, timezone

from tidemark.schema import EVENT

T0 = datetime(2026, 9, 2, 12, tzinfo=timezone.utc)
T0_US = (T0 - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def us(seconds: float) -> int:
    return T0_US + round(seconds * 1e6)


def event(id, stream, key, seconds, value=1.0, geo=None, status=None, unit="u", place=None):
    return {
        "id": id, "stream": stream, "key": key, "at": at(seconds), "value": float(value), "unit": unit,
        "geo": None if geo is None else {"lat": geo[0], "lon": geo[1], "place": place},
        "labels": None if status is None else {"status": status},
    }


def events(spark, rows):
    rows = [tuple(r[f] for f in EVENT.fieldNames()) for r in rows]
    return spark.createDataFrame(rows, EVENT)


def alert_tuples(df):
    """(rule, stream, key, at, detected, severity, ids), times in microseconds."""
    from pyspark.sql import functions as F

    rows = df.select(
        "rule", "stream", "key", F.unix_micros("at").alias("a"), F.unix_micros("detected_at").alias("d"),
        "severity", "event_ids",
    ).collect()
    return sorted((r.rule, r.stream, r.key, r.a, r.d, r.severity, tuple(r.event_ids)) for r in rows)
