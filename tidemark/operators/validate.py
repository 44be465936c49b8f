"""Validation, and the dead letters of what fails it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.profiles import STREAMS, Profile
from tidemark.schema import DEAD_LETTER

# Fixed value: the zero event time, year one.
ZERO_TIME_US = -62135596800000000


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def invalid_reason(streams: Iterable[str] = STREAMS) -> Column:
    """Why an event cannot be processed; the first failing check names the reason."""
    stream = F.coalesce(F.col("stream"), F.lit(""))
    at_us = F.unix_micros("at")
    return (
        F.when(_blank(F.col("id")), F.lit("invalid event: empty id"))
        .when(~stream.isin(*streams), F.concat(F.lit('invalid event: unknown stream "'), stream, F.lit('"')))
        .when(_blank(F.col("key")), F.lit("invalid event: empty key"))
        .when(at_us.isNull() | (at_us == ZERO_TIME_US), F.lit("invalid event: zero event time"))
    )


def no_profile_reason(profiles: Iterable[str]) -> Column:
    """A valid event of a stream nobody configured."""
    known = list(profiles)
    missing = ~F.col("stream").isin(*known) if known else F.lit(True)
    return F.when(
        missing, F.concat(F.lit('invalid event: no profile for stream "'), F.col("stream"), F.lit('"'))
    )


def with_reason(events: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Add ``reason``, null for events that can be processed. An earlier ``reason``, as
    the decoder leaves one, takes precedence. Profiles may bring streams of their own."""
    streams = [*STREAMS, *[s for s in profiles if s not in STREAMS]]
    reason = F.coalesce(invalid_reason(streams), no_profile_reason(profiles))
    if "reason" in events.columns:
        reason = F.coalesce(F.col("reason"), reason)
    return events.withColumn("reason", reason)


def split_valid(events: DataFrame, profiles: Mapping[str, Profile]) -> tuple[DataFrame, DataFrame]:
    """(valid events, invalid ones with their reason). Both are plain filters."""
    judged = with_reason(events, profiles)
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def dead_letters(rejected: DataFrame, at: Column | None = None) -> DataFrame:
    """Dead letters keep where a record came from, its bytes, the reason and the time.

    ``rejected`` has the record's ``topic``, ``partition``, ``offset``, ``key`` (as
    ``record_key`` if the event brings a key of its own), ``payload`` and ``reason``.
    """
    key = "record_key" if "record_key" in rejected.columns else "key"
    return rejected.select(
        "topic", "partition", "offset", F.col(key).alias("key"), "reason",
        (F.current_timestamp() if at is None else at).alias("at"),
        "payload",
    ).select(DEAD_LETTER.fieldNames())
