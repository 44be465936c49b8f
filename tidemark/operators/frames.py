"""What every rule looks at: an event, its window, and the observation before it.

``event_frames`` produces, for events in time order, one row per event with

``points``, ``oldest_us``, ``newest_us``  size and ends of the observations in [at - window, at], the newest ``cap`` of them
``base_n``, ``base_mean``, ``base_sd``  the same without the newest, where a rule of the stream compares values
``runs``      for each bound of the stream where the values past it begin, and how many they are
``last_ids``  the ids of the newest ``IDS`` of them
``prev``      the newest retained observation of another id at or before the event
``terminal``  whether the event ends its key

The out-of-order replay and the streaming detector produce the same columns, so the
rules in ``operators.rules`` are written once.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.cases import per_stream
from tidemark.functions.scalars import is_terminal
from tidemark.operators.blocks import with_blocks
from tidemark.operators.keyed_window import Geometry
from tidemark.operators.sliding import STATISTICS, SUMMARY, Windows
from tidemark.profiles import Profile, micros



def stall_deadline(profiles: Mapping[str, Profile], at_us: Column) -> Column:
    """When silence after ``at_us`` counts as a stall; null where nobody looks for it."""
    return at_us + per_stream(profiles, lambda p: micros(p.stall.after) if p.stall else None)


def check_in_order(profiles: Mapping[str, Profile]) -> None:
    for p in profiles.values():
        if p.stall and p.stall.after < p.cooldown:
            raise ValueError(
                f"profile {p.stream!r}: a stall could fall into its own cooldown and keep the "
                "key alive, which depends on arrival order; use operators.replay for it"
            )


def prepare(events: DataFrame) -> DataFrame:
    """Add the order columns: ``at_us`` and, where the source gave none, ``seq``. A missing value counts as 0."""
    out = events.withColumn("at_us", F.unix_micros("at")).withColumn("value", F.coalesce("value", F.lit(0.0)))
    if "seq" not in events.columns:
        out = out.withColumn("seq", F.col("id"))
    return out


def blocked(events: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    return with_blocks(prepare(events), profiles)


def _entity_window():
    return Window.partitionBy("stream", "key", "block").orderBy("at_us", "seq")


def with_resets(rows: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Mark the rows at which a key starts afresh: after a terminal event, or after a
    silence that was long enough to be reported."""
    w = _entity_window()
    before = F.lag(F.struct("id", "at_us", "geo", "terminal")).over(w)
    rows = rows.withColumn("terminal", is_terminal(F.col("labels"))).select(
        "*",
        F.row_number().over(w).cast("long").alias("n"),
        before.alias("before"),
        F.lead(F.struct("at_us", "own")).over(w).alias("next"),
    )
    silent = F.col("at_us") >= stall_deadline(profiles, F.col("before.at_us"))
    reset = F.coalesce(F.col("before.terminal"), F.lit(False)) | F.coalesce(silent, F.lit(False))
    return rows.withColumn("reset", reset)


def event_frames(
    events: DataFrame, profiles: Mapping[str, Profile], as_of: datetime | int | None = None,
    with_statistics: bool = False,
) -> DataFrame:
    """Frames of valid events, ordered by (at, seq); seq defaults to the event id.

    One shuffle on (stream, key, block) and one sort serve every column: windows to the row before, the next and the key's start run in
    Spark, and the statistics of the sliding window in one pass over the sorted rows (see ``operators.sliding``). No window is kept as an array.
    ``as_of`` is the present: silence is judged up to it.
    ``with_statistics`` adds mean and deviation of the whole window, and how many points are held, those in grace included.
    """
    check_in_order(profiles)
    w = _entity_window()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = with_resets(blocked(events, profiles), profiles)
    # The observation before: a redelivered copy of the event itself is looked through.
    new_id = F.col("before").isNull() | (F.col("before.id") != F.col("id"))
    predecessor = F.struct(F.col("before.id").alias("id"), F.col("before.at_us").alias("at_us"),
                           F.col("before.geo").alias("geo"), (F.col("n") - 1).alias("n"))
    rows = rows.select(
        "*",
        F.coalesce(F.max(F.when(F.col("reset"), F.col("n"))).over(upto), F.lit(1).cast("long")).alias("first_n"),
        F.last(F.when(new_id, predecessor), ignorenulls=True).over(upto).alias("pred"),
    )
    rows = rows.withColumn("stall_us", stall_deadline(profiles, F.col("at_us")).cast("long"))
    # Judged where the next event is in sight: in the row's own block, or, for the last
    # row before a block, there. The last row of a key has only the present after it.
    next_us, in_sight = F.col("next.at_us"), F.col("own") | F.coalesce(F.col("next.own"), F.lit(False))
    ended = F.col("next").isNull() & (F.col("block") == F.col("last_block"))
    stalled = ~F.col("terminal") & in_sight & (ended | (next_us >= F.col("stall_us")))
    if as_of is not None:
        stalled = stalled & (F.col("stall_us") <= F.lit(_us(as_of)))
    rows = rows.withColumn("stalled", F.coalesce(stalled, F.lit(False)))

    keep = per_stream(profiles, lambda p: p.cap)
    oldest_n = F.greatest(F.col("first_n"), F.col("n") - keep + 1)
    retained_us = F.col("at_us") - per_stream(profiles, lambda p: micros(p.retention))
    prev = F.when(
        (F.col("pred.n") >= oldest_n) & (F.col("pred.at_us") >= retained_us) & F.col("pred.id").isNotNull(),
        F.struct(F.col("pred.id").alias("id"), F.col("pred.at_us").alias("at_us"), F.col("pred.geo").alias("geo")),
    )
    rows = rows.sortWithinPartitions("stream", "key", "block", "at_us", "seq").select(
        "stream", "key", "id", "at", "at_us", "value", "unit", "geo", "seq", "own", "stalled", "stall_us", "terminal", prev.alias("prev"), "n", "first_n",
    )
    added = StructType.fromDDL(f"{SUMMARY}, {STATISTICS}" if with_statistics else SUMMARY)
    windows = Windows({name: Geometry.of(p) for name, p in profiles.items()}, with_statistics)
    return rows.mapInArrow(windows, StructType([*rows.schema.fields, *added.fields])).filter(F.col("own") | F.col("stalled")).drop("n", "first_n")


def _us(t: datetime | int) -> int:
    if isinstance(t, int):
        return t
    t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
