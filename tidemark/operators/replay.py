"""Detection over a bounded set of events in the order they arrived.

Use this instead of ``plans.detect`` when records are late or out of order and the result
must be what a live detector would have said. Keys are stepped through in parallel; a
key's history is also cut wherever that provably changes nothing (see ``with_units``),
so one busy key does not have to be one task. Memory per task is one key's window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.functions.cases import per_stream
from tidemark.functions.scalars import is_terminal
from tidemark.operators.blocks import ENTITY, busy_keys
from tidemark.operators.cooldown import admit, numbered
from tidemark.operators.frames import _us
from tidemark.operators.keyed_window import Frame, Geometry, KeyedWindow, Point, base_of, runs_of
from tidemark.operators.rules import hits, write_up
from tidemark.operators.sliding import IDS, SUMMARY
from tidemark.operators.slices import Running, floor_div, running
from tidemark.operators.validate import split_valid
from tidemark.profiles import Profile, by_stream, micros

_GEO = "struct<lat:double,lon:double,place:string>"
FRAME = (
    "stream string, key string, kind string, id string, at_us long, value double, unit string, "
    f"geo {_GEO}, seq long, clock_us long, "
    f"{SUMMARY}, prev struct<id:string,at_us:long,geo:{_GEO}>, terminal boolean"
)
STEP_INPUT = ["stream", "key", "id", "at_us", "value", "unit", "lat", "lon", "place", "has_geo",
              "terminal", "seq", "now_us"]
ARRIVALS_PER_BLOCK = 1 << 20
BUSY_ROWS = 500_000


def step_input(events: DataFrame, now: Column | None = None) -> DataFrame:
    """The flat columns a step needs; ``seq`` is the arrival number, as an offset is."""
    return events.select(
        "stream", "key", "id", F.unix_micros("at").alias("at_us"), F.coalesce("value", F.lit(0.0)).alias("value"), "unit",
        F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"), F.col("geo.place").alias("place"),
        F.col("geo").isNotNull().alias("has_geo"), is_terminal(F.col("labels")).alias("terminal"),
        F.col("seq").cast("long").alias("seq"),
        (F.lit(None).cast("long") if now is None else F.unix_micros(now)).alias("now_us"),
    )


def as_rows(g: Geometry, stream: str, key: str, frames: Iterable[tuple[Frame, int, str | None]]) -> list[tuple]:
    """Output rows of frames with their arrival number and unit."""

    def geo(p: Point | None):
        return None if p is None or p.geo is None else dict(zip(("lat", "lon", "place"), p.geo))

    rows = []
    for f, seq, unit in frames:
        p, before = f.point, f.prev
        rows.append((
            stream, key, f.kind, p.id, p.at, p.value, unit, geo(p), seq, f.clock,
            len(f.window), f.window[0].at if f.window else None, f.window[-1].at if f.window else None, *base_of(g, f.window),
            [{"from_us": at, "n": n} for at, n in runs_of(g, f.window)], [q.id for q in f.window[-IDS:]],
            None if before is None else {"id": before.id, "at_us": before.at, "geo": geo(before)},
            f.terminal,
        ))
    return rows


FRAME_COLUMNS = ["stream", "key", "kind", "id", "at_us", "value", "unit", "geo", "seq", "clock_us",
                 *(c.split()[0] for c in SUMMARY.split(", ")), "prev", "terminal"]


def to_pandas(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=FRAME_COLUMNS)
    for c in ("at_us", "seq", "clock_us"):
        out[c] = out[c].astype("int64")
    # Whole numbers with gaps; floats cannot hold all microseconds.
    for c in ("oldest_us", "newest_us"):
        out[c] = out[c].astype("Int64")
    return out


def point_of(r) -> Point:
    return Point(r.at_us, r.id, r.value, (r.lat, r.lon, r.place) if r.has_geo else None)


def judged(frames: DataFrame) -> DataFrame:
    """Frames in the shape ``operators.rules`` expects, without the late ones."""
    return frames.filter("kind != 'late'").select(
        "*",
        F.timestamp_micros("at_us").alias("at"),
        (F.col("kind") == "event").alias("own"),
        (F.col("kind") == "stall").alias("stalled"),
        F.col("clock_us").alias("stall_us"),
    )


def with_units(events: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Cut each key's arrivals where the window is provably empty.

    An event more than window + grace newer than everything its key has sent before pushes
    all retained points out, so stepping may start there with nothing. On swept streams
    the silence before it must also be certain to be reported: no shorter than the
    cooldown, and no longer than the retention. Busy keys are also cut at arrival blocks,
    after ``warm`` rows: a copy of the block before, stepped through but not reported. Rows
    whose unit goes on in such a way have ``continues``.
    """
    eligible = per_stream(profiles, lambda p: not p.stall or p.cooldown <= p.stall.after <= p.retention)
    retention = per_stream(profiles, lambda p: micros(p.retention))
    block = floor_div(F.col("seq"), ARRIVALS_PER_BLOCK)
    newest = Running("newest_us", F.col("at_us"), "max")
    rows = running(events, ENTITY, ["seq"], [block], [newest], inclusive=False)
    fresh = F.col("newest_us").isNull() | (eligible & (F.col("at_us") > F.col("newest_us") + retention))
    rows = rows.withColumn("fresh", F.coalesce(fresh, F.lit(False)))
    opening, busy = F.col("fresh"), busy_keys(events, BUSY_ROWS)
    if not busy.isEmpty():
        rows = _with_cuts(rows.withColumn("blk", block), busy, profiles, eligible, retention)
        opening = opening | F.col("cut")
    opened = Running("unit_seq", F.when(opening, F.col("seq")), "last")
    rows = running(rows, ENTITY, ["seq"], [block], [opened]).withColumn("warm", F.lit(False))
    if "cut" not in rows.columns:
        return rows.withColumn("continues", F.lit(False)).drop("fresh", "newest_us")
    # Block b warms up the unit that starts with block b + 1.
    starts = rows.filter("cut").select(
        *ENTITY, (F.col("blk") - 1).alias("blk"), F.col("seq").alias("next_unit")
    )
    last_unit = F.max("unit_seq").over(Window.partitionBy(*ENTITY, "blk"))
    rows = rows.drop("fresh", "newest_us", "cut").join(starts, [*ENTITY, "blk"], "left")
    # Only the unit at the end of the block goes on; one that fell silent inside it does not.
    rows = rows.withColumn("continues", F.col("next_unit").isNotNull() & (F.col("unit_seq") == last_unit))
    warm = rows.filter("next_unit IS NOT NULL").withColumn("unit_seq", F.col("next_unit")).withColumn("warm", F.lit(True))
    return rows.unionByName(warm).drop("blk", "next_unit")


def _with_cuts(
    rows: DataFrame, busy: DataFrame, profiles: Mapping[str, Profile], eligible: Column, retention: Column
) -> DataFrame:
    """Mark the first row of each arrival block at which a busy key may be cut although it
    never falls silent.

    Stepping through the block before, from nothing, leads to the true state once nothing
    older can be left in it: when the block raised the key's newest time by more than the
    retention, or raised it ``cap`` times, so that ``cap`` newer points push out the rest.
    From the first such record on, mark, lateness and restarts are the true ones.
    """
    cap = per_stream(profiles, lambda p: p.cap)
    record = F.col("newest_us").isNull() | (F.col("at_us") > F.col("newest_us"))
    blocks = rows.join(busy.select(*ENTITY), ENTITY, "left_semi").groupBy(*ENTITY, "blk").agg(
        F.count_if(record).alias("records"), F.max("at_us").alias("top"), F.min("newest_us").alias("earlier"),
    )
    enough = (F.col("records") >= cap) | (F.col("top") > F.col("earlier") + retention)
    cuts = blocks.filter(eligible & enough).select(*ENTITY, (F.col("blk") + 1).alias("blk"), F.lit(True).alias("may_cut"))
    first = F.row_number().over(Window.partitionBy(*ENTITY, "blk").orderBy("seq")) == 1
    marked = rows.join(cuts, [*ENTITY, "blk"], "left").withColumn("first", first)
    return marked.withColumn(
        "cut", F.coalesce("may_cut", F.lit(False)) & F.col("first") & ~F.col("fresh")
    ).drop("may_cut", "first")


def late_arrivals(events: DataFrame, window: timedelta, grace: timedelta) -> DataFrame:
    """Add each key's ``mark`` at arrival, and ``late``, where no key ever restarts.

    For streams without terminal events and sweeps, such as payments, this says what
    stepping would say, as a plain scan. ``seq`` is the arrival order.
    """
    blocks = [floor_div(F.col("seq"), ARRIVALS_PER_BLOCK)]
    newest = Running("mark_us", F.unix_micros("at"), "max")
    rows = running(events, ["stream", "key"], ["seq"], blocks, [newest])
    late = F.unix_micros("at") < F.col("mark_us") - micros(window + grace)
    return rows.withColumn("late", late).withColumn("mark", F.timestamp_micros("mark_us")).drop("mark_us")


def replay_frames(
    events: DataFrame, profiles: Mapping[str, Profile], as_of: datetime | int | None = None
) -> DataFrame:
    """Frames of valid events with a numeric arrival order ``seq``, unique per key."""
    geometry = {name: Geometry.of(p) for name, p in profiles.items()}
    until = None if as_of is None else _us(as_of)
    by = ["stream", "key", "unit_seq"]
    rows = with_units(step_input(events), profiles)
    ordered = rows.repartition(*by).sortWithinPartitions(*by, "seq")

    def step_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, last_seq, goes_on = None, None, 0, False

        def finish() -> list[tuple]:
            if current is None or until is None or goes_on:
                return []
            g = geometry[current[0]]
            return as_rows(g, *current[:2], [(f, last_seq, None) for f in state.sweep_until(g, until)])

        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                unit = (r.stream, r.key, r.unit_seq)
                if unit != current:
                    out += finish()
                    current, state = unit, KeyedWindow()
                g = geometry[r.stream]
                steps = state.step(g, point_of(r), r.terminal, None)
                if not r.warm:
                    out += as_rows(g, r.stream, r.key, [(f, r.seq, r.unit) for f in steps])
                last_seq, goes_on = r.seq, r.continues and not r.warm
            if out:
                yield to_pandas(out)
        rest = finish()
        if rest:
            yield to_pandas(rest)

    return ordered.mapInPandas(step_all, FRAME)


@dataclass(frozen=True)
class Replay:
    events: DataFrame
    profiles: Mapping[str, Profile]
    as_of: datetime | int | None = None

    @cached_property
    def _split(self) -> tuple[DataFrame, DataFrame]:
        return split_valid(self.events, self.profiles)

    @property
    def invalid(self) -> DataFrame:
        return self._split[1]

    @cached_property
    def frames(self) -> DataFrame:
        as_of = self.as_of
        if as_of is None and any(p.stall for p in self.profiles.values()):
            as_of = self._split[0].agg(F.max(F.unix_micros("at"))).first()[0]
        return replay_frames(self._split[0], self.profiles, as_of)

    @property
    def late(self) -> DataFrame:
        """Events that came after their key's window and grace had passed them."""
        return self.frames.filter("kind = 'late'").select("stream", "key", "id", "at_us", "seq")

    @cached_property
    def hits(self) -> DataFrame:
        return hits(judged(self.frames), self.profiles)

    @property
    def candidates(self) -> DataFrame:
        return write_up(self.hits, self.profiles)

    @cached_property
    def _run(self) -> tuple[DataFrame, Observation]:
        """The hits written once, and what the run that wrote them counted on its way."""
        flow = Observation("replay")
        kind = lambda name: F.count_if(F.col("kind") == name)
        frames = self.frames.observe(flow, kind("event").alias("judged"), kind("late").alias("late"), kind("stall").alias("swept"))
        return numbered(hits(judged(frames), self.profiles)), flow

    @cached_property
    def staged(self) -> DataFrame:
        return self._run[0]

    @cached_property
    def admitted(self) -> DataFrame:
        return admit(self.staged, self.profiles)

    @cached_property
    def alerts(self) -> DataFrame:
        from tidemark.plans.detect import as_alerts

        return as_alerts(write_up(self.admitted, self.profiles))

    @property
    def counters(self) -> DataFrame:
        """One row: processed (judged or late), alerted, suppressed, late, swept, invalid; the events are stepped through once."""
        from tidemark.plans.detect import counted, seen

        staged, flow = self._run
        got = seen(flow, "judged", "late", "swept")
        return counted({"processed": got["judged"] + got["late"], "late": got["late"], "swept": got["swept"]}, staged, self.admitted, self.invalid)


def replay(
    events: DataFrame, profiles: Iterable[Profile], as_of: datetime | int | None = None
) -> Replay:
    """Run detection over ``events`` in arrival order (column ``seq``, a long)."""
    return Replay(events, by_stream(profiles), as_of)
