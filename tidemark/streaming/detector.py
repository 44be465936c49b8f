"""Detection on a stream, with the rules of the batch plans.

Two stateful steps with plain expressions between them: ``_Windows`` keeps each key's
window and emits frames, the native rules turn frames into candidates, ``_Cooldowns``
thins them. State lives in Spark's state store (RocksDB) and is recovered from the
checkpoint.

Time. A key's own mark decides lateness, as in the batch replay: each valid record is
judged or counted as late, however far its key lags behind others. Silence needs a timer:
with ``timers="event"`` it follows the query's watermark, which is deterministic but
stands still when the whole source does; with ``timers="processing"`` it follows the wall
clock. The watermark moves timers alone. Its column is dropped before the stateful step,
so Spark filters nothing by it; a key that lags is silent when the watermark has gone on by
the rule's limit since the key was last heard.

Rows pass as plain ``Row`` objects: a frame of pandas for each key, in and out, costs many
times the steps themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from datetime import datetime, timedelta, timezone
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.keyed_window import Geometry, KeyedWindow, Point
from tidemark.operators.replay import FRAME, FRAME_COLUMNS, STEP_INPUT, as_rows, judged, step_input
from tidemark.operators.rules import hits, write_up
from tidemark.operators.validate import split_valid
from tidemark.plans.detect import as_alerts
from tidemark.profiles import Profile, by_stream, micros

IDLE = timedelta(hours=1)  # fixed value: keys unseen for so long are forgotten

_POINT = "struct<at:long,id:string,value:double,has_geo:boolean,lat:double,lon:double,place:string>"
_STATE = (
    f"points array<{_POINT}>, mark long, clock long, late long, "
    "stall_until long, stall_rank int, seen_us long, timer_ms long"
)
_HELD = "rules array<struct<rule:string,until:long,rank:int>>, timer_ms long"
_SEED = f"stream string, key string, points array<{_POINT}>"
_EMITTED = FRAME + ", emitted_at timestamp"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_Emitted = Row(*FRAME_COLUMNS, "emitted_at")
_CLOCK = FRAME_COLUMNS.index("clock_us")
_NUMBERS = {FRAME_COLUMNS.index(c) for c in ("value", "base_mean", "base_sd")}


def _pack(p: Point) -> tuple:
    lat, lon, place = p.geo if p.geo else (None, None, None)
    return (p.at, p.id, p.value, p.geo is not None, lat, lon, place)


def _unpack(p) -> Point:
    at, id, value, has_geo, lat, lon, place = p
    return Point(at, id, value, (lat, lon, place) if has_geo else None)


def _number(v: float | None) -> float | None:
    """What is not a number is null to the rules."""
    return None if v is None or v != v else v


class _Windows(StatefulProcessor):
    """One key's window: files events, reports silence, forgets idle keys."""

    def __init__(self, geometry: Mapping[str, Geometry], event_timers: bool, idle_us: int):
        self.geometry, self.event_timers, self.idle_us = dict(geometry), event_timers, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", _STATE)
        self.columns, self.seeded = None, None

    def _load(self) -> tuple[KeyedWindow, int, int]:
        stored = self.state.get()
        if stored is None:
            return KeyedWindow(), 0, -1
        pts, mark, clock, late, until, rank, seen, timer = stored
        points = [_unpack(p) for p in pts or []]
        return KeyedWindow(points, mark, clock, late, until, rank), seen, timer

    def _lag(self, w: KeyedWindow, seen: int) -> int:
        """How far the query's clock was ahead of the key's when the key was last heard."""
        return max(0, seen - w.clock) if self.event_timers and w.clock is not None else 0

    def _save(self, g: Geometry, w: KeyedWindow, seen: int, timer: int, now_us: int) -> None:
        sweep = w.next_sweep(g)
        due = [seen + self.idle_us] + ([] if sweep is None else [sweep + self._lag(w, seen)])
        wanted = max(-(-min(due) // 1000), now_us // 1000 + 1)
        if wanted != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
        self.state.update((
            [_pack(p) for p in w.points], w.mark, w.clock, w.late,
            w.stall_until, w.stall_rank, seen, wanted,
        ))

    def _now(self, timers) -> int:
        ms = timers.getCurrentWatermarkInMs() if self.event_timers else timers.getCurrentProcessingTimeInMs()
        return int(ms) * 1000

    def _emit(self, rows: list[tuple], now_us: int) -> Iterator[Row]:
        for r in rows:
            # Spark refuses rows at or behind the watermark, which has milliseconds.
            facts = (_number(v) if i in _NUMBERS else v for i, v in enumerate(r))
            yield _Emitted(*facts, _EPOCH + timedelta(microseconds=max(r[_CLOCK], now_us + 1000)))

    def _point(self, at: int, id: str, value: float, lat: float | None, lon: float | None, place: str | None, has_geo: bool) -> Point:
        return Point(at, id, value, (_number(lat), _number(lon), place) if has_geo else None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stream, entity = key
        g = self.geometry[stream]
        w, seen, timer = self._load()
        now = self._now(timerValues)
        # A micro-batch of one key, in arrival order; the trigger bounds its size.
        batch = list(rows)
        if self.columns is None:
            self.columns = itemgetter(*(batch[0].__fields__.index(c) for c in STEP_INPUT[2:]))
        batch = sorted(map(self.columns, batch), key=_arrival)
        out: list[tuple] = []
        for id, at, value, unit, lat, lon, place, has_geo, terminal, seq, clock in batch:
            steps = w.step(g, self._point(at, id, value, lat, lon, place, has_geo), terminal, clock)
            out += as_rows(g, stream, entity, [(f, seq, unit) for f in steps])
        seen = max(seen, now, w.clock) if self.event_timers else max(seen, now)
        self._save(g, w, seen, timer, now)
        yield from self._emit(out, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stream, entity = key
        g = self.geometry[stream]
        w, seen, _ = self._load()
        now = self._now(timerValues)
        if self.event_timers:
            found = w.sweep_until(g, now - self._lag(w, seen))
        else:
            hit = w.sweep(g, now)
            found = [hit] if hit else []
        yield from self._emit(as_rows(g, stream, entity, [(f, -1, None) for f in found]), now)
        if now >= seen + self.idle_us:
            self.state.clear()
        else:
            self._save(g, w, seen, -1, now)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if key == self.seeded:
            return  # the first row counts
        self.seeded = key
        stream, _ = key
        now = self._now(timerValues)
        w = KeyedWindow()
        for p in initialState.points:
            w.points.append(_unpack(tuple(p[c] for c in ("at", "id", "value", "has_geo", "lat", "lon", "place"))))
        w.points.sort(key=lambda p: p.at)
        w.mark = w.clock = w.points[-1].at
        seen = max(w.clock, now) if self.event_timers else now
        self._save(self.geometry[stream], w, seen, -1, now)

    def close(self) -> None:
        pass


def _arrival(r: tuple) -> int:
    return r[-2]


def _ending_last(r: Row) -> tuple:
    return r.clock_us, r.seq, r.rule == "", r.place is None, r.place


class _Cooldowns(StatefulProcessor):
    """Per rule of a key: until when it cools down, and how severe the alert was.

    A key's state is read and written once a micro-batch, and has one timer. It outlives the
    longest cooldown by ``idle_us`` on the query's clock, so that a lagging key keeps it too.
    """

    def __init__(self, cooldown_us: Mapping[str, int], event_timers: bool, idle_us: int, columns: list[str]):
        self.cooldown_us, self.event_timers, self.idle_us, self.columns = dict(cooldown_us), event_timers, idle_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", _HELD)
        self.admitted, self.picked = Row(*self.columns), None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # A terminal event's own alerts come before the end of its key.
        batch = sorted(rows, key=_ending_last)
        stored, timer = self.state.get() or ([], -1)
        before = {rule: (until, rank) for rule, until, rank in stored or []}
        held, cool, keep = dict(before), self.cooldown_us[key[0]], []
        for r in batch:
            rule = r.rule
            ok = bool(r.absence)  # silence has been through its cooldown
            if rule == "":
                held.clear()
            elif not ok:
                last = held.get(rule)
                ok = last is None or r.clock_us >= last[0] or (r.rank is not None and r.rank > last[1])
                if ok:
                    held[rule] = (int(r.clock_us) + cool, int(r.rank))
            if ok:
                keep.append(r)
        if held != before:
            self._save(held, timer, cool, timerValues)
        if keep and self.picked is None:
            self.picked = itemgetter(*(keep[0].__fields__.index(c) for c in self.columns))
        for r in keep:
            yield self.admitted(*self.picked(r))

    def _save(self, held: dict[str, tuple[int, int]], timer: int, cool: int, timers) -> None:
        if timer >= 0:
            self.handle.deleteTimer(timer)
        if not held:
            self.state.clear()
            return
        now = timers.getCurrentWatermarkInMs() if self.event_timers else timers.getCurrentProcessingTimeInMs()
        last = max(until for until, _ in held.values())
        due = (max(last, int(now) * 1000 + cool) + self.idle_us) // 1000 + 1
        self.handle.registerTimer(due)
        self.state.update(([(rule, *h) for rule, h in held.items()], due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _windows(valid: DataFrame, profiles: Mapping[str, Profile], event_timers: bool, wall_clock: bool,
             watermark_delay: timedelta | None, idle: timedelta, seed: DataFrame | None) -> DataFrame:
    delay = watermark_delay or max(p.retention for p in profiles.values())
    steps = step_input(valid, F.current_timestamp() if wall_clock else None)
    if event_timers:
        steps = steps.withColumn("event_at", F.timestamp_micros("at_us"))
        steps = steps.withWatermark("event_at", f"{micros(delay)} microseconds").drop("event_at")
    geometry = {name: Geometry.of(p) for name, p in profiles.items()}
    return steps.groupBy("stream", "key").transformWithState(
        statefulProcessor=_Windows(geometry, event_timers, micros(idle)),
        outputStructType=_EMITTED,
        outputMode="Append",
        timeMode="EventTime" if event_timers else "ProcessingTime",
        initialState=None if seed is None else seed.groupBy("stream", "key"),
        **({"eventTimeColumnName": "emitted_at"} if event_timers else {}),
    )


#: What the cooldown looks at; the other facts of a hit pass it as one text, as Python takes rows apart value by value.
_COOLED = ["stream", "key", "rule", "absence", "clock_us", "rank", "seq", "place", "at_us"]


def _facts(found: DataFrame) -> list[str]:
    return [c for c in found.columns if c not in (*_COOLED, "at", "emitted_at")]


def _bundled(found: DataFrame) -> DataFrame:
    kinds = dict(found.dtypes)
    facts = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in _facts(found)]
    return found.select(*_COOLED, "emitted_at", F.to_json(F.struct(*facts)).alias("facts"))


def _unbundled(cooled: DataFrame, found: DataFrame) -> DataFrame:
    facts = F.from_json("facts", found.select(_facts(found)).schema).alias("facts")
    rows = cooled.select(*_COOLED, facts).select(*_COOLED, F.timestamp_micros("at_us").alias("at"), "facts.*")
    return rows.select(found.drop("emitted_at").columns)


def detect_stream(
    events: DataFrame,
    profiles: Iterable[Profile],
    timers: str = "event",
    wall_clock: bool = False,
    watermark_delay: timedelta | None = None,
    idle: timedelta = IDLE,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Alerts of a streaming frame of events with an arrival number ``seq``.

    Rejected events are filtered out; take them from ``validate.split_valid`` (see
    ``sinks.start_detection``). Detection time is the key's newest event time, or with
    ``wall_clock`` the time of the micro-batch. ``seed`` is a warm start, as
    ``changelog.seeds`` makes it.

    The query reports ``flow`` metrics: events judged, late, and silences.
    """
    if timers not in ("event", "processing"):
        raise ValueError("timers must be 'event' or 'processing'")
    chosen = by_stream(profiles)
    event_timers = timers == "event"
    valid, _ = split_valid(events, chosen)
    frames = _windows(valid, chosen, event_timers, wall_clock, watermark_delay, idle, seed).observe(
        "flow",
        F.count_if(F.col("kind") == "event").alias("judged"),
        F.count_if(F.col("kind") == "late").alias("late"),
        F.count_if(F.col("kind") == "stall").alias("silent"),
    )
    found = hits(judged(frames), chosen, carry=("emitted_at",))
    held = _bundled(found)
    out = held.drop("emitted_at")
    cooled = held.groupBy("stream", "key").transformWithState(
        statefulProcessor=_Cooldowns({n: micros(p.cooldown) for n, p in chosen.items()}, event_timers, micros(idle), out.columns),
        outputStructType=out.schema,
        outputMode="Append",
        timeMode="EventTime" if event_timers else "ProcessingTime",
    )
    return as_alerts(write_up(_unbundled(cooled, found), chosen))
