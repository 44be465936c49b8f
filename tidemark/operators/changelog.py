"""Window snapshots as a keyed change log, its compaction, and warm starts from it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cases import per_stream
from tidemark.functions.once import once
from tidemark.functions.scalars import is_terminal, parse_state_key, state_key
from tidemark.operators.frames import _us, blocked, check_in_order, prepare, stall_deadline, with_resets
from tidemark.operators.staging import stage
from tidemark.operators.validate import split_valid
from tidemark.profiles import Profile, by_stream, micros

# JSON times keep their microseconds; the default format cuts them to milliseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

_GEO = "struct<lat:double,lon:double,place:string>"
SNAPSHOT = (
    "key struct<stream:string,id:string>, "
    f"points array<struct<id:string,at:timestamp,value:double,geo:{_GEO}>>, written timestamp"
)


def _keys(rows: DataFrame, chosen: Mapping[str, Profile], as_of: datetime | int) -> DataFrame:
    """Newest time, last fresh start, and whether it is ``gone``, of every key."""
    position = F.struct("at_us", "seq")
    keys = rows.groupBy("stream", "key").agg(
        F.max("at_us").alias("mark_us"),
        F.max(F.when(F.col("reset"), position)).alias("since"),
        F.max_by("terminal", position).alias("finished"),
    )
    silent = F.coalesce(stall_deadline(chosen, F.col("mark_us")) <= _us(as_of), F.lit(False))
    return keys.select("stream", "key", "mark_us", "since", (F.col("finished") | silent).alias("gone"))


def live_keys(events: DataFrame, profiles: Mapping[str, Profile], as_of: datetime | int) -> DataFrame:
    """Keys that have neither finished nor been reported silent."""
    rows = prepare(events).select(
        "stream", "key", "at_us", "seq", is_terminal(F.col("labels")).alias("terminal"), F.lit(False).alias("reset")
    )
    return _keys(rows, profiles, as_of).filter("NOT gone").select("stream", "key")


def snapshots(events: DataFrame, profiles: Iterable[Profile], as_of: datetime | int) -> DataFrame:
    """Every key seen, with its points in the window at ``as_of``; ``points`` is null for
    keys that have finished or were reported silent.

    The newest time and the last fresh start of a key are plain aggregates. Only points
    still in the window go further, first cut to ``cap`` per block, then per key.
    """
    chosen = by_stream(profiles)
    check_in_order(chosen)
    valid, _ = split_valid(events, chosen)
    rows = with_resets(blocked(valid, chosen), chosen).filter("own")
    position = F.struct("at_us", "seq")
    keys = _keys(rows, chosen, as_of)
    visible = F.col("mark_us") - per_stream(chosen, lambda p: micros(p.window))
    inside = rows.join(keys.filter("NOT gone"), ["stream", "key"]).filter(
        (F.col("at_us") >= visible) & (F.col("since").isNull() | (position >= F.col("since")))
    )
    cap = per_stream(chosen, lambda p: p.cap)
    for by in (["stream", "key", "block"], ["stream", "key"]):
        newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("at_us"), F.desc("seq")))
        inside = inside.withColumn("newest", newest).filter(F.col("newest") <= cap)
    # At most ``cap`` rows per key are left to collect.
    point = F.struct("id", "at", "value", "geo")
    points = inside.groupBy("stream", "key").agg(
        F.sort_array(F.collect_list(F.struct("at_us", "seq", point.alias("p")))).alias("pts")
    )
    return keys.select("stream", "key").join(points, ["stream", "key"], "left").select(
        "stream", "key", F.transform("pts", lambda x: x["p"]).alias("points"),
        F.timestamp_micros(F.lit(_us(as_of))).alias("written"),
    )


def as_log(snaps: DataFrame) -> DataFrame:
    """Change-log records: a snapshot per live key, a tombstone (null) per dropped one."""
    body = F.to_json(F.struct(
        F.struct("stream", F.col("key").alias("id")).alias("key"), "points", "written"
    ), TIMES)
    return snaps.select(
        state_key(F.col("stream"), F.col("key")).alias("key"),
        F.when(F.size(F.coalesce("points", F.array())) > 0, body).alias("value"),
        F.col("written").alias("timestamp"),
    )


def decode(log: DataFrame) -> DataFrame:
    """(stream, id, points, written, offset) of readable records. Unreadable ones, and
    tombstones whose key has no stream part, are skipped."""
    taken = once(
        log.select("key", "offset", "value"),
        (F.coalesce(F.length("value"), F.lit(0)) == 0).alias("empty"),
        F.from_json("value", SNAPSHOT, TIMES).alias("snap"),
        F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT").alias("is_object"),
        parse_state_key(F.col("key")).alias("from_key"),
        keep=["offset"],
    )
    readable = "if(empty, from_key IS NOT NULL, coalesce(is_object, false) AND snap.key.stream IS NOT NULL)"
    return taken.filter(readable).selectExpr(
        "if(empty, from_key.stream, snap.key.stream) AS stream",
        "if(empty, from_key.id, coalesce(snap.key.id, '')) AS id",
        "if(empty, NULL, snap.points) AS points",
        "if(empty, NULL, snap.written) AS written",
        "offset",
    )


def latest(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The newest row per key by an aggregate: Spark reduces inside every task first, so
    a key with very many versions costs no more than one with few."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*keys, "r.*")


def compact(log: DataFrame, streams: Iterable[str]) -> DataFrame:
    """The current snapshot of every key: the latest record, unless it deletes the key,
    and only of streams somebody configured."""
    known = decode(log).filter(F.col("stream").isin(*streams))
    newest = latest(known, ["stream", "id"], F.col("offset"), ["points", "written", "offset"])
    return newest.filter(F.size(F.coalesce("points", F.array())) > 0)


@dataclass(frozen=True)
class Compacted:
    """The current snapshots by the records up to and including offset ``upto``."""

    rows: DataFrame
    upto: int


def advance(done: Compacted | None, log: DataFrame, streams: Iterable[str]) -> Compacted:
    """``done`` brought up to the end of ``log``, of which only what came after ``done.upto`` is read; repeating it changes nothing.

    Offsets grow along the log. A record that deletes a key removes it from the result and is then no longer needed: what is read later is newer.
    The result is written to the shared folder.
    """
    tail = log if done is None else log.filter(F.col("offset") > done.upto)
    newest = tail.agg(F.max("offset")).first()[0]
    if newest is None and done is not None:
        return done
    changes = decode(tail).filter(F.col("stream").isin(*streams)).select("stream", "id", "points", "written", "offset")
    rows = changes if done is None else done.rows.unionByName(changes)
    current = latest(rows, ["stream", "id"], F.col("offset"), ["points", "written", "offset"])
    return Compacted(stage(current.filter(F.size(F.coalesce("points", F.array())) > 0), "compacted"), -1 if newest is None else newest)


def seeds(compacted: DataFrame) -> DataFrame:
    """Warm-start rows for ``streaming.detector.detect_stream``."""
    point = lambda p: F.struct(
        F.unix_micros(p["at"]).alias("at"), p["id"].alias("id"), p["value"].alias("value"),
        p["geo"].isNotNull().alias("has_geo"), p["geo"]["lat"].alias("lat"),
        p["geo"]["lon"].alias("lon"), p["geo"]["place"].alias("place"),
    )
    return compacted.select("stream", F.col("id").alias("key"), F.transform("points", point).alias("points"))
