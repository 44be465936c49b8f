"""One query per operator over the events table, always over the whole of it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import alert_table, changelog, stats, window_stats as ws
from tidemark.operators.frames import event_frames
from tidemark.operators.metrics import closed, latest_windows, tumbling
from tidemark.operators.replay import late_arrivals, replay
from tidemark.operators.segments import numbered_segments
from tidemark.operators.staging import shared_folder
from tidemark.operators.validate import dead_letters, split_valid, with_reason
from tidemark.plans.detect import detect
from tidemark.plans.events_table import (
    AS_OF, BOUNDS, PROFILES, alert_history, events, in_arrival_order, raw_records, streamed_events, with_faults,
)
from tidemark.profiles import by_stream
from tidemark.sources.envelopes import open_envelopes
from tidemark.sources.records import closed_windows, decode_events, encode_alerts, encode_metrics
from tidemark.streaming.detector import detect_stream
from tidemark.streaming.metrics import metrics_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BY_STREAM = by_stream(PROFILES)
DAY = timedelta(days=1)


def query(run):
    QUERIES[run.__name__] = run
    return run


def ntz(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


def found(spark, sf_dir, rule: str) -> DataFrame:
    d = detect(events(spark, sf_dir), PROFILES, AS_OF)
    return d.candidates.filter(F.col("rule") == rule)


def evidence(field: str, kind: str) -> Column:
    return F.get_json_object("evidence", f"$.{field}").cast(kind)


def ids() -> Column:
    return F.array_join("event_ids", ",").alias("event_ids")


# Validation and dead letters.


@query
def validate_split(spark, sf_dir):
    judged = with_reason(with_faults(events(spark, sf_dir)), BY_STREAM)
    return judged.select("event_id", F.coalesce("reason", F.lit("valid")).alias("reason"))


@query
def no_profile(spark, sf_dir):
    """With a profile for one stream alone."""
    judged = with_reason(with_faults(events(spark, sf_dir)), by_stream(PROFILES[:1]))
    return judged.select("event_id", F.coalesce("reason", F.lit("valid")).alias("reason"))


@query
def decoded_events(spark, sf_dir):
    """Every field of the records that can be read."""
    valid, _ = split_valid(decode_events(raw_records(events(spark, sf_dir))), BY_STREAM)
    return valid.select(
        "offset", "id", "stream", "key", ntz("at"), "value", "unit", F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"),
        F.col("geo.place").alias("place"), S.label(F.col("labels"), "status").alias("status"),
    )


@query
def dead_letter_records(spark, sf_dir):
    decoded = decode_events(raw_records(events(spark, sf_dir)))
    _, rejected = split_valid(decoded, BY_STREAM)
    return dead_letters(rejected).select("topic", "partition", "offset", "key", "reason", "payload")


@query
def first_dead_letters(spark, sf_dir):
    decoded = decode_events(raw_records(events(spark, sf_dir)))
    _, rejected = split_valid(decoded, BY_STREAM)
    return alert_table.first_dead_letters(dead_letters(rejected)).select("partition", "offset", "reason")


@query
def dead_letter_retention(spark, sf_dir):
    decoded = decode_events(raw_records(events(spark, sf_dir)))
    _, rejected = split_valid(decoded, BY_STREAM)
    letters = dead_letters(rejected, F.col("record_time"))
    return alert_table.live_dead_letters(letters, AS_OF).select("partition", "offset", ntz("at"))


@query
def terminal_events(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select(
        "id", S.label(F.col("labels"), "status").alias("status"), S.is_terminal(F.col("labels")).alias("terminal"),
        S.label(F.col("labels"), "codec").alias("codec"),
    )


# Rules, before the cooldown.


@query
def velocity(spark, sf_dir):
    return found(spark, sf_dir, "velocity").select(
        "stream", "key", F.col("event_id").alias("id"), ntz("at"), "severity", "title", "detail",
        evidence("count", "long").alias("count"), evidence("spanMs", "long").alias("span_ms"),
        evidence("perSecond", "double").alias("per_second"), ids(),
    )


@query
def geovelocity(spark, sf_dir):
    return found(spark, sf_dir, "geovelocity").select(
        "stream", "key", F.col("event_id").alias("id"), "severity", "title", "detail",
        evidence("fromPlace", "string").alias("from_place"), evidence("toPlace", "string").alias("to_place"),
        evidence("distanceKm", "double").alias("distance_km"),
        F.round(evidence("seconds", "double"), 3).alias("seconds"), ids(),
    )


@query
def zscore(spark, sf_dir):
    return found(spark, sf_dir, "zscore").select(
        "stream", "key", F.col("event_id").alias("id"), "severity", "title", "detail",
        evidence("value", "double").alias("value"), evidence("samples", "long").alias("samples"),
        evidence("stddev", "double").alias("stddev"), evidence("z", "double").alias("z"), ids(),
    )


@query
def threshold(spark, sf_dir):
    return found(spark, sf_dir, "threshold").select(
        "stream", "key", F.col("event_id").alias("id"), "severity", "title", "detail",
        evidence("value", "double").alias("value"), evidence("heldMs", "long").alias("held_ms"),
        evidence("samples", "long").alias("samples"), ids(),
    )


@query
def stall(spark, sf_dir):
    return found(spark, sf_dir, "stall").select(
        "stream", "key", F.col("event_id").alias("id"), ntz("at"), ntz("detected_at"), "severity", "title", "detail",
        evidence("idleMs", "long").alias("idle_ms"), evidence("lastValue", "double").alias("last_value"), "absence",
    )


# Windows.


@query
def window_statistics(spark, sf_dir):
    frames = event_frames(events(spark, sf_dir), BY_STREAM, AS_OF, with_statistics=True).filter("own")
    return ws.window_stats(frames).select(
        "stream", "key", "id", "count", F.round("mean", 6).alias("mean"), F.round("stddev", 4).alias("stddev"),
        "span_ms", F.round("per_second", 2).alias("per_second"), "previous_id", "last_id", "retained",
    )


@query
def segments(spark, sf_dir):
    rows = numbered_segments(events(spark, sf_dir), BY_STREAM)
    return rows.select("stream", "key", "id", F.col("segment").cast("long").alias("segment"))


@query
def late_filter(spark, sf_dir):
    rows = in_arrival_order(events(spark, sf_dir))
    out = late_arrivals(rows, timedelta(hours=2), timedelta(hours=1))
    return out.select("stream", "key", "id", ntz("mark"), "late")


@query
def late_by_key(spark, sf_dir):
    rows = in_arrival_order(events(spark, sf_dir))
    out = late_arrivals(rows, timedelta(hours=2), timedelta(hours=1))
    return out.groupBy("stream", "key").agg(F.count_if("late").alias("late"), F.max("mark").alias("mark")).select(
        "stream", "key", "late", ntz("mark"))


# Detection as a whole.


@query
def alerts(spark, sf_dir):
    return detect(events(spark, sf_dir), PROFILES, AS_OF).alerts.select(
        "rule", "stream", "key", ntz("at"), ntz("detected_at"), "severity", "title", "detail", ids(), "absence",
    )


@query
def several_bounds(spark, sf_dir):
    """A stream with two rules of one kind, which share a cooldown, and a sweeper that is not the library's."""
    rows = events(spark, sf_dir).filter(F.col("stream") == "sensors")
    return detect(rows, BOUNDS, AS_OF).alerts.select(
        "rule", "stream", "key", ntz("at"), ntz("detected_at"), "severity", "title", "detail", ids(), "absence",
    )


@query
def engine_counters(spark, sf_dir):
    return detect(with_faults(events(spark, sf_dir)).drop("event_id"), PROFILES, AS_OF).counters


@query
def alerts_by_rule(spark, sf_dir):
    return stats.by_rule(detect(events(spark, sf_dir), PROFILES, AS_OF).alerts)


@query
def replayed_alerts(spark, sf_dir):
    """Detection in arrival order, with late and out-of-order records."""
    return replay(in_arrival_order(events(spark, sf_dir)), PROFILES, AS_OF).alerts.select(
        "rule", "stream", "key", ntz("at"), ntz("detected_at"), "severity", "title", "detail", ids(), "absence",
    )


@query
def replay_counters(spark, sf_dir):
    return replay(in_arrival_order(events(spark, sf_dir)), PROFILES, AS_OF).counters


def run_to_table(df: DataFrame, name: str) -> DataFrame:
    """Run a streaming frame over what is there and return what it wrote."""
    spark = df.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    base = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    done = (
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True).start(f"{base}/rows")
    )
    done.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")


@query
def streamed_alerts(spark, sf_dir):
    """The streaming detector over the same events."""
    source = streamed_events(spark, sf_dir)
    out = run_to_table(detect_stream(source, PROFILES, watermark_delay=timedelta(hours=1), idle=30 * DAY), "streamed")
    return out.select(
        "rule", "stream", "key", ntz("at"), ntz("detected_at"), "severity", "title", "detail", ids(), "absence",
    )


@query
def streamed_metrics(spark, sf_dir):
    source = raw_records(streamed_events(spark, sf_dir))
    return windows(run_to_table(metrics_stream(source, DAY, timedelta(hours=1)), "metrics"))


# Aggregates and statistics.


def windows(df: DataFrame) -> DataFrame:
    return df.select(
        "stream", ntz("window_start"), ntz("window_end"), "count", "sum", "mean", "min", "max", "per_second"
    )


@query
def tumbling_metrics(spark, sf_dir):
    return windows(tumbling(events(spark, sf_dir), timedelta(hours=6)))


@query
def metrics_log(spark, sf_dir):
    """Closed windows as records keyed by stream, empty records among them, and read back."""
    written = encode_metrics(tumbling(events(spark, sf_dir), timedelta(hours=6)))
    log = written.unionByName(written.select("key", F.lit("").alias("value")))
    fields = "windowStart timestamp, windowEnd timestamp, count long, sum double, mean double, min double, max double, perSecond double"
    read = closed_windows(log).select(F.col("key").alias("stream"), F.from_json("value", fields).alias("w")).select("stream", "w.*")
    return windows(read.withColumnsRenamed({"windowStart": "window_start", "windowEnd": "window_end", "perSecond": "per_second"}))


@query
def latest_window(spark, sf_dir):
    rows = events(spark, sf_dir)
    return windows(latest_windows(closed(tumbling(rows, timedelta(hours=6)), rows, timedelta(hours=1))))


@query
def latency_percentiles(spark, sf_dir):
    return stats.latency_stats(alert_history(events(spark, sf_dir)))


@query
def latency_classes(spark, sf_dir):
    history = stats.classify_latency(alert_history(events(spark, sf_dir)))
    return history.groupBy("latency_class").agg(F.count(F.lit(1)).alias("alerts"))


@query
def rates(spark, sf_dir):
    out = stats.rates(events(spark, sf_dir), "at", timedelta(hours=1))
    return out.select(ntz("interval_start"), "count", F.round("per_second", 9).alias("per_second"), "total")


@query
def sample_every(spark, sf_dir):
    out = stats.sample_every(events(spark, sf_dir), "at", "seq", timedelta(hours=6), 0.001)
    return out.select("id", "number", "every")


@query
def summary(spark, sf_dir):
    rows = events(spark, sf_dir)
    return stats.summary(
        rows, alert_history(rows), tumbling(rows, timedelta(hours=6)), datetime(2024, 1, 30), timedelta(hours=1), 0.001
    )


@query
def flow_counters(spark, sf_dir):
    raw = raw_records(events(spark, sf_dir))
    valid, rejected = split_valid(decode_events(raw), BY_STREAM)
    live = changelog.live_keys(valid.withColumn("seq", F.col("offset")), BY_STREAM, AS_OF)
    return stats.flow(raw, rejected, alert_history(events(spark, sf_dir)), live)


# Alert storage.


@query
def alert_rows(spark, sf_dir):
    rows = alert_table.alert_rows(alert_history(events(spark, sf_dir)))
    return rows.withColumn("event_ids", F.array_join("event_ids", ","))


@query
def idempotent_insert(spark, sf_dir):
    """A first batch, then everything including that batch and copies: each row once."""
    history = alert_history(events(spark, sf_dir))
    path = os.path.join(shared_folder(spark), f"alerts-{uuid.uuid4().hex}")
    first = history.filter(F.substring("id", 3, 20).cast("long") % 3 == 0)
    a = alert_table.insert(first, path)
    b = alert_table.insert(history.unionByName(first), path)
    stored = spark.read.schema(alert_table.alert_rows(history).schema).parquet(path)
    return stored.groupBy("stream", "pk").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("sk").alias("distinct_rows")
    ).select("*", *[F.lit(n).cast("long").alias(c) for c, n in (
        ("written_first", a.written), ("written_then", b.written), ("skipped_then", b.skipped), ("errors", a.errors + b.errors))])


@query
def retention(spark, sf_dir):
    rows = alert_table.alert_rows(alert_history(events(spark, sf_dir)))
    return alert_table.live(rows, datetime(2024, 2, 15)).select("pk", "sk", "expires_at")


@query
def recent_alerts(spark, sf_dir):
    return alert_table.recent(alert_history(events(spark, sf_dir))).select("id", ntz("detected_at"), "severity")


@query
def recent_alerts_of_stream(spark, sf_dir):
    history = alert_history(events(spark, sf_dir))
    return alert_table.recent(history, alert_table.ON_LOAD, "payments").select("id", "stream", ntz("detected_at"))


@query
def entity_alerts(spark, sf_dir):
    rows = alert_table.alert_rows(alert_history(events(spark, sf_dir)))
    return alert_table.of_entity(rows, "video", "user-7").select("pk", "sk", "rule", "severity")


@query
def severity_ranked(spark, sf_dir):
    rows = alert_table.alert_rows(alert_history(events(spark, sf_dir)))
    return alert_table.by_severity(rows).select("alert_id", "severity", "severity_rank", "detected_at")


@query
def parse_envelope(spark, sf_dir):
    """Alert records packed into base64 envelopes per day, some broken, and read back."""
    rows, _ = open_envelopes(packed(spark, sf_dir))
    return rows.select("id", "rule", "stream", "key", "severity", ntz("at"), ntz("detected_at"), "detail", ids(), "absence")


@query
def envelope_problems(spark, sf_dir):
    _, problems = open_envelopes(packed(spark, sf_dir))
    return problems


def packed(spark, sf_dir) -> DataFrame:
    history = alert_history(events(spark, sf_dir))
    encoded = encode_alerts(history).withColumn("n", F.get_json_object("value", "$.id").substr(3, 20).cast("long"))
    n = F.col("n")
    value = (
        F.when(n % 29 == 1, "%%%").when(n % 29 == 2, F.base64(F.lit("{oops").cast("binary")))
        .otherwise(F.base64(F.col("value").cast("binary")))
    )
    record = F.struct(
        F.lit("alerts").alias("topic"), F.lit(0).alias("partition"), n.alias("offset"), "key", value.alias("value")
    )
    # Envelopes of at most fifty records each; every hundredth alert goes directly.
    direct = encoded.filter(n % 100 == 0).select(
        F.concat(F.lit('{"alert":'), F.col("value"), F.lit("}")).alias("body"))
    batches = encoded.filter(n % 100 != 0).groupBy(F.floor(n / 50)).agg(
        F.to_json(F.struct(F.create_map(F.lit("alerts-0"), F.collect_list(record)).alias("records"))).alias("body"))
    return batches.select("body").unionByName(direct)


# Change log.


@query
def window_snapshot(spark, sf_dir):
    snaps = changelog.snapshots(events(spark, sf_dir), PROFILES, datetime(2024, 1, 31))
    return snaps.select(
        "stream", "key", F.coalesce(F.size("points"), F.lit(0)).cast("long").alias("points"),
        F.array_join(F.transform("points", lambda p: p["id"]), ",").alias("point_ids"),
    )


def state_log(spark, sf_dir) -> DataFrame:
    """A change log with one record per event: snapshots of one point, some tombstones,
    some unreadable, some of a stream nobody configured."""
    n = F.col("seq")
    stream = F.when(n % 31 == 0, "telemetry").otherwise(F.col("stream"))
    rows = events(spark, sf_dir).withColumn("stream", stream)
    point = F.struct("id", "at", "value", "geo")
    body = F.to_json(F.struct(
        F.struct("stream", F.col("key").alias("id")).alias("key"), F.array(point).alias("points"), F.col("at").alias("written")), changelog.TIMES)
    return rows.select(
        F.when(n % 37 == 0, "no-separator").otherwise(S.state_key(F.col("stream"), F.col("key"))).alias("key"),
        F.when(n % 5 == 0, F.lit(None)).when(n % 37 == 0, F.lit(None)).when(n % 23 == 0, "{oops").otherwise(body).alias("value"),
        n.alias("offset"),
    )


@query
def compact_changelog(spark, sf_dir):
    out = changelog.compact(state_log(spark, sf_dir), BY_STREAM)
    return out.select("stream", "id", "offset", F.col("points")[0]["id"].alias("point_id"), ntz("written"))


@query
def compact_in_steps(spark, sf_dir):
    """The same from a first part of the log, and then twice from what was appended since."""
    log, done = state_log(spark, sf_dir), None
    for upto in (1000, 5000, None):
        done = changelog.advance(done, log if upto is None else log.filter(F.col("offset") < upto), BY_STREAM)
    return done.rows.select("stream", "id", "offset", F.col("points")[0]["id"].alias("point_id"), ntz("written"))


@query
def warm_start(spark, sf_dir):
    """The change log of the windows at one time, read back as detector state."""
    snaps = changelog.snapshots(events(spark, sf_dir), PROFILES, datetime(2024, 1, 31))
    log = changelog.as_log(snaps).withColumn("offset", F.lit(0).cast("long"))
    seeds = changelog.seeds(changelog.compact(log, BY_STREAM))
    return seeds.select(
        "stream", "key", F.size("points").cast("long").alias("points"),
        F.timestamp_micros(F.element_at("points", -1)["at"]).cast("timestamp_ntz").alias("newest"),
        F.element_at("points", -1)["value"].alias("last_value"),
    )


# Scalars.


@query
def compact_text(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select(
        "id",
        S.compact_float("value * 250D").alias("large"),
        S.compact_float("value / 100D").alias("small"),
        S.compact_duration("seq * 7919 * 1000 % 20000000000").alias("duration"),
        S.place_of("geo").alias("place"),
    )


@query
def state_keys(spark, sf_dir):
    rows = events(spark, sf_dir)
    made = S.state_key(F.col("stream"), F.concat("key", F.lit("/"), F.col("id")))
    back = S.parse_state_key(made)
    return rows.select(made.alias("state_key"), back["stream"].alias("stream"), back["id"].alias("entity"))


@query
def alert_ids(spark, sf_dir):
    made = S.alert_id(F.col("rule"), F.col("stream"), F.col("key"), F.col("id"))
    return alert_history(events(spark, sf_dir)).select("id", made.alias("made"))


@query
def distances(spark, sf_dir):
    geo = F.col("geo")
    rows = events(spark, sf_dir).filter(geo.isNotNull())
    km = S.haversine_km(geo["lat"], geo["lon"], F.lit(-23.5505), F.lit(-46.6333))
    return rows.select("id", F.round(km, 6).alias("km"))
