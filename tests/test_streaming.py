"""The streaming detector gives what the batch plans give."""

from datetime import timedelta
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests.test_detect_model import PROFILES, random_rows
from tests.test_replay import model_of, shuffled, with_seq
from tests.util import alert_tuples
from tidemark.operators.keyed_window import Geometry
from tidemark.operators.replay import STEP_INPUT
from tidemark.profiles import default_profiles, micros
from tidemark.streaming.detector import _bundled, _unbundled, _Windows, detect_stream


def run(spark, alerts, tmp_path, name):
    q = (
        alerts.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q, spark.table(name)


@pytest.mark.parametrize("spread", [0, 300])
def test_stream_equals_model(spark, tmp_path, spread):
    rows = shuffled(random_rows(11, keys=6, per_key=60), 5, spread)
    df = with_seq(spark, rows)
    n = len(rows)
    # Three files, read one per micro-batch.
    for i in range(3):
        part = df.filter(f"seq >= {i * n // 3} and seq < {(i + 1) * n // 3}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    delay = timedelta(hours=3)
    q, table = run(spark, detect_stream(source, PROFILES, watermark_delay=delay), tmp_path, f"alerts{spread}")
    m = model_of(rows, PROFILES, 0)
    assert alert_tuples(table) == sorted(m.alerts)
    flow = [p.observedMetrics["flow"] for p in q.recentProgress if "flow" in p.observedMetrics]
    assert sum(f.late for f in flow) == len(m.late)


def test_event_timers_report_silence(spark, tmp_path):
    """Silence of one key is reported because others move the watermark on."""
    from tests.util import event

    rows = [event("a", "video", "quiet", 0, 50), event("b", "video", "fin", 1, 50, status="done")]
    rows += [event(f"c{i}", "video", "busy", 2 + 30 * i, 50) for i in range(10)]
    df = with_seq(spark, rows)
    for i in range(len(rows)):
        df.filter(f"seq = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    _, table = run(spark, detect_stream(source, PROFILES, watermark_delay=timedelta(seconds=5)), tmp_path, "silence")
    got = table.select("rule", "key", "absence", F.unix_timestamp("detected_at").alias("d"), "event_ids").collect()
    assert [(r.rule, r.key, r.absence, r.event_ids) for r in got] == [("stall", "quiet", True, ["a"])]


def test_lagging_keys_lose_nothing(spark, tmp_path):
    """Keys 100,000 s apart, the oldest in the last micro-batches: all are judged by their own marks and cooldowns."""
    from tests.util import event

    batches = [[event(f"{k}{i:02d}", "payments", k, t + i, 50) for i in range(25)] for k, t in (("a", 200_000), ("b", 100_000), ("c", 0))]
    batches.append([event(f"d{i}", "payments", "c", 26 + i, 50) for i in range(4)] + [event("old", "payments", "b", 1, 50)])
    batches.append([event("v", "video", "late", 1, 50), event("w", "video", "late", 5, 50)])
    rows = [r for b in batches for r in b]
    df, at = with_seq(spark, rows), 0
    for b in batches:
        df.filter(f"seq >= {at} and seq < {at + len(b)}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        at += len(b)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q, table = run(spark, detect_stream(source, PROFILES, watermark_delay=timedelta(seconds=5)), tmp_path, "lagging")
    m = model_of(rows, PROFILES, 0)
    got = alert_tuples(table)
    assert got == sorted(m.alerts) and {r.key for r in table.collect()} >= {"a", "b", "c"}
    flow = [p.observedMetrics["flow"] for p in q.recentProgress if "flow" in p.observedMetrics]
    assert sum(f.late for f in flow) == len(m.late) == 1
    assert sum(f.judged + f.late for f in flow) == len(rows)
    assert sum(int(o.numRowsDroppedByWatermark) for p in q.recentProgress for o in p.stateOperators) == 0


def test_alert_log_hands_over_every_record(spark, tmp_path):
    from tests.test_detect_model import random_rows
    from tests.util import events
    from tidemark.plans.detect import detect
    from tidemark.streaming.sinks import alert_records, start_alert_log

    alerts = detect(events(spark, random_rows(3, keys=4, per_key=60)), PROFILES).alerts
    alerts.repartition(3).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    got = []
    q = start_alert_log(
        spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), lambda df, i: got.extend(df.collect()),
        str(tmp_path / "ck"), {"availableNow": True})
    q.awaitTermination()
    assert got and sorted(map(str, got)) == sorted(map(str, alert_records(table).collect()))


def test_metrics_close_once(spark, tmp_path):
    """Windows by event time, malformed records dropped, each closed window written once."""
    import json

    from tests.util import at as when
    from tidemark.schema import RAW
    from tidemark.streaming.metrics import metrics_stream

    def rec(stream, value, t):
        return json.dumps({"stream": stream, "value": value, "at": when(t).strftime("%Y-%m-%dT%H:%M:%S.%fZ")})

    batches = [
        [rec("payments", 100, 1), "{not json", None, rec("payments", 200, 2), rec("sensors", 40, 3)],
        [rec("payments", 50, 12), rec("payments", 7, 4)],  # the second is out of order, within grace
        [rec("payments", 1, 40)],
        [rec("payments", 1, 80)],
    ]
    n = 0
    for b in batches:
        rows = [("k", v, "events", 0, n + i, when(500)) for i, v in enumerate(b)]
        n += len(b)
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    _, table = run(spark, metrics_stream(source), tmp_path, "closed")
    got = table.orderBy("window_start", "stream").collect()
    assert [(r.stream, r["count"], r.sum) for r in got] == [
        ("payments", 3, 307), ("sensors", 1, 40), ("payments", 1, 50), ("payments", 1, 1)]


def test_raw_records_end_to_end(spark, tmp_path):
    """Poison is dead-lettered and does not stop detection; alerts are stored once."""
    import json

    from tests.util import at as when
    from tidemark import default_profiles
    from tidemark.operators.alert_table import Written, insert
    from tidemark.schema import RAW
    from tidemark.streaming.sinks import start_alert_storage, start_detection

    def rec(id, t, lat, lon, value):
        return json.dumps({"id": id, "stream": "payments", "key": "c", "at": when(t).strftime("%Y-%m-%dT%H:%M:%SZ"),
                           "value": value, "unit": "BRL", "geo": {"lat": lat, "lon": lon, "place": id}})

    values = ['{"broken":', rec("sp", -3, -23.5505, -46.6333, 89.9), rec("tokyo", 0, 35.6762, 139.6503, 2400)]
    rows = [("c", v, "events", 0, i, when(0)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(RAW).parquet(str(tmp_path / "in"))
    found = str(tmp_path / "found")
    bad = []
    queries = start_detection(
        source, default_profiles(), str(tmp_path / "ck"), lambda df, i: df.write.mode("append").parquet(found),
        lambda df, i: bad.extend(df.collect()), trigger={"availableNow": True},
    )
    for q in queries:
        q.awaitTermination()
    assert [(r.offset, r.payload) for r in bad] == [(0, '{"broken":')]
    (alert,) = spark.read.parquet(found).collect()
    assert (alert.rule, alert.severity, alert.event_ids) == ("geovelocity", "critical", ["sp", "tokyo"])
    assert alert.detail.startswith("sp → tokyo · 18.5K km in 3s")
    stored, reports = str(tmp_path / "table"), []
    stream = spark.readStream.schema(spark.read.parquet(found).schema).parquet(found)
    q = start_alert_storage(stream, stored, str(tmp_path / "ck2"), lambda i, w: reports.append(w), {"availableNow": True})
    q.awaitTermination()
    assert reports == [Written(1, 0, 0)] and insert(spark.read.parquet(found), stored) == Written(0, 1, 0)


def test_warm_start(spark, tmp_path):
    """A detector seeded from snapshots goes on where the earlier one stopped."""
    from tests.util import event, events
    from tidemark import default_profiles
    from tidemark.operators import changelog

    before = [event(f"a{i:02d}", "payments", "c", i) for i in range(20)]
    after = [event("z", "payments", "c", 21), event("n", "payments", "new", 21)]
    snaps = changelog.snapshots(events(spark, before), default_profiles(), round(before[-1]["at"].timestamp() * 1e6))
    log = changelog.as_log(snaps).withColumn("offset", F.lit(0).cast("long"))
    seeds = changelog.seeds(changelog.compact(log, ["payments"]))
    df = with_seq(spark, after)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    _, table = run(spark, detect_stream(source, default_profiles(), seed=seeds), tmp_path, "warm")
    (r,) = table.collect()
    assert (r.rule, r.key, r.event_ids[-1], len(r.event_ids)) == ("velocity", "c", "z", 12)


def test_processing_timers(spark, tmp_path):
    """Wall-clock timers keep a query busy for good, so it is stopped once it has answered."""
    import time

    from tests.util import event
    from tidemark import default_profiles

    df = with_seq(spark, [event(f"e{i:02d}", "payments", "c", i) for i in range(25)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = detect_stream(source, default_profiles(), timers="processing", wall_clock=True)
    q = (
        out.writeStream.format("memory").queryName("wall").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    )
    try:
        until = time.time() + 90
        while q.isActive and spark.table("wall").count() == 0 and time.time() < until:
            time.sleep(1)
    finally:
        q.stop()
    (r,) = spark.table("wall").collect()
    assert r.rule == "velocity" and r.event_ids[-1] == "e20" and r.detected_at > r.at
    with pytest.raises(ValueError):
        detect_stream(source, default_profiles(), timers="sun")


class _Kept:
    """A state handle that holds one key's state and timers in place."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, ms):
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)

    def getCurrentWatermarkInMs(self):
        return 0


def test_steps_of_a_key_take_and_give_plain_rows():
    """Many keys of few events are the usual case; a frame of pandas for each took some ten milliseconds."""
    profile = next(p for p in default_profiles() if p.stream == "payments")
    handle, made = _Kept(), Row(*STEP_INPUT)
    step = _Windows({"payments": Geometry.of(profile)}, True, micros(timedelta(days=1)))
    step.init(handle)
    began = time.process_time()
    for n in range(1000):
        handle.value, handle.timers = None, []
        rows = [made("payments", f"k{n}", f"{n}-{i}", 10**15 + i * 10**6, float(i) if i else float("nan"), "BRL", 1.0, None, "", True, False, 5 - i, None) for i in range(5)]
        out = list(step.handleInputRows(("payments", f"k{n}"), iter(rows), handle))
        assert [r.id for r in out] == [f"{n}-{i}" for i in (4, 3, 2, 1, 0)] and [r.points for r in out] == [1, 2, 3, 4, 5]
        assert all(r.clock_us == 10**15 + 4 * 10**6 and r.emitted_at.timestamp() == 10**9 + 4 for r in out)
        assert len(handle.timers) == 1 and len(handle.value[0]) == 5
    assert time.process_time() - began < 4
    assert out[0].geo == {"lat": 1.0, "lon": None, "place": ""} and out[-1].value is None and out[0].value == 4


def test_facts_pass_the_cooldown_unchanged(spark):
    """Few columns go through Python; odd text, nulls, large numbers and microseconds come back as they were. What is no number comes back as null."""
    columns = (
        "stream string, key string, event_id string, at timestamp, at_us long, value double, unit string, seq long, clock_us long, emitted_at timestamp, "
        "rule string, which int, place int, absence boolean, n long, from_geo struct<lat:double,lon:double,place:string>, event_ids array<string>, rank int"
    )
    odd = 'a"b\\c\n\t\u00e9\U0001f600{[,'
    rows = [
        ("s", odd, odd, None, 1_700_000_000_123_457, 0.1 + 0.2, odd, 2**62 + 1, 7, None, "r", 1, 0, False, 2**63 - 1, (1e-300, None, ""), [odd, "", None], 3),
        ("s", "k", None, None, -1, float("nan"), "", 0, 0, None, "", 0, None, True, None, None, [], 1),
        ("s", "k", None, None, 5, float("inf"), None, 0, 0, None, "", 0, None, True, None, (None, None, None), None, None),
    ]
    found = spark.createDataFrame(rows, columns).withColumn("at", F.timestamp_micros("at_us"))
    bundled = _bundled(found)
    assert len(bundled.columns) == 11
    got = _unbundled(bundled.drop("emitted_at"), found)
    want = found.drop("emitted_at").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    assert got.dtypes == want.dtypes and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
