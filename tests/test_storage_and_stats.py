from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.util import T0, at, event, events, us
from tidemark import default_profiles
from tidemark.operators import alert_table as at_
from tidemark.operators import changelog, stats
from tidemark.operators.metrics import latest_windows, tumbling
from tidemark.operators.slices import Running, floor_div, running
from tidemark.schema import ALERT


def alerts(spark, rows):
    """rows of (id, second, delay, absence) with optional severity."""
    made = []
    for r in rows:
        id, t, delay, absence = r[:4]
        sev = r[4] if len(r) > 4 else "info"
        made.append((id, "velocity", "payments", "c", at(t), at(t + delay), sev, "t", "d", '{"n":1}', [id or "x"], absence))
    return spark.createDataFrame(made, ALERT)


def test_rows(spark):
    rows = at_.alert_rows(alerts(spark, [("a", 0, 0.0425, False, "critical"), ("b", 0, 240, True), ("c", 0, -1.5, False)])).orderBy("alert_id").collect()
    assert [r.latency_ms for r in rows] == [42, None, None] and rows[0].severity_rank == 3
    assert rows[0].pk == "ALERT#payments#c" and rows[0].sk == "2026-09-02T12:00:00.042500Z#a"
    assert rows[0].expires_at == us(0) // 1_000_000 + 30 * 86400


def test_insert_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "alerts")
    first = alerts(spark, [("a", 0, 1, False), ("b", 1, 1, False), ("a", 0, 1, False), ("", 2, 1, False)])
    assert at_.insert(first, path) == at_.Written(2, 1, 1)
    assert at_.insert(first, path) == at_.Written(0, 3, 1)
    more = first.unionByName(alerts(spark, [("c", 86400 * 3, 1, False)]))
    assert at_.insert(more, path) == at_.Written(1, 3, 1)
    stored = spark.read.parquet(path)
    assert sorted(r.alert_id for r in stored.collect()) == ["a", "b", "c"]
    assert at_.insert(first.limit(0), path) == at_.Written(0, 0, 0)
    # Retention: rows by their own expiry, files by the day.
    later = T0.replace(tzinfo=None) + timedelta(days=30, seconds=1)
    assert [r.alert_id for r in at_.live(stored, later).orderBy("alert_id").collect()] == ["b", "c"]
    assert at_.drop_expired_days(spark, path, later) == []
    gone = at_.drop_expired_days(spark, path, later + timedelta(days=1))
    assert gone == ["stream=payments/day=2026-09-02"]
    assert [r.alert_id for r in spark.read.parquet(path).collect()] == ["c"]


def test_lookups(spark):
    df = alerts(spark, [(f"a{i:03d}", i, 0, False, ("info", "warn", "critical")[i % 3]) for i in range(100)])
    assert [r.id for r in at_.recent(df).collect()] == [f"a{i:03d}" for i in range(99, 39, -1)]
    rows = at_.alert_rows(df)
    assert at_.by_severity(rows).first().alert_id == "a098"
    assert at_.of_entity(rows, "payments", "c").first().alert_id == "a099"
    assert at_.of_entity(rows, "payments", "d").count() == 0 and at_.brief(rows).count() == 10


@pytest.mark.parametrize("values,ring,want", [
    (range(1, 101), 2000, (100, 51, 96, 100, 100, 100)),
    ([1000] * 10 + [1] * 10, 10, (20, 1, 1, 1, 1000, 1)),
    ([], 2000, (0, 0, 0, 0, 0, 0)),
    ([7], 2000, (1, 7, 7, 7, 7, 7)),
])
def test_latency(spark, values, ring, want):
    df = alerts(spark, [(f"a{i:04d}", i * 10, v / 1000, False) for i, v in enumerate(values)]
                + [("s", 0, 240, True), ("t", 0, -1.5, False)])
    assert tuple(stats.latency_stats(df, samples=ring).first()) == want


def test_latency_classes(spark):
    df = stats.classify_latency(alerts(spark, [("a", 0, 0.042, False), ("b", 0, 240, True), ("c", 0, -1.5, False), ("d", 0, 0, False)]))
    assert [r.latency_class for r in df.orderBy("id").collect()] == ["usable", "absence", "skewed", "usable"]


def test_rates(spark):
    rows = events(spark, [event(f"e{i}", "video", "k", i / 100) for i in range(120)] + [event("x", "video", "k", 5)])
    got = stats.rates(rows, "at", timedelta(seconds=2)).orderBy("interval_start").collect()
    assert [(r["count"], r.per_second, r.total) for r in got] == [(120, 60, 120), (0, 0, 120), (1, 0.5, 121), (0, 0, 121)]


def test_sample(spark):
    rows = events(spark, [event(f"e{i:04d}", "video", "k", i / 45) for i in range(180)])
    got = stats.sample_every(rows, "at", "id").orderBy("number").collect()
    # The first second has nothing to go by; then 45 a second means every third.
    assert [r.number for r in got] == list(range(1, 46)) + list(range(48, 181, 3))


def test_running_over_blocks(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS o", "id * 7919 % 1009 AS v", "if(id % 5 = 0, id, null) AS s")
    aggs = [Running("total", F.col("v"), "sum"), Running("top", F.col("v"), "max"), Running("seen", F.col("s"), "last")]
    for inclusive in (True, False):
        got = running(df, ["k"], ["o"], [floor_div(F.col("o"), 10), floor_div(F.col("o"), 100)], aggs, inclusive)
        state = {}
        for r in got.orderBy("o").collect():
            total, top, seen = state.get(r.k, (0, None, None))
            after = (total + r.v, r.v if top is None else max(top, r.v), r.s if r.s is not None else seen)
            assert (r.total, r.top, r.seen) == (after if inclusive else (total, top, seen))
            state[r.k] = after


def test_tumbling(spark):
    rows = events(spark, [event("a", "payments", "c", 1, 100), event("b", "payments", "c", 2, 200), event("s", "sensors", "c", 3, 40),
                          event("d", "payments", "c", 40, 1)])
    got = tumbling(rows).orderBy("window_start", "stream").collect()
    assert [(r.stream, r["count"], r.sum, r.mean, r.min, r.max, r.per_second) for r in got] == [
        ("payments", 2, 300, 150, 100, 200, 0.2), ("sensors", 1, 40, 40, 40, 40, 0.1), ("payments", 1, 1, 1, 1, 1, 0.1)]
    newest = latest_windows(tumbling(rows)).orderBy("stream").collect()
    assert [(r.stream, r["count"], r.window_start) for r in newest] == [
        ("payments", 1, at(40).replace(tzinfo=None)), ("sensors", 1, at(0).replace(tzinfo=None))]


def test_snapshots_and_compaction(spark):
    rows = events(spark, [
        event("a", "payments", "c", 0, 1), event("b", "payments", "c", 30, 2), event("c", "payments", "c", 70, 3, (1.0, 2.0)),
        event("v", "video", "fin", 70, 1, status="done"), event("w", "video", "lost", -200, 1), event("x", "video", "on", 60, 1),
    ])
    snaps = changelog.snapshots(rows, default_profiles(), us(80))
    held = {r.key: None if r.points is None else [p.id for p in r.points] for r in snaps.collect()}
    assert held == {"c": ["b", "c"], "fin": None, "lost": None, "on": ["x"]}
    log = changelog.as_log(snaps).withColumn("offset", F.lit(5).cast("long"))
    assert {r.key for r in log.filter("value is null").collect()} == {"video/fin", "video/lost"}
    older = spark.createDataFrame([
        ("payments/c", '{"key":{"stream":"payments","id":"c"},"points":[{"id":"old"}]}', 1), ("video/fin", '{"key":{"stream":"video","id":"fin"},"points":[{"id":"old"}]}', 2),
        ("payments/gone", '{"key":{"stream":"payments","id":"gone"},"points":[]}', 3), ("no-separator", None, 4), ("payments/c", "{oops", 9),
        ("telemetry/t", '{"key":{"stream":"telemetry","id":"t"},"points":[{"id":"t"}]}', 9),
    ], "key string, value string, offset long")
    kept = changelog.compact(log.drop("timestamp").unionByName(older), ["payments", "video"])
    assert {(r.stream, r.id, len(r.points)) for r in kept.collect()} == {("payments", "c", 2), ("video", "on", 1)}
    seeds = {r.key: r.points for r in changelog.seeds(kept).collect()}
    assert [(p.at, p.id, p.has_geo) for p in seeds["c"]] == [(us(30), "b", False), (us(70), "c", True)]
    assert {r.key for r in changelog.live_keys(rows.withColumn("seq", F.col("id")), {p.stream: p for p in default_profiles()}, us(80)).collect()} == {"c", "on"}
