"""Storage in steps: exact folders, forwarding in portions, compaction of what was appended, counters of a run, closed windows."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_detect_model import PROFILES, random_rows, s
from tests.test_replay import model_of, shuffled, with_seq
from tests.test_storage_and_stats import alerts
from tests.util import T0, event, events
from tidemark import detect
from tidemark.operators import alert_table, changelog
from tidemark.operators.metrics import closed, latest_windows, tumbling
from tidemark.operators.replay import replay
from tidemark.streaming.sinks import forward_batches, start_forwarding

DAY = 86_400


def test_insert_reads_the_days_of_the_batch_alone(spark, tmp_path):
    path = str(tmp_path / "odd name")
    alert_table.insert(alerts(spark, [(f"a{d}", d * DAY, 1, False) for d in range(9)]), path)
    batch = alerts(spark, [("a1", DAY, 1, False), ("old", DAY, 2, False), ("new", 20 * DAY, 1, False), ("a7", 7 * DAY, 1, False)])
    rows = alert_table.alert_rows(batch)
    days = [tuple(r) for r in rows.select(*alert_table.LAYOUT).distinct().collect()]
    stored = alert_table.stored_rows(spark, path, days, rows.schema)
    assert {f.split("day=")[1][:10] for f in stored.inputFiles()} == {str((T0 + timedelta(days=d)).date()) for d in (1, 7)}
    assert alert_table.insert(batch, path) == alert_table.Written(2, 2, 0)
    assert alert_table.insert(batch, path) == alert_table.Written(0, 4, 0)
    assert spark.read.parquet(path).count() == 11


def test_insert_of_streams_with_odd_names(spark, tmp_path):
    batch = alerts(spark, [("a", 0, 1, False), ("b", 1, 1, False)]).withColumn("stream", F.concat(F.lit("a/b:ü %"), F.col("id")))
    assert alert_table.insert(batch, str(tmp_path)) == alert_table.Written(2, 0, 0)
    assert alert_table.insert(batch, str(tmp_path)) == alert_table.Written(0, 2, 0)


class Flaky:
    """Writes portions to a folder, and refuses each of some portions a few times."""

    def __init__(self, folder, refusals):
        self.folder, self.refusals = str(folder), refusals

    def __call__(self, rows):
        import os
        import uuid

        first = rows[0]["n"]
        seen = f"{self.folder}/refused-{first}"
        tries = len(open(seen).read()) if os.path.exists(seen) else 0
        if tries < self.refusals.get(first % 7, 0):
            with open(seen, "a") as f:
                f.write("x")
            raise OSError("not now")
        with open(f"{self.folder}/got-{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps([r["n"] for r in rows]))


def portions(folder):
    return [json.loads(p.read_text()) for p in folder.glob("got-*")]


def test_forwarding_in_portions(spark, tmp_path):
    got = tmp_path / "got"
    got.mkdir()
    write = forward_batches(Flaky(got, {0: 2, 3: 1}), str(tmp_path / "progress"), size=7, wait=0.01, attempts=4)
    batch = spark.range(400).repartitionByRange(3, "id").withColumnRenamed("id", "n")
    write(batch, 0)
    sent = portions(got)
    assert sorted(n for p in sent for n in p) == list(range(400)) and max(map(len, sent)) == 7
    assert all(p == list(range(p[0], p[0] + len(p))) for p in sent)
    write(batch, 0)  # repeated after all of it was sent
    assert len(portions(got)) == len(sent)
    write(batch.limit(0), 1)
    assert len(portions(got)) == len(sent)


def test_a_repeated_batch_goes_on_where_it_failed(spark, tmp_path):
    got = tmp_path / "got"
    got.mkdir()
    (tmp_path / "in").mkdir()
    spark.range(60).selectExpr("id AS n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("n long").parquet(str(tmp_path / "in"))
    args = dict(progress=str(tmp_path / "progress"), checkpoint=str(tmp_path / "ck"), trigger={"availableNow": True}, size=20, wait=0.01, attempts=2)
    flaky = Flaky(got, {6: 4})  # the third portion, from row 20 on, fails twice in each of two runs
    query = start_forwarding(source, flaky, **args)
    with pytest.raises(Exception, match="not now"):
        query.awaitTermination()
    before = portions(got)
    assert before == [list(range(20))]
    for _ in range(3):
        query = start_forwarding(source, flaky, **args)
        try:
            query.awaitTermination()
            break
        except Exception:  # noqa: BLE001
            pass
    assert sorted(portions(got)) == [list(range(20)), list(range(20, 40)), list(range(40, 60))]


def test_compaction_in_steps(spark):
    snap = lambda key, t: json.dumps({"key": {"stream": "video", "id": key}, "points": [{"id": f"e{t}", "at": "2026-09-02T12:00:00.000001Z", "value": 1.0}], "written": "2026-09-02T12:00:00Z"})
    records = [(f"video/k{i % 7}", None if i % 5 == 0 else "{oops" if i % 11 == 0 else snap(f"k{i % 7}", i), i) for i in range(90)]
    log = spark.createDataFrame(records, "key string, value string, offset long")
    whole = sorted(tuple(r) for r in changelog.compact(log, ["video"]).select("id", "offset").collect())
    done = None
    for upto in (13, 14, 14, 60, 90):
        done = changelog.advance(done, log.filter(F.col("offset") < upto), ["video"])
    assert sorted(tuple(r) for r in done.rows.select("id", "offset").collect()) == whole and done.upto == 89
    assert changelog.advance(done, log, ["video"]) is done
    # A key that was deleted stays away.
    gone = changelog.advance(done, log.unionByName(spark.createDataFrame([("video/k1", None, 90)], log.schema)), ["video"])
    assert {r.id for r in gone.rows.collect()} == {i for i, _ in whole} - {"k1"}
    assert changelog.advance(None, log.limit(0), ["video"]).rows.count() == 0


def test_replay_counters(spark):
    rows = shuffled(random_rows(31, keys=6, per_key=80), 6, 300)
    as_of = max(round(r["at"].timestamp() * 1e6) for r in rows) + 10_000_000
    m = model_of(rows, PROFILES, as_of)
    given = with_seq(spark, rows + [event("", "payments", "k", 0)])
    c = replay(given, PROFILES, as_of).counters.first()
    stalls = sum(a[0] == "stall" for a in m.alerts)
    found = sum(f[0] != "stall" for f in m.found) + stalls
    assert (c.processed, c.late, c.alerted, c.swept, c.invalid) == (len(rows), len(m.late), len(m.alerts), stalls, 1)
    assert c.suppressed == found - len(m.alerts) and len(m.late) > 0


def test_closed_windows(spark):
    rows = events(spark, [event("a", "video", "k", 1), event("b", "video", "k", 12), event("c", "sensors", "k", 14), event("d", "video", "k", 25)])
    metrics = tumbling(rows)
    got = lambda grace: {(r.stream, r.window_start.second) for r in closed(metrics, rows, s(grace)).collect()}
    assert got(5) == {("video", 0), ("video", 10), ("sensors", 10)} and got(5.1) == {("video", 0)} and got(30) == set()
    assert {(r.stream, r.window_start.second) for r in latest_windows(closed(metrics, rows)).collect()} == {("video", 10), ("sensors", 10)}


def test_counters_of_nothing(spark):
    nothing = with_seq(spark, random_rows(1, keys=3, per_key=2)).filter("1 = 0")
    assert tuple(replay(nothing, PROFILES, 0).counters.first()) == tuple(detect(nothing, PROFILES, 0).counters.first()) == (0,) * 6
