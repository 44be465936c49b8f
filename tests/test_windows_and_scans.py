"""Sliding statistics, block scans and several rules of a kind against plain versions; what the plans read."""


import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_detect_model import PROFILES, random_rows, run_model, s
from tests.util import alert_tuples, events
from tidemark import Profile, Stall, Threshold, Velocity, ZScore, detect
from tidemark.operators import segments as seg
from tidemark.operators import stats
from tidemark.operators.frames import event_frames
from tidemark.operators.replay import late_arrivals, replay, replay_frames
from tidemark.operators.segments import numbered_segments
from tidemark.operators.sliding import in_order, moments
from tidemark.profiles import by_stream, micros


def test_moments_of_windows():
    rng = np.random.default_rng(2)
    values = rng.normal(1e6, 3, 700)
    values[100:200] = 0.1
    hi = np.arange(700) + rng.integers(0, 2, 700)
    lo = np.maximum(hi - rng.integers(0, 260, 700), 0)
    want = [(values[a:b].mean() if b > a else 0, values[a:b].std() if b > a else 0) for a, b in zip(lo, hi)]
    for mean, sd in (moments(values, lo, hi), in_order(values, lo, hi)):
        assert np.allclose(mean, [m for m, _ in want], rtol=1e-12) and np.allclose(sd, [d for _, d in want], rtol=1e-6, atol=1e-9)
    _, sd = moments(values, np.array([101, 110]), np.array([200, 140]))
    assert (sd == 0).all()


@pytest.mark.parametrize("batch", [7, 10_000])
def test_window_statistics_across_batches(spark, batch):
    """Keys, restarts and caps that lie across Arrow batches."""
    rows = random_rows(11, keys=5, per_key=120)
    profiles = by_stream(PROFILES)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.id: r for r in event_frames(events(spark, rows), profiles, with_statistics=True).filter("own").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    held = {}
    for r in rows:
        p = profiles[r["stream"]]
        t, history = round(r["at"].timestamp() * 1e6), held.setdefault(r["key"], [])
        if p.stall and history and t - history[-1][0] >= micros(p.stall.after):
            history.clear()
        history.append((t, r["id"], r["value"]))
        kept = [x for x in history if x[0] >= t - micros(p.retention)][-p.cap:]
        window = [x for x in kept if x[0] >= t - micros(p.window)]
        f, v = got[r["id"]], [x[2] for x in window]
        assert (f.points, f.oldest_us, f.newest_us, f.retained) == (len(window), window[0][0], t, len(kept))
        assert f.last_ids == [x[1] for x in window[-12:]] and f.base_n == len(window) - 1
        assert np.isclose(f["mean"], np.mean(v)) and np.isclose(f["stddev"], np.std(v), atol=1e-9)
        for rule, run in zip(p.find(Threshold), f.runs, strict=True):
            i = len(window) - 1
            while i and (v[i - 1] > rule.bound if rule.above else v[i - 1] < rule.bound):
                i -= 1
            assert (run.from_us, run.n) == (window[i][0], len(window) - i)
        if (r["labels"] or {}).get("status") == "done":
            history.clear()
    assert len(got) == len(rows)


def test_frames_hold_no_windows(spark):
    plan = event_frames(events(spark, random_rows(1, 2, 5)), by_stream(PROFILES))._jdf.queryExecution().toString()
    assert "collect_list" not in plan


SEVERAL = (
    Profile("payments", s(60), s(5), 20, s(45), (Velocity(4, s(60)), ZScore(2.0, 4), Velocity(8, s(60)), ZScore(1.2, 3, below=True), ZScore(3.0, 5))),
    Profile("sensors", s(30), s(5), 12, s(20), (Threshold(60, True, s(10)), Threshold(25, False, s(3)), Stall(s(40)), Threshold(300, True, s(0))), sweep_every=s(15)),
)


@pytest.mark.parametrize("host", ["batch", "replay"])
def test_several_rules_of_a_kind(spark, host):
    rows = [r for r in random_rows(21, keys=6, per_key=100) if r["stream"] != "video"]
    as_of = round(rows[-1]["at"].timestamp() * 1e6) + 10_000_000
    m = run_model(rows, SEVERAL, as_of)
    given = events(spark, rows)
    if host == "replay":
        given = given.withColumn("seq", F.substring("id", 2, 6).cast("long"))
    d = (detect if host == "batch" else replay)(given, SEVERAL, as_of)
    assert alert_tuples(d.candidates) == sorted(m.found)
    assert alert_tuples(d.alerts) == sorted(m.alerts)
    assert d.alerts.select("id").distinct().count() == len(m.alerts)


def test_two_stalls_are_refused():
    with pytest.raises(ValueError, match="more than one stall"):
        by_stream([Profile("x", s(1), s(1), 5, s(1), (Stall(s(5)), Stall(s(9))), sweep_every=s(1))])


def scans(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.partition("== Initial Plan ==")[0].count("Scan parquet")


@pytest.mark.parametrize("slices", [1, 4096])
def test_segments(spark, monkeypatch, slices):
    monkeypatch.setattr(seg, "SLICES_PER_BLOCK", slices)
    monkeypatch.setattr(seg, "WINDOWS_PER_SLICE", 1)
    rows = random_rows(5, keys=6, per_key=120)
    profiles, lives, want = by_stream(PROFILES), {}, {}
    for r in rows:
        p, t = profiles[r["stream"]], round(r["at"].timestamp() * 1e6)
        n, last, ended = lives.get(r["key"], (0, None, False))
        n += last is not None and (ended or (p.stall is not None and t - last >= micros(p.stall.after)))
        want[r["id"]] = n
        lives[r["key"]] = (n, t, (r["labels"] or {}).get("status") == "done")
    got = numbered_segments(events(spark, rows), profiles)
    assert {r.id: r.segment for r in got.collect()} == want
    assert max(want.values()) > 5 and scans(got) <= 3


def test_scans_read_written_rows_twice_at_most(spark):
    rows = events(spark, random_rows(6, keys=3, per_key=50))
    numbered = rows.withColumn("seq", F.substring("id", 2, 6).cast("long"))
    assert scans(stats.sample_every(rows, "at", "id")) <= 3
    assert scans(late_arrivals(numbered, s(60), s(5))) <= 3
    assert scans(replay_frames(numbered, by_stream(PROFILES))) <= 3
