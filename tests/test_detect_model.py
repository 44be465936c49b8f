"""Batch detection against the one-at-a-time model, in event-time order."""

import random
from dataclasses import replace
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.model import Model
from tests.util import alert_tuples, event, events, us
from tidemark import GeoVelocity, Profile, Stall, Threshold, Velocity, ZScore, detect
from tidemark.operators import blocks, cooldown
from tidemark.operators.frames import prepare
from tidemark.operators.staging import stage
from tidemark.profiles import by_stream

s = lambda n: timedelta(seconds=n)

PROFILES = (
    Profile("payments", s(60), s(5), 8, s(45),
            (Velocity(4, s(60)), GeoVelocity(1000, 100), ZScore(2.0, 4, below=True))),
    Profile("video", s(90), s(10), 256, s(45),
            (Velocity(5, s(90)), Stall(s(45)), Threshold(30, False, s(20))), sweep_every=s(15)),
    Profile("sensors", s(30), s(5), 12, s(20),
            (Velocity(3, s(30)), Stall(s(40)), Threshold(60, True, s(10)), ZScore(1.5, 3, min_delta=5)),
            sweep_every=s(15)),
)


def random_rows(seed, keys=6, per_key=150):
    rnd = random.Random(seed)
    rows = []
    for k in range(keys):
        stream = ("payments", "video", "sensors")[k % 3]
        t = rnd.uniform(0, 50)
        for _ in range(per_key):
            t += rnd.choice([0, 0.5, 1, 3, 5, 5, 20, 44.5, 45, 70, 200] if k < keys - 1 else [0, 0.5, 1])
            geo = None if rnd.random() < 0.2 else (rnd.uniform(-60, 60), rnd.uniform(-180, 180))
            value = rnd.choice([10, 20, 29, 31, 50, 61, 80, 500])
            status = "done" if rnd.random() < 0.03 else "running"
            rows.append(event("", stream, f"k{k}", round(t, 3), value, geo, status))
    rows.sort(key=lambda r: r["at"])
    for i, r in enumerate(rows):
        r["id"] = f"e{i:06d}"
    return rows


def run_model(rows, profiles, as_of):
    m = Model(by_stream(profiles))
    for r in rows:
        geo = None if r["geo"] is None else (r["geo"]["lat"], r["geo"]["lon"])
        t = us((r["at"] - rows[0]["at"]).total_seconds()) - us(0)
        t = round(r["at"].timestamp() * 1e6)
        m.event(r["stream"], r["key"], r["id"], t, r["value"], geo,
                (r["labels"] or {}).get("status") == "done")
    for stream, key in list(m.keys):
        m.silence(stream, key, as_of)
    return m


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_model(spark, seed):
    rows = random_rows(seed)
    as_of = round(rows[-1]["at"].timestamp() * 1e6) + 10_000_000
    m = run_model(rows, PROFILES, as_of)
    d = detect(events(spark, rows), PROFILES, as_of)
    assert {r[0] for r in m.found} == {"velocity", "geovelocity", "zscore", "stall", "threshold"}
    assert alert_tuples(d.candidates) == sorted(m.found)
    assert alert_tuples(d.alerts) == sorted(m.alerts)
    c = d.counters.first()
    assert (c.processed, c.alerted, c.suppressed, c.late, c.invalid) == (
        len(rows), len(m.alerts), len(m.found) - len(m.alerts), 0, 0)


@pytest.mark.parametrize("rows_a_slice", [25, 150])
def test_keys_that_fire_through_many_slices(spark, monkeypatch, rows_a_slice):
    monkeypatch.setattr(cooldown, "SLICE_ROWS", rows_a_slice)
    rnd = random.Random(7)
    rows = []
    for k in range(3):
        t = 0.0
        for i in range(700):
            t += rnd.choice([0.0, 0.3, 0.7, 1.1, 1.9])
            status = "done" if rnd.random() < 0.004 else None
            rows.append(event("", "payments", f"hot{k}", round(t, 3), rnd.choice([1, 2, 3]), None, status))
    rows.sort(key=lambda r: r["at"])
    for i, r in enumerate(rows):
        r["id"] = f"e{i:06d}"
    profiles = (Profile("payments", s(20), s(2), 64, s(12), (Velocity(12, s(14)), ZScore(1.0, 3, below=True))),)
    m = run_model(rows, profiles, 0)
    d = detect(events(spark, rows), profiles)
    slices = stage(cooldown.folded(d.staged, d.profiles), "slices")
    assert cooldown.entries(slices).count() > 5
    assert len({r[5] for r in m.alerts}) > 1
    assert alert_tuples(d.candidates) == sorted(m.found)
    assert alert_tuples(d.alerts) == sorted(m.alerts)


@pytest.mark.parametrize("broadcast", [True, False])
def test_busy_keys_are_cut_into_blocks(spark, monkeypatch, broadcast):
    """Same result when keys are cut, ties and terminal events at the cuts included."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 60)
    monkeypatch.setattr(blocks, "MAX_BLOCKS", 16)
    monkeypatch.setattr(blocks, "STRIDE", 3)
    if not broadcast:
        monkeypatch.setattr(blocks, "MAX_BROADCAST_KEYS", 0)
    rows = random_rows(9, keys=4, per_key=150)
    # Many rows at one instant, and a second busy key with few distinct times.
    rows += [event("", "sensors", "k2", 700, 70 + i % 7) for i in range(120)]
    rows += [event("", "payments", "burst", [0, 30, 31][i % 3], 10 + i % 5, (float(i % 9), float(i % 50))) for i in range(300)]
    rows.sort(key=lambda r: r["at"])
    for i, r in enumerate(rows):
        r["id"] = f"e{i:06d}"
    profiles = tuple(replace(p, max_points=min(p.max_points, 15)) for p in PROFILES)
    as_of = round(rows[-1]["at"].timestamp() * 1e6) + 100_000_000
    m = run_model(rows, profiles, as_of)
    d = detect(events(spark, rows), profiles, as_of)
    cut = blocks.with_blocks(prepare(d.events), d.profiles)
    parts = cut.groupBy("key").agg(F.countDistinct("block").alias("n")).collect()
    assert max(r.n for r in parts) >= 3
    assert alert_tuples(d.candidates) == sorted(m.found)
    assert alert_tuples(d.alerts) == sorted(m.alerts)


def test_stall_inside_cooldown_is_refused(spark):
    p = replace(PROFILES[1], cooldown=s(46))
    with pytest.raises(ValueError, match="operators.replay"):
        detect(events(spark, random_rows(1, 1, 2)), [p]).frames


def fold(hits, state):
    """The state after plain (clock, rank, cool, ends) steps."""
    for clock, rank, cool, ends in hits:
        if ends:
            state = cooldown.FREE
        elif clock >= state[0] or rank > state[1]:
            state = (clock + cool, rank)
    return state


def arrays(hits):
    return [np.array(c, t) for c, t in zip(zip(*hits), ("int64", "int32", "int64", "bool"))]


def test_transfer_functions_are_folds():
    rnd = random.Random(3)
    for _ in range(300):
        cool, t, hits = rnd.choice([0, 1, 5, 9]), 100, []
        for _ in range(rnd.randrange(1, 40)):
            t += rnd.choice([0, 0, 1, 1, 2, 4])
            hits.append((t, rnd.choice([1, 1, 1, 2, 2, 3]), cool, rnd.random() < 0.05))
        runs = cooldown.transfer(*arrays(hits))
        # Whatever enters was admitted at the first row's time at the latest.
        states = [cooldown.FREE] + [(100 + u, r) for u in range(-12, hits[0][0] - 100 + cool + 1) for r in (1, 2, 3)]
        for state in states:
            assert cooldown.through(runs, state) == fold(hits, state), (hits, state)


def test_a_key_with_a_million_hits_has_few_runs():
    rng = np.random.default_rng(1)
    clock = np.cumsum(rng.integers(1, 2_000_000, 1_000_000))
    rank = rng.choice([1, 2, 3], 1_000_000, p=[0.9, 0.09, 0.01]).astype("int32")
    cool = np.full(len(clock), 30_000_000)
    runs = cooldown.transfer(clock, rank, cool, np.zeros(len(clock), bool))
    assert len(runs) < 100
    hits = list(zip(clock[:20_000].tolist(), rank[:20_000].tolist(), cool[:20_000].tolist(), [False] * 20_000))
    few = cooldown.transfer(*arrays(hits))
    for u in (0, 1_000_000, 17_000_000, 29_000_000):
        assert cooldown.through(few, (int(clock[0]) + u, 1)) == fold(hits, (int(clock[0]) + u, 1))
