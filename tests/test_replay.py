"""Arrival-order replay against the model, and the keyed window's boundaries."""

import random
from dataclasses import replace

import pytest

from tests.model import Model
from tests.test_detect_model import PROFILES, random_rows, s
from tests.util import alert_tuples, event, events, us
from tidemark import detect
from tidemark.operators import replay as replay_module
from tidemark.operators.keyed_window import Geometry, KeyedWindow, Point
from tidemark.operators.replay import replay, step_input, with_units
from tidemark.profiles import by_stream


def shuffled(rows, seed, spread):
    """Arrival order: event time plus a random delay."""
    rnd = random.Random(seed)
    rows = [dict(r, order=r["at"].timestamp() + rnd.choice([0, 0, 0, rnd.uniform(0, spread)])) for r in rows]
    rows.sort(key=lambda r: r["order"])
    return rows


def with_seq(spark, rows):
    order = {r["id"]: i for i, r in enumerate(rows)}
    pairs = spark.createDataFrame(list(order.items()), "id string, seq long")
    return events(spark, rows).join(pairs, "id")


def model_of(rows, profiles, as_of):
    m = Model(by_stream(profiles))
    for r in rows:
        geo = None if r["geo"] is None else (r["geo"]["lat"], r["geo"]["lon"])
        m.event(r["stream"], r["key"], r["id"], round(r["at"].timestamp() * 1e6), r["value"], geo,
                (r["labels"] or {}).get("status") == "done")
    for stream, key in list(m.keys):
        m.silence(stream, key, as_of)
    return m


FLAPPY = tuple(replace(p, cooldown=s(100)) if p.stall else p for p in PROFILES)


@pytest.mark.parametrize("profiles,spread", [(PROFILES, 30), (PROFILES, 400), (FLAPPY, 300)])
def test_replay_equals_model(spark, monkeypatch, profiles, spread):
    monkeypatch.setattr(replay_module, "ARRIVALS_PER_BLOCK", 16)
    rows = shuffled(random_rows(3, keys=6, per_key=120), 4, spread)
    as_of = max(round(r["at"].timestamp() * 1e6) for r in rows) + 20_000_000
    m = model_of(rows, profiles, as_of)
    d = replay(with_seq(spark, rows), profiles, as_of)
    assert (spread < 100 or m.late) and sorted(m.late) == sorted(r.id for r in d.late.collect())
    assert alert_tuples(d.alerts) == sorted(m.alerts)


@pytest.mark.parametrize("per_block", [20, 64])
def test_busy_keys_are_cut_at_arrival_blocks(spark, monkeypatch, per_block):
    """Keys that never fall silent, with late records, terminal events and stalls."""
    monkeypatch.setattr(replay_module, "ARRIVALS_PER_BLOCK", per_block * 3)
    monkeypatch.setattr(replay_module, "BUSY_ROWS", 50)
    rnd = random.Random(per_block)
    rows = []
    for stream, key in (("payments", "a"), ("video", "b"), ("sensors", "c")):
        t = 0.0
        for _ in range(300):
            t += rnd.choice([0, 0.5, 1, 2, 4, 9] if rnd.random() < 0.97 else [43, 47, 300])
            status = "done" if rnd.random() < 0.02 else None
            geo = (rnd.uniform(-60, 60), rnd.uniform(-90, 90))
            rows.append(event("", stream, key, round(t, 3), rnd.choice([10, 25, 35, 61, 80, 500]), geo, status))
    rows.sort(key=lambda r: r["at"])
    for i, r in enumerate(rows):
        r["id"] = f"e{i:06d}"
    rows = shuffled(rows, 5, 90)
    profiles = tuple(replace(p, max_points=min(p.max_points, 12)) for p in PROFILES)
    as_of = max(round(r["at"].timestamp() * 1e6) for r in rows) + 200_000_000
    df = with_seq(spark, rows)
    units = with_units(step_input(df), by_stream(profiles))
    assert units.filter("warm").select("key", "unit_seq").distinct().count() >= 5
    m = model_of(rows, profiles, as_of)
    d = replay(df, profiles, as_of)
    assert m.late and sorted(m.late) == sorted(r.id for r in d.late.collect())
    assert alert_tuples(d.alerts) == sorted(m.alerts)


def test_in_order_replay_equals_batch(spark):
    rows = random_rows(5, keys=3, per_key=100)
    df = with_seq(spark, rows)
    as_of = round(rows[-1]["at"].timestamp() * 1e6)
    assert alert_tuples(replay(df, PROFILES, as_of).alerts) == alert_tuples(
        detect(events(spark, rows), PROFILES, as_of).alerts
    )


def test_quiet_gaps_cut_a_key_into_units(spark):
    rows = [event(f"e{i}", "payments", "k", t) for i, t in enumerate([0, 1, 2, 200, 201, 190, 900])]
    units = with_units(step_input(with_seq(spark, rows)), by_stream(PROFILES))
    assert [r.unit_seq for r in units.orderBy("seq").collect()] == [0, 0, 0, 3, 3, 3, 6]


G = Geometry(size=60_000_000, grace=10_000_000, cap=256, cooldown=0, after=None)


def feed(w, g, *seconds):
    return [w.step(g, Point(us(t), f"p{t}", float(t), None), False, None)[-1] for t in seconds]


def test_late_and_grace():
    w = KeyedWindow()
    kinds = [f.kind for f in feed(w, G, 0, 71, 0.5)]
    assert kinds == ["event", "event", "late"] and w.late == 1
    hidden = feed(w, G, 5)[0]
    assert hidden.kind == "event" and us(5) not in [p.at for p in hidden.window]
    assert us(30) in [p.at for p in feed(w, G, 30)[0].window]
    assert us(70) in [p.at for p in feed(w, G, 70)[0].window]


def test_points_are_kept_in_time_order():
    w = KeyedWindow()
    feed(w, G, 0, 40, 10, 30, 20)
    assert [p.value for p in w.points] == [0, 10, 20, 30, 40]


@pytest.mark.parametrize("cap,kept", [(4, 4), (1, 2)])
def test_cap_keeps_the_newest(cap, kept):
    w = KeyedWindow()
    p = replace(PROFILES[0], max_points=cap)
    g = Geometry.of(p)
    feed(w, g, *range(20))
    assert [x.value for x in w.points] == list(map(float, range(20)))[-kept:]


def test_preceding_is_judged_by_time_not_arrival():
    w = KeyedWindow()
    last = feed(w, G, 0, 65, 45)[-1]
    assert last.prev.value == 0


def test_flapping_key_keeps_its_stall_cooldown():
    g = Geometry(60_000_000, 0, 256, 300_000_000, 30_000_000)
    w = KeyedWindow()
    feed(w, g, 0)
    assert w.sweep(g, us(40)).kind == "stall" and not w.points
    w.step(g, Point(us(41), "b", 1.0, None), False, us(41))
    assert w.sweep(g, us(81)) is None and w.points  # suppressed, so still watched
    feed(w, g, 82)
    assert w.sweep(g, us(82 + 360)).kind == "stall"


def test_a_finished_key_never_stalls():
    g = Geometry(60_000_000, 0, 256, 0, 30_000_000)
    w = KeyedWindow()
    w.step(g, Point(us(0), "a", 1.0, None), False, None)
    w.step(g, Point(us(1), "b", 1.0, None), True, None)
    assert w.sweep(g, us(3600)) is None and w.next_sweep(g) is None
