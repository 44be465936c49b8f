"""Rule boundaries, one key per case so that all cases run together."""

from datetime import timedelta

from tests.util import event, events
from tidemark import GeoVelocity, Profile, Stall, Threshold, Velocity, ZScore, default_profiles, detect

s = lambda n: timedelta(seconds=n)
SP, TOKYO, RIO, GRU = (-23.5505, -46.6333), (35.6762, 139.6503), (-22.9068, -43.1729), (-23.4356, -46.4731)
WIDE = dict(window=timedelta(hours=12), grace=s(0), max_points=256, cooldown=s(0))


def run(spark, cases, rules, stream="payments", as_of=None, **profile):
    """{key: last alert of the key, or None} for {key: [(second, value, geo), ...]}."""
    rows = []
    for key, points in cases.items():
        for i, p in enumerate(points):
            t, value, geo = (*p, None, None)[:3]
            rows.append(event(f"{key}-{i:03d}", stream, key, t, 1.0 if value is None else value, geo))
    p = Profile(stream, rules=tuple(rules), **{**WIDE, **profile})
    found = detect(events(spark, rows), [p], as_of).candidates.orderBy("at_us", "seq").collect()
    out = dict.fromkeys(cases)
    for r in found:
        out[r.key] = r
    return out


def test_velocity(spark):
    def spaced(n, gap):
        return [(i * gap,) for i in range(n)]

    got = run(spark, {
        "5": spaced(5, 1), "10": spaced(10, 1), "11": spaced(11, 1), "info": spaced(11, 5.5), "warn": spaced(11, 4.5),
        "critical": spaced(11, 3), "same time": spaced(11, 0), "24": spaced(24, 0.3),
    }, [Velocity(10, s(60))], window=s(60))
    assert got["5"] is None and got["10"] is None
    assert [got[k].severity for k in ("11", "info", "warn", "critical", "same time")] == ["critical", "info", "warn", "critical", "info"]
    r = got["24"]
    assert r.title == "Card testing" and '"count":24' in r.evidence and len(r.event_ids) == 12
    assert r.event_ids[-1] == "24-023" and r.detail == "24 events in 6.9s (limit 10 per 1m00s)"
    free = run(spark, {"k": spaced(3, 30)}, [Velocity(2, s(0))], window=s(90))
    assert free["k"].severity == "critical"


def test_geovelocity(spark):
    got = run(spark, {
        "far": [(0, 1, SP), (41, 1, TOKYO)], "flight": [(0, 1, SP), (18000, 1, RIO)], "near": [(0, 1, SP), (1, 1, GRU)],
        "at once": [(0, 1, SP), (0, 1, TOKYO)], "single": [(0, 1, SP)], "none now": [(0, 1, SP), (41, 1, None)],
        "none before": [(0, 1, SP), (20, 1, None), (41, 1, TOKYO)],
    }, [GeoVelocity(1000, 100)])
    assert {k for k, r in got.items() if r} == {"far", "at once"}
    assert got["far"].event_ids == ["far-000", "far-001"] and got["far"].severity == "critical"
    assert "18.5K km in 41s · 1.6M km/h" in got["far"].detail and "∞" in got["at once"].detail
    # The look-back is the retention, not unlimited.
    past = run(spark, {"old": [(0, 1, SP), (70, 1, TOKYO)], "held": [(0, 1, SP), (65, 1, TOKYO)]},
               [GeoVelocity(1000, 100)], window=s(60), grace=s(5))
    assert past["old"] is None and past["held"] is not None


def test_zscore(spark):
    usual = [85, 92, 88, 95, 90, 87, 93, 91, 89, 94, 86, 90]
    tight = [99, 100, 101, 100, 99, 101, 100, 100, 101, 99, 100, 100]
    series = lambda vs: [(i, v) for i, v in enumerate(vs)]
    got = run(spark, {
        "high": series([*usual, 2400]), "usual": series([*usual, 91]), "low": series([*usual, -500]), "two": series([1, 500]),
        "flat": series([100] * 19 + [9999]), "floorless": series([*tight, 108]),
    }, [ZScore(4, 12, below=True)])
    assert {k for k, r in got.items() if r} == {"high", "low", "floorless"}
    assert '"samples":12' in got["high"].evidence and "σ below this key's mean" in got["low"].detail
    floor = run(spark, {k: series([*tight, v]) for k, v in (("8", 108), ("800", 900), ("40", 140), ("39", 139))},
                [ZScore(5, 12, min_delta=40)])
    assert {k for k, r in floor.items() if r} == {"800", "40"}
    up = run(spark, {"down": series([183, 182, 184] * 4 + [183, 17.31]), "up": series([183, 182, 184] * 4 + [183, 900])}, [ZScore(3, 12)])
    assert up["down"] is None and up["up"] is not None


def test_threshold(spark):
    def tens(*values):
        return [(10 * i, v) for i, v in enumerate(values)]

    got = run(spark, {
        "fine": tens(30, 29, 31, 28), "dip": tens(30, 8, 29, 31), "short": tens(30, 28, 10, 9, 8, 8, 7),
        "long": tens(30, 28, 10, 9, 8, 8, 7, 7), "broken": tens(10, 9, 8, 7, 30, 9), "recovered": tens(8, 8, 8, 8, 8, 40),
    }, [Threshold(12, False, s(45))], stream="video")
    assert {k for k, r in got.items() if r} == {"long"}
    assert got["long"].detail == "7 u — below 12 for 50s across 6 samples" and got["long"].title == "SLA breach"
    above = run(spark, {"air": tens(*[182] * 9)}, [Threshold(150, True, s(60))], stream="sensors")
    assert "above 150" in above["air"].detail and above["air"].title == "Threshold exceeded"


def test_stall(spark):
    def stalls(as_of):
        rows = [event("a", "video", "k", 0, 7), event("b", "video", "fin", 0, status="done"), event("p", "payments", "quiet", 0)]
        return detect(events(spark, rows), default_profiles(), as_of_us(as_of)).alerts.collect()

    def as_of_us(t):
        from tests.util import us

        return us(t)

    assert stalls(10) == []
    (r,) = stalls(94)
    assert (r.rule, r.key, r.title, r.absence, r.event_ids) == ("stall", "k", "Job stalled", True, ["a"])
    assert r.detail == "no events for 1m30s (expected within 1m30s)"
    # However long it stays silent, it is reported once.
    assert len(stalls(40 * 30)) == 1


def test_ids_are_deterministic(spark):
    rows = [event(f"e{i:02d}", "payments", "c", i) for i in range(25)]
    got = [r.id for r in detect(events(spark, rows), default_profiles()).alerts.collect()]
    assert len(got) == 1 and len(got[0]) == 32
    again = [r.id for r in detect(events(spark, rows[::-1]), default_profiles()).alerts.collect()]
    assert got == again


def test_cooldown_fixture(spark):
    """21 payments in 21 s alert once; six more do not; two minutes on, 21 more do."""
    first = [event(f"a{i:02d}", "payments", "c", i) for i in range(27)]
    later = [event(f"b{i:02d}", "payments", "c", 150 + i) for i in range(21)]
    got = detect(events(spark, first + later), default_profiles()).alerts.orderBy("at").collect()
    assert [r.event_ids[-1] for r in got] == ["a20", "b20"]


def test_a_fourth_stream_is_a_profile(spark):
    rows = [event(f"e{i}", "doors", "d", i) for i in range(4)]
    d = detect(events(spark, rows), [Profile("doors", rules=(Velocity(2, s(60)),), **WIDE)])
    assert d.invalid.count() == 0
    assert {r.title for r in d.alerts.collect()} == {"velocity"}


def test_rule_of_other_streams_is_skipped(spark):
    rows = [event(f"e{i}", "payments", "d", i) for i in range(4)]
    p = Profile("payments", rules=(Velocity(2, s(60), on=("video",)), Stall(s(1), ("video",))), **WIDE)
    assert detect(events(spark, rows), [p]).alerts.count() == 0


def test_redelivered_event_is_not_its_own_predecessor(spark):
    rows = [event("a", "payments", "c", 0, geo=SP), event("b", "payments", "c", 41, geo=TOKYO), event("b", "payments", "c", 41, geo=TOKYO)]
    found = detect(events(spark, rows), [Profile("payments", rules=(GeoVelocity(1000, 100),), **WIDE)]).candidates.collect()
    assert [r.event_ids for r in found] == [["a", "b"], ["a", "b"]]
