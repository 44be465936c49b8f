"""A plain, one-event-at-a-time model of detection: what the Spark jobs must agree with.

Times are integer microseconds. Only tests use it.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, field

from tidemark.profiles import GeoVelocity, Stall, Threshold, Velocity, ZScore, micros

RANK = {"info": 1, "warn": 2, "critical": 3}


def grade(seen, limit):
    if limit <= 0 or seen >= 2 * limit:
        return "critical"
    return "warn" if seen >= 1.25 * limit else "info"


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1, h)))


@dataclass
class Key:
    points: list = field(default_factory=list)  # (at, id, value, geo)
    mark: int | None = None


@dataclass
class Model:
    profiles: dict
    keys: dict = field(default_factory=dict)
    cooling: dict = field(default_factory=dict)
    clock: dict = field(default_factory=dict)
    alerts: list = field(default_factory=list)  # (rule, stream, key, at, detected, severity, ids)
    found: list = field(default_factory=list)
    late: list = field(default_factory=list)

    def admit(self, p, rule, stream, key, at, now, sev, ids):
        self.found.append((rule, stream, key, at, now, sev, tuple(ids)))
        held = self.cooling.get((stream, key, rule))
        if held and now < held[0] and RANK[sev] <= held[1]:
            return False
        self.cooling[stream, key, rule] = (now + micros(p.cooldown), RANK[sev])
        self.alerts.append((rule, stream, key, at, now, sev, tuple(ids)))
        return True

    def silence(self, stream, key, now):
        """Report a stall at its deadline if ``now`` has reached it."""
        p = self.profiles[stream]
        k = self.keys.get((stream, key))
        if k is None or p.stall is None or not k.points:
            return
        last, after = k.points[-1], micros(p.stall.after)
        until = self.cooling.get((stream, key, "stall"), (0, 0))[0]
        for t in sorted({last[0] + after, last[0] + after * 5 // 4, last[0] + 2 * after, until}):
            if last[0] + after <= t <= now:
                if self.admit(p, "stall", stream, key, last[0], t, grade(t - last[0], after), [last[1]]):
                    del self.keys[stream, key]
                    return

    def event(self, stream, key, id, at, value, geo=None, terminal=False):
        p = self.profiles[stream]
        now = self.clock[stream, key] = max(self.clock.get((stream, key), at), at)
        self.silence(stream, key, now)
        k = self.keys.setdefault((stream, key), Key())
        k.mark = at if k.mark is None else max(k.mark, at)
        size = micros(p.window)
        if at < k.mark - size - micros(p.grace):
            self.late.append(id)
            return
        i = bisect.bisect_right([x[0] for x in k.points], at)
        k.points.insert(i, (at, id, value, geo))
        k.points = [x for x in k.points if x[0] >= k.mark - size - micros(p.grace)][-p.cap:]
        pts = [x for x in k.points if x[0] >= k.mark - size]
        for rule in p.active():
            hit = self.judge(rule, pts, k.points, id, at, value, geo)
            if hit:
                self.admit(p, rule.name, stream, key, at, now, grade(*hit[:2]), hit[2])
        if terminal:
            del self.keys[stream, key]
            for r in p.active():
                self.cooling.pop((stream, key, r.name), None)

    def judge(self, rule, pts, kept, id, at, value, geo):
        if isinstance(rule, Velocity):
            if len(pts) <= rule.max:
                return None
            span = (pts[-1][0] - pts[0][0]) / 1e6 if len(pts) > 1 else 0
            rate = math.floor(len(pts) / span * 100 + 0.5) / 100 if span > 0 else 0
            per = micros(rule.per) / 1e6
            return rate, rule.max / per if per else 0, [x[1] for x in pts[-12:]]
        if isinstance(rule, GeoVelocity):
            prev = next((x for x in reversed(kept) if x[0] <= at and x[1] != id), None)
            if not geo or not prev or not prev[3]:
                return None
            d, dt = km(prev[3], geo), (at - prev[0]) / 3.6e9
            kmh = d / dt if dt else math.inf
            return (kmh, rule.max_kmh, [prev[1], id]) if d >= rule.min_km and kmh > rule.max_kmh else None
        if isinstance(rule, ZScore):
            old = [x[2] for x in pts[:-1]]
            if len(old) < max(rule.min_samples, 2):
                return None
            mean = sum(old) / len(old)
            sd = math.sqrt(sum((v - mean) ** 2 for v in old) / len(old))
            if sd <= 0 or (not rule.below and value < mean) or abs(value - mean) < rule.min_delta:
                return None
            z = abs(value - mean) / sd
            return (z, rule.k, [x[1] for x in pts[-8:]]) if z > rule.k else None
        if isinstance(rule, Threshold):
            bad = (lambda v: v > rule.bound) if rule.above else (lambda v: v < rule.bound)
            if not bad(value) or not pts:
                return None
            i = len(pts) - 1
            while i and bad(pts[i - 1][2]):
                i -= 1
            held = (pts[-1][0] - pts[i][0]) / 1e6
            need = micros(rule.sustained) / 1e6
            return (held, need, [x[1] for x in pts[i:][-12:]]) if held >= need else None
        assert isinstance(rule, Stall)
        return None
