"""The window of one key under out-of-order arrival.

Lateness needs the key's mark, the mark restarts with the key, and the key restarts at
*accepted* terminal events and at reported silences: each step depends on the one before.
This small bounded state is therefore stepped event by event, inside Spark tasks, by the
batch replay and by the streaming detector. It keeps at most ``cap`` points. What the
rules make of a window is left to the native expressions in ``operators.rules``.
"""

from __future__ import annotations

from bisect import bisect_right
import math
from dataclasses import dataclass, field
from functools import reduce
from operator import add
from typing import NamedTuple

from tidemark.profiles import Profile, Threshold, ZScore, micros


class Geometry(NamedTuple):
    size: int
    grace: int
    cap: int
    cooldown: int
    after: int | None  # silence that counts as a stall
    samples: int | None = None  # the fewest earlier values that a rule compares with; None if none does
    k: float = 0.0  # the fewest deviations that such a rule asks for
    bounds: tuple[tuple[float, bool], ...] = ()  # that runs are counted past, and on which side

    @classmethod
    def of(cls, p: Profile) -> Geometry:
        after = micros(p.stall.after) if p.stall else None
        samples = min((max(r.min_samples, 1) for r in p.find(ZScore)), default=None)
        bounds = tuple((float(r.bound), bool(r.above)) for r in p.find(Threshold))
        k = min((float(r.k) for r in p.find(ZScore)), default=0.0)
        return cls(micros(p.window), micros(p.grace), p.cap, micros(p.cooldown), after, samples, k, bounds)


class Point(NamedTuple):
    at: int
    id: str
    value: float
    geo: tuple | None


class Frame(NamedTuple):
    """What a step emits: a judged event, a late one, or a silence."""

    kind: str  # event, late, stall
    point: Point
    clock: int
    window: list[Point]
    prev: Point | None
    terminal: bool = False


def base_of(g: Geometry, window: list[Point]) -> tuple[int, float | None, float | None]:
    """Number, mean and deviation of the points before the newest, where a rule asks for that many."""
    n = max(len(window) - 1, 0)
    if g.samples is None or n < g.samples:
        return n, None, None
    # Added up in order, as the batch plan does; what lies just at a limit must not depend on the host.
    mean = reduce(add, (p.value for p in window[:-1]), 0.0) / n
    return n, mean, math.sqrt(reduce(add, ((p.value - mean) * (p.value - mean) for p in window[:-1]), 0.0) / n)


def runs_of(g: Geometry, window: list[Point]) -> list[tuple[int, int]]:
    """For each bound (start, points) of the run up to the newest point, which is not tested itself."""
    out = []
    for bound, above in g.bounds if window else ():
        i = len(window) - 1
        while i and (window[i - 1].value > bound if above else window[i - 1].value < bound):
            i -= 1
        out.append((window[i].at, len(window) - i))
    return out


@dataclass
class KeyedWindow:
    points: list[Point] = field(default_factory=list)
    mark: int | None = None
    clock: int | None = None
    late: int = 0
    # Cooldown of the stall rule: it decides whether the key is forgotten.
    stall_until: int = 0
    stall_rank: int = 0

    def window(self, g: Geometry) -> list[Point]:
        start = self.mark - g.size if self.mark is not None else 0
        return [p for p in self.points if p.at >= start]

    def step(self, g: Geometry, point: Point, terminal: bool, now: int | None) -> list[Frame]:
        """File one event. ``now`` is the time of detection; by default the newest event
        time this key has seen."""
        if now is None:
            now = point.at
        self.clock = now if self.clock is None else max(self.clock, now)
        out = self.sweep_until(g, self.clock)
        self.mark = point.at if self.mark is None else max(self.mark, point.at)
        oldest = self.mark - g.size - g.grace
        if point.at < oldest:
            self.late += 1
            return [*out, Frame("late", point, self.clock, [], None)]
        spot = bisect_right(self.points, point.at, key=lambda p: p.at)
        self.points.insert(spot, point)
        self.points = [p for p in self.points if p.at >= oldest][-g.cap:]
        prev = next((p for p in reversed(self.points) if p.at <= point.at and p.id != point.id), None)
        out.append(Frame("event", point, self.clock, self.window(g), prev, terminal))
        if terminal:
            self.forget()
            self.stall_until, self.stall_rank = 0, 0
        return out

    def forget(self) -> None:
        self.points, self.mark = [], None

    def next_sweep(self, g: Geometry) -> int | None:
        """When a sweep would first report this key as silent."""
        if g.after is None or not self.points:
            return None
        last = self.points[-1].at
        # While cooling down, a longer silence still passes once it grades higher.
        grades = ((last + g.after, 1), (last + -(-g.after * 5 // 4), 2), (last + 2 * g.after, 3))
        worse = [t for t, rank in grades if rank > self.stall_rank]
        return min([max(last + g.after, self.stall_until), *worse])

    def sweep(self, g: Geometry, now: int) -> Frame | None:
        """Look for silence at ``now``. A reported key is forgotten; a suppressed one is not."""
        if g.after is None or not self.points:
            return None
        last = self.points[-1]
        idle = now - last.at
        if idle < g.after:
            return None
        rank = 3 if idle >= 2 * g.after else 2 if idle * 4 >= g.after * 5 else 1
        if now < self.stall_until and rank <= self.stall_rank:
            return None
        self.stall_until, self.stall_rank = now + g.cooldown, rank
        self.forget()
        return Frame("stall", last, now, [], None)

    def sweep_until(self, g: Geometry, now: int) -> list[Frame]:
        """Sweep at the moment silence becomes reportable, if ``now`` has reached it."""
        due = self.next_sweep(g)
        found = self.sweep(g, due) if due is not None and due <= now else None
        return [found] if found else []
