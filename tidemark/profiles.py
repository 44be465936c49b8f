"""Rule parameters and per-stream window geometry.

A profile is configuration: a new stream needs a new ``Profile`` and no code.
Durations are ``datetime.timedelta``; inside plans they become microseconds.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import timedelta

PAYMENTS, VIDEO, SENSORS = "payments", "video", "sensors"
STREAMS = (PAYMENTS, VIDEO, SENSORS)


def micros(d: timedelta) -> int:
    return d // timedelta(microseconds=1)


@dataclass(frozen=True)
class Velocity:
    """More than ``max`` observations inside the window."""

    max: int
    per: timedelta
    on: tuple[str, ...] = ()
    name: str = field(default="velocity", init=False)


@dataclass(frozen=True)
class GeoVelocity:
    """Two consecutive observations further apart than ``max_kmh`` allows."""

    max_kmh: float
    min_km: float
    on: tuple[str, ...] = ()
    name: str = field(default="geovelocity", init=False)


@dataclass(frozen=True)
class ZScore:
    """A value more than ``k`` deviations off the key's own recent history."""

    k: float
    min_samples: int
    min_delta: float = 0.0
    below: bool = False
    on: tuple[str, ...] = ()
    name: str = field(default="zscore", init=False)


@dataclass(frozen=True)
class Stall:
    """No observation for ``after``."""

    after: timedelta
    on: tuple[str, ...] = ()
    name: str = field(default="stall", init=False)


@dataclass(frozen=True)
class Threshold:
    """Every value past ``bound`` for at least ``sustained``."""

    bound: float
    above: bool
    sustained: timedelta
    on: tuple[str, ...] = ()
    name: str = field(default="threshold", init=False)


Rule = Velocity | GeoVelocity | ZScore | Stall | Threshold


def applies(rule: Rule, stream: str) -> bool:
    """An empty stream set means every stream."""
    return not rule.on or stream in rule.on


@dataclass(frozen=True)
class Profile:
    stream: str
    window: timedelta
    grace: timedelta
    max_points: int
    cooldown: timedelta
    rules: tuple[Rule, ...]
    # Absence is looked for only when this is positive.
    sweep_every: timedelta = timedelta(0)

    @property
    def cap(self) -> int:
        """Observations kept per key; a predecessor needs at least two."""
        return max(self.max_points, 2)

    @property
    def retention(self) -> timedelta:
        return self.window + self.grace

    def active(self) -> list[Rule]:
        return [r for r in self.rules if applies(r, self.stream)]

    def find(self, kind: type) -> list[Rule]:
        return [r for r in self.active() if isinstance(r, kind)]

    def just(self, kind: type) -> list[Rule]:
        """Rules of this kind and not of one that extends it."""
        return [r for r in self.active() if type(r) is kind]

    @property
    def stall(self) -> Stall | None:
        """The absence rule, if this stream is swept for it."""
        found = self.find(Stall)
        if self.sweep_every <= timedelta(0) or not found:
            return None
        if len(found) > 1:
            raise ValueError(f"profile {self.stream!r} has more than one stall rule")
        return found[0]


def by_stream(profiles: Iterable[Profile]) -> dict[str, Profile]:
    out: dict[str, Profile] = {}
    for p in profiles:
        if p.stream in out:
            raise ValueError(f"two profiles for stream {p.stream!r}")
        p.stall  # at most one
        out[p.stream] = p
    return out


# The phrase shown for a rule on a stream; the rule name otherwise.
TITLES = {
    PAYMENTS: {
        "velocity": "Card testing",
        "geovelocity": "Impossible travel",
        "zscore": "Amount anomaly",
    },
    VIDEO: {
        "velocity": "Retry storm",
        "stall": "Job stalled",
        "threshold": "SLA breach",
    },
    SENSORS: {
        "velocity": "Sensor flapping",
        "geovelocity": "Impossible relocation",
        "zscore": "Reading spike",
        "stall": "Sensor offline",
        "threshold": "Threshold exceeded",
    },
}


def default_profiles() -> tuple[Profile, ...]:
    """The stock tuning of the three built-in streams."""
    s, m = lambda n: timedelta(seconds=n), lambda n: timedelta(minutes=n)
    return (
        Profile(
            PAYMENTS, window=s(60), grace=s(5), max_points=256, cooldown=s(30),
            rules=(
                Velocity(20, m(1), (PAYMENTS,)),
                GeoVelocity(1000, 100, (PAYMENTS,)),
                ZScore(3.5, 12, min_delta=200, below=True, on=(PAYMENTS,)),
            ),
        ),
        Profile(
            VIDEO, window=m(5), grace=s(10), max_points=256, cooldown=m(1), sweep_every=s(15),
            rules=(
                Velocity(20, m(5), (VIDEO,)),
                Stall(s(90), (VIDEO,)),
                Threshold(12, above=False, sustained=s(45), on=(VIDEO,)),
            ),
        ),
        Profile(
            SENSORS, window=m(3), grace=s(15), max_points=256, cooldown=m(2), sweep_every=s(30),
            rules=(
                Threshold(150, above=True, sustained=m(1), on=(SENSORS,)),
                ZScore(5, 15, min_delta=40, on=(SENSORS,)),
                Velocity(60, m(3), (SENSORS,)),
                Stall(m(2), (SENSORS,)),
            ),
        ),
    )
