"""The five detection rules as expressions over a frame.

A rule is a function of one frame row: whether it fires, the two numbers its severity
compares, a few facts, and the ids behind it. Rules know no clock and no other row; the
statistics of the window, ``last_ids`` and ``prev`` (see ``operators.frames``) carry the history they may see.
Titles, sentences and evidence are written afterwards, for the rows that fired.

A profile may have several rules of one kind, such as a low and a high bound. They are told apart by their number among
those (``which``), are judged in the profile's order and, having one name, share a cooldown.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.cases import per_stream, title_for
from tidemark.profiles import GeoVelocity, Profile, Rule, Stall, Threshold, Velocity, ZScore, micros
from tidemark.schema import GEO

# How many event ids an alert carries.
VELOCITY_IDS, ZSCORE_IDS, THRESHOLD_IDS = 12, 8, 12


@dataclass(frozen=True)
class Finding:
    """What a rule says about a frame. ``n``, ``span_us``, ``a``, ``b``, ``c`` and the two
    places are facts for the text; a rule of your own gives ``detail`` and ``evidence`` (JSON) itself."""

    name: str
    fires: Column
    observed: Column
    limit: Column
    event_ids: Column
    n: Column | None = None
    span_us: Column | None = None
    a: Column | None = None
    b: Column | None = None
    c: Column | None = None
    from_geo: Column | None = None
    to_geo: Column | None = None
    detail: Column | None = None
    evidence: Column | None = None
    absence: bool = False

    def hit(self, which: int = 0, place: Column | None = None) -> Column:
        def fact(c: Column | None, name: str, kind) -> Column:
            return (F.lit(None) if c is None else c).cast(kind).alias(name)

        return F.when(
            self.fires & (F.lit(True) if self.absence else F.col("own")),
            F.struct(
                F.lit(self.name).alias("rule"),
                F.lit(which).alias("which"),
                (F.lit(0) if place is None else place.cast("int")).alias("place"),
                F.lit(self.absence).alias("absence"),
                fact(self.observed, "observed", "double"),
                fact(self.limit, "limit", "double"),
                fact(self.n, "n", "long"),
                fact(self.span_us, "span_us", "long"),
                fact(self.a, "a", "double"),
                fact(self.b, "b", "double"),
                fact(self.c, "c", "double"),
                fact(self.from_geo, "from_geo", GEO),
                fact(self.to_geo, "to_geo", GEO),
                fact(self.detail, "detail", "string"),
                fact(self.evidence, "evidence", "string"),
                fact(self.event_ids, "event_ids", "array<string>"),
            ),
        )


class _Of:
    """Parameters of one kind of rule, the profile's first or a further one, by the stream of the row; null where it is not set."""

    def __init__(self, profiles: Mapping[str, Profile], kind: type, which: int = 0):
        self.profiles = {n: p for n, p in profiles.items() if len(p.just(kind)) > which}
        self.kind, self.which = kind, which

    def __bool__(self) -> bool:
        return bool(self.profiles)

    def here(self) -> Column:
        return F.col("stream").isin(*self.profiles)

    def get(self, value: Callable[[Rule], object]) -> Column:
        return per_stream(self.profiles, lambda p: value(p.just(self.kind)[self.which]), only_these=True)

    def place(self) -> Column:
        """The rule's place in its profile."""
        at = lambda p: [i for i, r in enumerate(p.active()) if type(r) is self.kind][self.which]
        return per_stream(self.profiles, at, only_these=True)

    def column(self, name: str) -> str:
        """A name for a helper column of this rule."""
        return f"{name}_{self.which}"


def _ids(limit: int, of: Column | None = None) -> Column:
    """The newest ids, ``limit`` at most, of the window or of its newest ``of`` points."""
    n = F.least(F.size("last_ids"), F.lit(limit), *([] if of is None else [of]))
    return F.slice("last_ids", F.size("last_ids") - n + 1, n)


def velocity_rate(count: Column, span_us: Column) -> Column:
    """Events per second, two decimals; zero when no time passed."""
    rate = S.round_to(F.try_divide(count.cast("double"), span_us / 1e6), 2)
    return F.when(span_us > 0, rate).otherwise(0.0)


def _velocity(frames: DataFrame, of: _Of) -> tuple[DataFrame, Finding]:
    count, span = F.col("points"), of.column("v_span")
    over = of.here() & (count > of.get(lambda r: r.max))
    frames = frames.withColumn(span, F.when(over, F.col("newest_us") - F.col("oldest_us")))
    allowed = of.get(lambda r: r.max / (micros(r.per) / 1e6) if micros(r.per) > 0 else 0.0)
    rate = velocity_rate(count, F.col(span))
    return frames, Finding(
        "velocity", F.col(span).isNotNull(), rate, allowed, _ids(VELOCITY_IDS),
        n=count, span_us=F.col(span),
    )


def _geovelocity(frames: DataFrame, of: _Of) -> tuple[DataFrame, Finding]:
    geo, prev = F.col("geo"), F.col("prev")
    km = S.haversine_km(prev["geo"]["lat"], prev["geo"]["lon"], geo["lat"], geo["lon"])
    took_us = F.col("at_us") - prev["at_us"]
    both = of.here() & geo.isNotNull() & prev["geo"].isNotNull()
    g_km, g_kmh = of.column("g_km"), of.column("g_kmh")
    frames = frames.withColumn(g_km, F.when(both, km))
    # Two places at one instant is an infinite speed, not a division error.
    kmh = F.coalesce(F.try_divide(F.col(g_km), took_us / 3.6e9), F.lit(float("inf")))
    frames = frames.withColumn(g_kmh, F.when(F.col(g_km).isNotNull(), kmh))
    limit = of.get(lambda r: float(r.max_kmh))
    fires = (F.col(g_km) >= of.get(lambda r: float(r.min_km))) & (F.col(g_kmh) > limit)
    return frames, Finding(
        "geovelocity", fires, F.col(g_kmh), limit, F.array(prev["id"], F.col("id")),
        span_us=took_us, a=F.col(g_km), from_geo=prev["geo"], to_geo=geo,
    )


def _zscore(frames: DataFrame, of: _Of) -> tuple[DataFrame, Finding]:
    """The value against the points before the newest, only where there are points enough."""
    n = of.column("z_n")
    enough = of.here() & F.col("own") & (F.col("base_n") >= of.get(lambda r: max(r.min_samples, 1)))
    frames = frames.withColumn(n, F.when(enough, F.col("base_n")))
    value, mean, sd = F.col("value"), F.col("base_mean"), F.col("base_sd")
    delta = F.abs(value - mean)
    z = F.try_divide(delta, sd)
    fires = (
        F.col(n).isNotNull()
        & (sd > 0)
        & (of.get(lambda r: bool(r.below)) | (value >= mean))
        & (delta >= of.get(lambda r: float(r.min_delta)))
        & (z > of.get(lambda r: float(r.k)))
    )
    return frames, Finding(
        "zscore", fires, z, of.get(lambda r: float(r.k)), _ids(ZSCORE_IDS),
        n=F.col(n), a=mean, b=sd, c=delta,
    )


def _threshold(frames: DataFrame, of: _Of) -> tuple[DataFrame, Finding]:
    """The newest point and the points beyond the bound that lead up to it. The newest
    itself is not tested; for in-order data it is the event, which is."""
    bound, value, held = of.get(lambda r: float(r.bound)), F.col("value"), of.column("t_held")
    beyond = F.when(of.get(lambda r: bool(r.above)), value > bound).otherwise(value < bound)
    run = F.get("runs", F.lit(of.which))
    frames = frames.withColumn(held, F.when(of.here() & F.col("own") & beyond & (F.col("points") > 0), F.col("newest_us") - run["from_us"]))
    need, samples = of.get(lambda r: micros(r.sustained)), run["n"]
    return frames, Finding(
        "threshold", F.col(held) >= need, F.col(held) / 1e6, need / 1e6,
        _ids(THRESHOLD_IDS, samples), n=samples, span_us=F.col(held),
    )


def _stall(frames: DataFrame, of: _Of) -> tuple[DataFrame, Finding]:
    idle = F.col("stall_us") - F.col("at_us")
    fires = of.here() & F.col("stalled")
    return frames, Finding(
        "stall", fires, idle / 1e6, of.get(lambda r: micros(r.after)) / 1e6, F.array("id"),
        span_us=idle, absence=True,
    )


# Evaluators by kind of rule: (frames, parameters) -> (frames with helper columns, finding).
# A rule of your own is a dataclass with ``name`` and ``on``, and an entry here. One that looks for silence extends ``Stall``: frames are
# ``stalled`` where its ``after`` has passed, on every host, and its finding has ``absence``.
EVALUATORS: dict[type, Callable[[DataFrame, _Of], tuple[DataFrame, Finding]]] = {
    Velocity: _velocity,
    GeoVelocity: _geovelocity,
    ZScore: _zscore,
    Threshold: _threshold,
    Stall: _stall,
}


def _numbered(profiles: Mapping[str, Profile], kind: type) -> list[_Of]:
    """The first rule of a kind in each profile, then the second, and so on."""
    return [_Of(profiles, kind, k) for k in range(max((len(p.just(kind)) for p in profiles.values()), default=0))]


def _text(found: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Write ``detail`` and ``evidence`` of the hits."""
    rule = F.col("rule")

    def param(name: str, kind: str, getters: dict[type, Callable[[Rule], object]]) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast(kind))
        for k, get in getters.items():
            for of in _numbered(profiles, k):
                out = out.when((rule == k.__name__.lower()) & (F.col("which") == of.which), of.get(get).cast(kind))
        return out.alias(name)

    found = found.select(
        "*",
        param("p_int", "int", {Velocity: lambda r: r.max}),
        param("p_us", "long", {Velocity: lambda r: micros(r.per), Stall: lambda r: micros(r.after),
                               Threshold: lambda r: micros(r.sustained)}),
        param("p_x", "double", {Threshold: lambda r: float(r.bound), ZScore: lambda r: float(r.min_delta)}),
        param("p_above", "boolean", {Threshold: lambda r: bool(r.above)}),
        F.when(rule == "geovelocity", S.place_of("from_geo")).alias("from_place"),
        F.when(rule == "geovelocity", S.place_of("to_geo")).alias("to_place"),
        F.when(rule.isin("zscore", "threshold"), S.compact_float("value")).alias("value_text"),
        F.when(rule.isin("geovelocity", "zscore"), S.compact_float("a")).alias("a_text"),
        F.when(rule == "geovelocity", S.compact_float("observed"))
        .when(rule == "zscore", S.fixed("observed", 1)).alias("observed_text"),
        S.compact_duration("span_us").alias("span_text"),
        F.coalesce("unit", F.lit("")).alias("unit_text"),
    )
    found = found.select(
        "*", S.compact_duration("p_us").alias("p_us_text"),
        F.when(rule == "threshold", S.compact_float("p_x")).alias("p_x_text"),
    )
    n, span_ms, param_ms = F.col("n"), S.millis(F.col("span_us")), S.millis(F.col("p_us"))
    observed, limit, a, b, c = (F.col(x) for x in ("observed", "limit", "a", "b", "c"))
    side = F.when(rule == "threshold", F.when(F.col("p_above"), "above").otherwise("below")).otherwise(
        F.when(F.col("value") < a, "below").otherwise("above")
    )

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p[1:]) if p.startswith("=") else F.col(p) for p in parts])

    found = found.withColumn("side", side)
    detail = (
        F.when(rule == "velocity", say("n", "= events in ", "span_text", "= (limit ", "p_int", "= per ", "p_us_text", "=)"))
        .when(rule == "geovelocity", say("from_place", "= → ", "to_place", "= · ", "a_text", "= km in ", "span_text",
                                         "= · ", "observed_text", "= km/h"))
        .when(rule == "zscore", say("value_text", "= ", "unit_text", "= is ", "observed_text", "=σ ", "side",
                                    "= this key's mean of ", "a_text", "= (n=", "n", "=)"))
        .when(rule == "stall", say("=no events for ", "span_text", "= (expected within ", "p_us_text", "=)"))
        .when(rule == "threshold", say("value_text", "= ", "unit_text", "= — ", "side", "= ", "p_x_text", "= for ",
                                       "span_text", "= across ", "n", "= samples"))
    )
    evidence = (
        F.when(rule == "velocity", F.to_json(F.struct(
            n.alias("count"), F.col("p_int").alias("limit"), span_ms.alias("spanMs"), param_ms.alias("windowMs"),
            observed.alias("perSecond"), S.round_to(limit, 2).alias("allowedPerSecond"))))
        .when(rule == "geovelocity", F.to_json(F.struct(
            F.col("from_place").alias("fromPlace"), F.col("to_place").alias("toPlace"),
            S.round_to(a, 1).alias("distanceKm"), (F.col("span_us") / 1e6).alias("seconds"),
            F.col("observed_text").alias("impliedKmh"), limit.alias("limitKmh"))))
        .when(rule == "zscore", F.to_json(F.struct(
            F.col("value").alias("value"), S.round_to(a, 2).alias("mean"), S.round_to(b, 2).alias("stddev"),
            S.round_to(observed, 2).alias("z"), limit.alias("k"), S.round_to(c, 2).alias("delta"),
            F.col("p_x").alias("minDelta"), n.alias("samples"))))
        .when(rule == "stall", F.to_json(F.struct(
            span_ms.alias("idleMs"), param_ms.alias("thresholdMs"), F.col("value").alias("lastValue"))))
        .when(rule == "threshold", F.to_json(F.struct(
            F.col("value").alias("value"), F.col("p_x").alias("bound"), F.col("p_above").alias("above"),
            span_ms.alias("heldMs"), param_ms.alias("sustainedMs"), n.alias("samples"))))
    )
    return found.withColumn("detail", F.coalesce("detail", detail)).withColumn("evidence", F.coalesce("evidence", evidence))


def hits(frames: DataFrame, profiles: Mapping[str, Profile], carry: Sequence[str] = ()) -> DataFrame:
    """One row of facts per rule that fires on a frame, before any cooldown.

    Also one row with an empty ``rule`` per terminal event: it ends the cooldowns of its
    key. A frame's own clock (the time of detection) is ``clock_us`` where the host
    provides it, the event time otherwise. Columns in ``carry`` are kept as they are.
    """
    if "clock_us" not in frames.columns:
        frames = frames.withColumn("clock_us", F.col("at_us"))
    found = []
    for kind in {type(r): None for p in profiles.values() for r in p.active()}:
        for of in _numbered({n: p for n, p in profiles.items() if not issubclass(kind, Stall) or p.stall}, kind):
            evaluate = next(EVALUATORS[k] for k in kind.__mro__ if k in EVALUATORS)
            frames, finding = evaluate(frames, of)
            found.append(finding.hit(of.which, of.place()))
    nothing = F.lit(None)
    found.append(Finding("", F.col("terminal"), nothing, nothing, nothing).hit())
    made = frames.select(
        "stream", "key", F.col("id").alias("event_id"), "at", "at_us", "value", "unit",
        "seq", "clock_us", "stall_us", *carry,
        F.explode(F.array_compact(F.array(*found))).alias("hit"),
    ).select("*", "hit.*").drop("hit")
    severity = S.severity(F.col("observed"), F.col("limit"))
    detected = F.when(F.col("absence"), F.col("stall_us")).otherwise(F.col("clock_us"))
    return made.withColumn("clock_us", detected).drop("stall_us").select(
        "*", severity.alias("severity"), S.severity_rank(severity).alias("rank")
    )


def write_up(found: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Title, sentence and evidence of hits; markers of terminal events are left out."""
    written = _text(found.filter("rule != ''"), profiles)
    return written.select(
        "stream", "key", "rule", "severity", title_for(F.col("stream"), F.col("rule")).alias("title"),
        "detail", "evidence", "event_ids", "absence", "event_id", "which", "at", "at_us", "seq", "clock_us",
        F.timestamp_micros("clock_us").alias("detected_at"), "rank",
    )


def candidates(frames: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Everything the rules found, written up, before the cooldown."""
    return write_up(hits(frames, profiles), profiles)
