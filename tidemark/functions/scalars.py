"""Scalar expressions. Everything here is a native ``Column`` expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0  # fixed value


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def severity(observed: Column, threshold: Column) -> Column:
    """How far past its threshold an observation is; no threshold is critical."""
    return (
        F.when((threshold <= 0) | (observed >= threshold * 2), F.lit("critical"))
        .when(observed >= threshold * 1.25, F.lit("warn"))
        .otherwise(F.lit("info"))
    )


def severity_rank(sev: Column) -> Column:
    return F.when(sev == "critical", 3).when(sev == "warn", 2).otherwise(1)


def round_to(v: Column, digits: int) -> Column:
    """Scale, round half away from zero, scale back."""
    return F.round(v * float(10**digits)) / float(10**digits)


def round2_up(v: Column) -> Column:
    """Two decimals with halves going up, as the window metrics round."""
    return F.floor(v * 100.0 + 0.5) / F.lit(100.0)


def round1_trunc(v: Column) -> Column:
    """One decimal as the rate display rounds: add a half, cut towards zero."""
    return (v * 10.0 + 0.5).cast("long") / F.lit(10.0)


# Display texts. They use their number many times over, so they are written as SQL, take a
# SQL expression, and bind its value once: ``transform(array(v), x -> ...)[0]``.


def _let(value: str, body: str, name: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def fixed_sql(value: str, digits: int) -> str:
    """Text with ``digits`` decimals, rounding the exact binary value, halves to even.

    ``p`` counts half units. If it comes out odd, the value is at a half or next to one:
    what the product rounded off (by a Veltkamp split, exact) tells which.
    """
    halves, unit = 2 * 10**digits, 10**digits
    rest = f"(f.h * {halves}D - f.p) + (f.s - f.h) * {halves}D"
    up = f"if(f.p % 2 = 1, {rest} > 0 OR ({rest} = 0 AND floor(f.p / 2) % 2 = 1), f.p / 2 - floor(f.p / 2) >= 0.5D)"
    text = f"format_string('%.{digits}f', if(f.neg, -1D, 1D) * (floor(f.p / 2) + if({up}, 1, 0)) / {unit}D)"
    parts = (
        f"named_struct('neg', w < 0, 's', abs(w), 'p', abs(w) * {halves}D, "
        "'h', abs(w) * 134217729D - (abs(w) * 134217729D - abs(w)))"
    )
    return _let(f"CAST({value} AS DOUBLE)", _let(parts, text, "f"), "w")


def fixed(value: str, digits: int) -> Column:
    return F.expr(fixed_sql(value, digits))


def _trim(text: str) -> str:
    """Drop trailing zeros after a decimal point, and the point if nothing is left."""
    return f"regexp_replace(regexp_replace({text}, '([.][0-9]*?)0+$', '$1'), '[.]$', '')"


def compact_float(value: str) -> Column:
    """A number short enough for one line: 1.6M, 18.5K, 182, 89.9."""
    return F.expr(_let(
        f"CAST({value} AS DOUBLE)",
        f"""CASE WHEN isnan(x) THEN '—' WHEN abs(x) = double('Infinity') THEN '∞'
        WHEN abs(x) >= 1000000 THEN concat({_trim(fixed_sql('x / 1000000D', 1))}, 'M')
        WHEN abs(x) >= 1000 THEN concat({_trim(fixed_sql('x / 1000D', 1))}, 'K')
        WHEN abs(x) >= 100 THEN {fixed_sql('x', 0)} ELSE {_trim(fixed_sql('x', 2))} END""",
        "x",
    ))


def compact_duration(us: str) -> Column:
    """Microseconds as 420ms, 1.5s, 1m34s or 3h00m."""
    return F.expr(_let(
        f"CAST({us} AS BIGINT)",
        f"""CASE WHEN x < 1000000 THEN concat(x div 1000, 'ms')
        WHEN x < 60000000 THEN concat({_trim(fixed_sql('x / 1000000D', 1))}, 's')
        WHEN x < 3600000000 THEN format_string('%dm%02ds', x div 60000000, x div 1000000 % 60)
        ELSE format_string('%dh%02dm', x div 3600000000, x div 60000000 % 60) END""",
        "x",
    ))


def place_of(geo: str) -> Column:
    """Place name, else coordinates, else a question mark."""
    lat, lon = fixed_sql(f"{geo}.lat", 2), fixed_sql(f"{geo}.lon", 2)
    return F.expr(
        f"CASE WHEN {geo} IS NULL THEN '?' WHEN {geo}.place <> '' THEN {geo}.place ELSE concat({lat}, ',', {lon}) END"
    )


def label(labels: Column, name: str) -> Column:
    """Map lookup where a missing label, or no labels at all, is the empty text."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


# The status labels that end an entity's life.
TERMINAL_STATUSES = ("done", "failed", "cancelled")


def is_terminal(labels: Column) -> Column:
    return label(labels, "status").isin(*TERMINAL_STATUSES)


def millis(us: Column) -> Column:
    """Whole milliseconds, cut towards zero."""
    return (us / 1000).cast("long")


def alert_id(rule: Column, stream: Column, key: Column, event_id: Column) -> Column:
    """The same detection always gets the same id, so a replay cannot store it twice."""
    parts = F.to_json(F.array(rule, stream, key, event_id))
    return F.substring(F.sha2(parts, 256), 1, 32)


def state_key(stream: Column, key: Column) -> Column:
    return F.concat(stream, F.lit("/"), key)


def parse_state_key(text: Column) -> Column:
    """Split at the first slash only; text without a slash gives null."""
    cut = F.instr(text, "/")
    return F.when(
        cut > 0,
        F.struct(
            F.substring_index(text, "/", 1).alias("stream"),
            F.substring(text, cut + 1, F.length(text)).alias("id"),
        ),
    )


RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_rfc3339(text: Column) -> Column:
    """Instant of an RFC 3339 text (cut to microseconds), null when it is not one."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(text)))


def event_time(at_text: Column, record_time: Column) -> Column:
    """The event's own time, else the record's, at millisecond precision."""
    return F.date_trunc("millisecond", F.coalesce(parse_rfc3339(at_text), record_time))
