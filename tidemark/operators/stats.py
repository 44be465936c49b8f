"""Statistics over alerts and events: latency, rates, samples, summaries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import round1_trunc
from tidemark.operators.alert_table import latency_us, usable_latency_us
from tidemark.operators.frames import _us
from tidemark.operators.slices import Running, blockwise, carried, floor_div, resolved, running
from tidemark.operators.staging import stage
from tidemark.profiles import micros

SAMPLES, BUDGET = 2000, 15  # fixed values: latency samples kept; events shown per second
QUANTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}

DAY_US = 86_400_000_000


def classify_latency(alerts: DataFrame) -> DataFrame:
    """Add ``latency_class``: usable, absence or skewed."""
    kind = F.when(F.col("absence"), "absence").when(latency_us() < 0, "skewed").otherwise("usable")
    return alerts.withColumn("latency_class", kind)


def _pick(values: Column, q: float) -> Column:
    """Element floor(q * n) of ascending values, counting from zero."""
    n = F.size(values)
    index = F.least(F.floor(F.lit(float(q)) * n.cast("double")).cast("int"), n - 1)
    return F.when(n > 0, F.try_element_at(values, index + 1)).otherwise(0)


def latency_stats(
    alerts: DataFrame, until: Column | None = None, samples: int = SAMPLES
) -> DataFrame:
    """One row of latency figures in milliseconds; zeros when there is nothing.

    Percentiles are over the newest ``samples`` usable measurements, count and maximum
    over all of them. ``until`` ends the measured span; by default detection does.
    """
    span = usable_latency_us()
    if until is not None:
        span = F.when(span.isNotNull(), F.unix_micros(until) - F.unix_micros("at"))
    usable = alerts.select("detected_at", "id", span.alias("us")).filter("us IS NOT NULL")
    # Top-n: every task passes on its newest rows, no global sort.
    newest = usable.orderBy(F.desc("detected_at"), F.desc("id")).limit(max(samples, 1))
    kept = newest.agg(F.sort_array(F.collect_list("us")).alias("v")).select(
        F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("most"), "v"
    )
    overall = usable.agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("most")).select(
        "n", "most", F.lit(None).cast("array<bigint>").alias("v")
    )
    both = overall.unionByName(kept).agg(F.max("n").alias("n"), F.max("most").alias("most"), F.max("v").alias("v"))
    ms = lambda us: F.coalesce(us, F.lit(0)) / 1000.0
    return both.select(
        F.col("n").alias("count"),
        *[ms(_pick(F.col("v"), q)).alias(name) for name, q in QUANTILES.items()],
        ms(F.col("most")).alias("max_ms"),
        ms(F.try_element_at("v", F.lit(-1))).alias("retained_max_ms"),
    )


def rates(rows: DataFrame, at: str, every: timedelta = timedelta(seconds=1)) -> DataFrame:
    """Rows per second in each interval, and the total so far.

    Intervals without rows appear only where the rate drops to zero; it stays there
    until the next one.
    """
    width = micros(every)
    here = floor_div(F.unix_micros(at), width)
    counts = rows.groupBy(here.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    steps = F.explode(F.array(F.struct(F.col("i"), F.col("n")), F.struct((F.col("i") + 1).alias("i"), F.lit(0).cast("long").alias("n"))))
    filled = counts.select(steps.alias("s")).groupBy("s.i").agg(F.sum("s.n").alias("count"))
    days = [floor_div(F.col("i") * width, DAY_US)] if width < DAY_US else [F.col("i")]
    total = running(filled, [], ["i"], days, [Running("total", F.col("count"), "sum")])
    return total.select(
        F.timestamp_micros(F.col("i") * width).alias("interval_start"),
        "count",
        (F.col("count") / F.lit(width / 1e6)).alias("per_second"),
        "total",
    )


PARTS = 64  # blocks an interval


def sample_every(
    rows: DataFrame, at: str, id: str, every: timedelta = timedelta(seconds=1), budget: float = BUDGET
) -> DataFrame:
    """A systematic sample: each interval keeps every n-th row of the running count, with
    n chosen from the rate of the interval before so that about ``budget`` rows a second
    come through. Adds ``number`` (the running count) and ``every``.

    The running count is a scan in blocks, so no task sees more than a block; the rate of an
    interval is the sum of its blocks' counts. The rows are read once, and no column is named with a leading underscore.
    """
    width = micros(every)
    us = F.unix_micros(at)
    interval = floor_div(F.col("_us"), width)
    part = floor_div(F.pmod(F.col("_us"), F.lit(width)) * PARTS, width)
    count = Running("number", F.lit(1).cast("long"), "sum")
    blocks = [interval * PARTS + part, floor_div(interval, PARTS)]
    local, totals = blockwise(rows.withColumn("_us", us), [], ["_us", id], blocks, [count])
    per_second = F.sum("_t_number_0") / F.lit(width / 1e6)
    n = F.greatest(F.floor(per_second / F.lit(float(budget))), F.lit(1)).cast("long")
    tuned = totals.groupBy((floor_div(F.col("_block0"), PARTS) + 1).alias("_i")).agg(n.alias("every"))
    before = carried(totals, [], 2, [count]).withColumn("_i", floor_div(F.col("_block0"), PARTS))
    before = before.join(tuned, "_i", "left").withColumn("every", F.coalesce("every", F.lit(1).cast("long")))
    numbered = resolved(local, stage(before, "blocks"), [], rows.columns, [count], carry=["every"])
    return numbered.filter(F.col("number") % F.col("every") == 0)


def by_rule(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("stream", "rule").agg(F.count(F.lit(1)).alias("alerts"))


def summary(
    events: DataFrame, alerts: DataFrame, windows: DataFrame, as_of: datetime,
    every: timedelta = timedelta(seconds=1), budget: float = BUDGET,
) -> DataFrame:
    """The one-row overview: rates over the interval before ``as_of``, totals, latency."""
    width, now = micros(every), _us(as_of)

    def tally(df, name, at):
        recent = F.count_if((F.unix_micros(at) >= now - width) & (F.unix_micros(at) < now))
        return df.agg(F.count(F.lit(1)).alias(name), recent.alias(f"{name}_recent"))

    classes = classify_latency(alerts).agg(
        F.count_if(F.col("latency_class") == "absence").alias("absence_alerts"),
        F.count_if(F.col("latency_class") == "skewed").alias("clock_skewed"),
    )
    parts = [
        tally(events, "events", "at"), tally(alerts, "alerts", "detected_at"), classes,
        windows.agg(F.count(F.lit(1)).alias("windows")), latency_stats(alerts),
    ]
    # One row each: stack them and take the value each column has in one of them.
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    row = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    eps = F.col("events_recent") / F.lit(width / 1e6)
    aps = F.col("alerts_recent") / F.lit(width / 1e6)
    return row.select(
        round1_trunc(eps).alias("events_per_second"),
        round1_trunc(aps).alias("alerts_per_second"),
        "events", "alerts", "count", *QUANTILES, "max_ms", "retained_max_ms",
        F.greatest(F.floor(eps / F.lit(float(budget))), F.lit(1)).cast("long").alias("sample_every"),
        "absence_alerts", "clock_skewed", "windows",
    )


def flow(events: DataFrame, dead_letters: DataFrame, alerts: DataFrame, live_keys: DataFrame) -> DataFrame:
    """One row: records consumed, dead letters, alerts, live keys, newest usable latency."""
    n = F.count(F.lit(1))
    newest = F.max_by(usable_latency_us(), F.when(usable_latency_us().isNotNull(), F.struct("detected_at", "id")))
    parts = [
        events.agg(n.alias("consumed")), dead_letters.agg(n.alias("dead_letters")),
        alerts.agg(n.alias("alerts"), (newest / 1000).cast("long").alias("latency_ms")),
        live_keys.agg(n.alias("live_keys")),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
