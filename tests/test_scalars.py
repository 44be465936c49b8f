import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def evaluate(spark, values, schema, column):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + schema)
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_compact_float(spark):
    cases = {
        math.inf: "∞", -math.inf: "∞", math.nan: "—", 1_627_692.3: "1.6M", 18_537.2: "18.5K", 1000.0: "1K", 182.4: "182",
        182.5: "182", 183.5: "184", 89.90: "89.9", 0.0: "0", -2400.0: "-2.4K", -8.5: "-8.5", 2.675: "2.67",
        3.45e6: "3.5M", 0.125: "0.12", 0.375: "0.38", 99.999: "100", 999.5: "1000", 1.005: "1",
    }
    got = evaluate(spark, [(k,) for k in cases], "v double", S.compact_float("v"))
    assert got == list(cases.values())
    # What the text must be is what exact binary rounding gives.
    values = [k / 128 for k in range(-300, 300)] + [k / 1000 for k in range(5, 3000, 10)]
    got = evaluate(spark, [(v,) for v in values], "v double", S.fixed("v", 2))
    assert got == [f"{v:.2f}" for v in values]


def test_compact_duration(spark):
    cases = {420_000: "420ms", 41_000_000: "41s", 1_500_000: "1.5s", 94_000_000: "1m34s", 3 * 3_600_000_000: "3h00m", 0: "0ms"}
    assert evaluate(spark, [(k,) for k in cases], "v long", S.compact_duration("v")) == list(cases.values())


def test_distance(spark):
    sp, tokyo, rio = (-23.5505, -46.6333), (35.6762, 139.6503), (-22.9068, -43.1729)
    km = S.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    rows = [(*sp, *tokyo), (*sp, *rio), (0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 0.0), (*sp, *sp)]
    got = evaluate(spark, rows, "a double, b double, c double, d double", km)
    for value, want, off in zip(got, (18530, 357, 20015, 20015, 0), (60, 5, 10, 10, 1e-9)):
        assert abs(value - want) <= off


def test_severity(spark):
    cases = [(1.0, 0.0, "critical"), (20.0, 10.0, "critical"), (19.9, 10.0, "warn"), (12.5, 10.0, "warn"), (12.4, 10.0, "info")]
    got = evaluate(spark, [c[:2] for c in cases], "o double, t double", S.severity(F.col("o"), F.col("t")))
    assert got == [c[2] for c in cases]
    assert evaluate(spark, [("critical",), ("warn",), ("info",), ("odd",)], "s string", S.severity_rank(F.col("s"))) == [3, 2, 1, 1]


def test_rounding(spark):
    values = [(-0.125,), (1.005,), (2.5,), (0.125,)]
    assert evaluate(spark, values, "v double", S.round_to(F.col("v"), 2)) == [-0.13, 1.0, 2.5, 0.13]
    assert evaluate(spark, values, "v double", S.round2_up(F.col("v"))) == [-0.12, 1.0, 2.5, 0.13]
    assert evaluate(spark, [(14.26,), (14.24,)], "v double", S.round1_trunc(F.col("v"))) == [14.3, 14.2]


def test_state_keys(spark):
    keys = [("payments/card-1",), ("sensors/grid/A7",), ("no-separator",), ("/x",)]
    got = evaluate(spark, keys, "k string", S.parse_state_key(F.col("k")))
    assert [None if g is None else tuple(g) for g in got] == [("payments", "card-1"), ("sensors", "grid/A7"), None, ("", "x")]


def test_terminal_and_places(spark):
    labels = [({"status": s},) for s in ("done", "failed", "cancelled", "running", "queued", "")] + [(None,), ({},)]
    got = evaluate(spark, labels, "l map<string,string>", S.is_terminal(F.col("l")))
    assert got == [True] * 3 + [False] * 5
    geos = [(None,), ((1.0, 2.0, "Rio"),), ((1.005, -2.125, ""),), ((1.0, 2.0, None),)]
    got = evaluate(spark, geos, "g struct<lat:double,lon:double,place:string>", S.place_of("g"))
    assert got == ["?", "Rio", "1.00,-2.12", "1.00,2.00"]


@pytest.mark.parametrize("text,micros", [
    ("2026-09-02T12:00:00.123456789Z", 1788350400123456), ("2026-09-02T12:00:00-03:00", 1788361200000000),
    ("2026-09-02", None), ("2026-09-02 12:00:00Z", None), ("soon", None), ("2026-13-02T12:00:00Z", None),
])
def test_rfc3339(spark, text, micros):
    assert evaluate(spark, [(text,)], "t string", F.unix_micros(S.parse_rfc3339(F.col("t")))) == [micros]
