"""A missing value counts as 0 for the rules and is left out of window metrics."""

from datetime import timedelta

from pyspark.sql import functions as F

from tests.util import event, events
from tidemark import default_profiles, detect
from tidemark.operators.metrics import tumbling
from tidemark.operators.replay import replay


def rows(spark):
    df = events(spark, [event(f"e{i:02d}", "sensors", "k", i, float(i % 3)) for i in range(60)])
    return df.withColumn("value", F.when(~F.col("id").endswith("5"), F.col("value")))


def test_detect_and_replay(spark):
    given = rows(spark).withColumn("seq", F.substring("id", 2, 2).cast("long"))
    filled = given.fillna(0.0, ["value"])
    for run in (detect, replay):
        found = [sorted(map(str, run(df, default_profiles()).candidates.select("rule", "key", "at_us", "seq").collect())) for df in (given, filled)]
        assert found[0] == found[1]


def test_tumbling(spark):
    out = tumbling(rows(spark), timedelta(seconds=60)).collect()
    assert sum(r["count"] for r in out) == 54
