"""The alert table: enriched rows, idempotent inserts, retention, and its lookups.

A row belongs to the entity ``pk`` and sorts inside it by ``sk``, detection time then
alert id. Files are laid out by stream and day of detection, so inserts and retention
touch only the days they concern.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.scalars import millis, severity_rank
from tidemark.operators.frames import _us
from tidemark.operators.staging import stage
from tidemark.sources.records import rfc3339

RETENTION = timedelta(days=30)  # fixed values: how long alerts and dead letters are kept
DEAD_LETTER_RETENTION = timedelta(days=7)
LAYOUT = ("stream", "day")


def latency_us():
    """Signed time from the event to its detection."""
    return F.unix_micros("detected_at") - F.unix_micros("at")


def usable_latency_us():
    """Latency where it is one: not for silence, and not when clocks disagree."""
    return F.when(~F.col("absence") & (latency_us() >= 0), latency_us())


def entity_pk(stream, key):
    return F.concat(F.lit("ALERT#"), stream, F.lit("#"), key)


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Table rows of alerts. An alert without an id cannot be written; see ``insert``."""
    detected = F.col("detected_at")
    return alerts.select(
        entity_pk(F.col("stream"), F.col("key")).alias("pk"),
        F.concat(rfc3339(detected), F.lit("#"), F.col("id")).alias("sk"),
        F.col("id").alias("alert_id"),
        "rule", "stream",
        F.col("key").alias("entity_key"),
        "severity",
        severity_rank(F.col("severity")).alias("severity_rank"),
        "title", "detail", "evidence", "event_ids",
        rfc3339(F.col("at")).alias("at"),
        rfc3339(detected).alias("detected_at"),
        millis(usable_latency_us()).alias("latency_ms"),
        "absence",
        (F.unix_seconds(detected) + int(RETENTION.total_seconds())).alias("expires_at"),
        F.to_date(F.substring(rfc3339(detected), 1, 10)).alias("day"),
    )


@dataclass(frozen=True)
class Written:
    written: int
    skipped: int
    errors: int


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def new_rows(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows whose (pk, sk) is neither stored nor earlier in the same batch."""
    fresh = rows.filter(F.coalesce("alert_id", F.lit("")) != "").dropDuplicates(["pk", "sk"])
    return fresh if stored is None else fresh.join(stored.select("pk", "sk"), ["pk", "sk"], "left_anti")


def stored_rows(spark: SparkSession, path: str, days: Iterable[tuple], schema: StructType) -> DataFrame | None:
    """The rows of the given (stream, day) folders alone; None if there are none yet."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folders = [f"{path}/stream={escaped(stream)}/day={day}" for stream, day in days]
    folders = [f for f in folders if _exists(spark, f)]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders) if folders else None


def insert(alerts: DataFrame, path: str) -> Written:
    """Write the alerts that are not in the table yet; repeating it writes nothing.

    Of the table only the folders of the streams and days that the batch has are read, however far apart they lie. The batch and what is new of it are
    written to the shared folder first, as both are read more than once.
    """
    spark = alerts.sparkSession
    rows = stage(alert_rows(alerts), "batch")
    came, errors = rows.agg(F.count(F.lit(1)), F.count_if(F.coalesce("alert_id", F.lit("")) == "")).first()
    days = [tuple(r) for r in rows.select(*LAYOUT).distinct().dropna().collect()]
    if not came:
        return Written(0, 0, 0)
    fresh = stage(new_rows(rows, stored_rows(spark, path, days, rows.schema)), "fresh")
    written = fresh.count()
    # Balanced files per day, whatever a day holds; sorted, so lookups by pk skip row groups.
    if written:
        fresh.hint("rebalance", *LAYOUT).sortWithinPartitions(*LAYOUT, "pk", "sk").write.mode("append").partitionBy(*LAYOUT).parquet(path)
    return Written(written, came - errors - written, errors)


def insert_batches(path: str, report: Callable[[int, Written], None] | None = None):
    """A ``foreachBatch`` function. A batch that runs again after a failure finds its
    rows stored, so at-least-once delivery leaves each alert once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        result = insert(batch, path)
        if report:
            report(batch_id, result)

    return write


def live(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Rows that have not expired."""
    return rows.filter(F.col("expires_at") > _us(as_of) // 1_000_000)


def live_dead_letters(letters: DataFrame, as_of: datetime) -> DataFrame:
    return letters.filter(F.unix_micros("at") > _us(as_of) - DEAD_LETTER_RETENTION // timedelta(microseconds=1))


def drop_expired_days(spark: SparkSession, path: str, as_of: datetime) -> list[str]:
    """Delete the day folders in which every row has expired."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    # Rows of a day expire up to a day apart.
    keep_from = (as_of - RETENTION).date()
    gone = []
    for stream in fs.listStatus(root):
        if stream.isDirectory() and stream.getPath().getName().startswith("stream="):
            for day in fs.listStatus(stream.getPath()):
                name = day.getPath().getName()
                if name.startswith("day=") and datetime.fromisoformat(name[4:]).date() < keep_from:
                    fs.delete(day.getPath(), True)
                    gone.append(f"{stream.getPath().getName()}/{name}")
    return sorted(gone)


# Lookups. A limit here is the feature; sorting with one keeps the top rows per task.

RECENT, ON_LOAD, BRIEF, LETTERS = 60, 20, 10, 20  # fixed values


def recent(alerts: DataFrame, n: int = RECENT, stream: str | None = None) -> DataFrame:
    """The newest alerts, of one stream if named."""
    chosen = alerts if stream is None else alerts.filter(F.col("stream") == stream)
    return chosen.orderBy(F.desc("detected_at"), F.desc("id")).limit(n)


def of_entity(rows: DataFrame, stream: str, key: str) -> DataFrame:
    """Everything that happened to one entity, newest first."""
    return rows.filter((F.col("stream") == stream) & (F.col("pk") == f"ALERT#{stream}#{key}")).orderBy(F.desc("sk"))


def by_severity(rows: DataFrame) -> DataFrame:
    """Critical first, newest first among equals."""
    return rows.orderBy(F.desc("severity_rank"), F.desc("detected_at"), F.desc("alert_id"))


def brief(rows: DataFrame, n: int = BRIEF) -> DataFrame:
    return rows.select("pk", "rule", "severity", "title", "latency_ms").limit(n)


def first_dead_letters(letters: DataFrame, n: int = LETTERS) -> DataFrame:
    return letters.orderBy("partition", "offset").limit(n)
