"""Writers for streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
import time

import pyarrow as pa
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.alert_table import _exists, insert_batches
from tidemark.operators.validate import dead_letters, split_valid
from tidemark.profiles import Profile, by_stream
from tidemark.sources.records import decode_events, encode_alerts
from tidemark.streaming.detector import detect_stream

FORWARD_BATCH, FORWARD_EVERY, RETRY_AFTER = 50, "5 seconds", 2.0  # fixed values: rows, interval, seconds


def to_log(records: DataFrame, topic: str, checkpoint: str, options: dict[str, str]) -> StreamingQuery:
    """Write (key, value) records to a keyed log through Spark's Kafka sink."""
    return (
        records.selectExpr("key", "value").writeStream.format("kafka").options(**options)
        .option("topic", topic).option("checkpointLocation", checkpoint).outputMode("append").start()
    )


def start_detection(
    raw: DataFrame,
    profiles: Iterable[Profile],
    checkpoint: str,
    on_alerts: Callable[[DataFrame, int], None],
    on_dead_letters: Callable[[DataFrame, int], None],
    trigger: dict | None = None,
    **options,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Detection and dead letters of raw records, as two queries with own checkpoints.

    Undecodable and invalid records never reach the stateful part, so a bad record
    cannot stop it. ``seq`` is the record's offset: a key lives in one log partition.
    """
    profiles = tuple(profiles)
    decoded = decode_events(raw).withColumn("seq", F.col("offset"))
    _, rejected = split_valid(decoded, by_stream(profiles))
    trigger = trigger or {"processingTime": "1 second"}

    def start(df: DataFrame, name: str, write) -> StreamingQuery:
        return (
            df.writeStream.queryName(name).outputMode("append").foreachBatch(write)
            .option("checkpointLocation", f"{checkpoint}/{name}").trigger(**trigger).start()
        )

    return (
        start(detect_stream(decoded, profiles, **options), "detection", on_alerts),
        start(dead_letters(rejected), "dead_letters", on_dead_letters),
    )


def start_alert_storage(alerts: DataFrame, path: str, checkpoint: str, report=None, trigger: dict | None = None) -> StreamingQuery:
    """Forward alerts to the table at least once. A batch counts as done only when all of
    it is stored; a failed one runs again. Bound batches with the source's
    ``maxOffsetsPerTrigger`` (``FORWARD_BATCH``)."""
    return (
        alerts.writeStream.queryName("alert_storage").outputMode("append")
        .foreachBatch(insert_batches(path, report))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": FORWARD_EVERY}))
        .start()
    )


def forward_batches(
    send: Callable[[list[dict]], None], progress: str, size: int = FORWARD_BATCH, wait: float = RETRY_AFTER, attempts: int = 5,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands every row to ``send``, at most ``size`` at a time, at least once and in the order of its partition.

    Tasks send in parallel. A micro-batch is written to ``progress``, a folder that all executors reach, before anything is sent, so that a repetition has the same
    portions; each portion that was sent leaves a record there. After an error a task waits ``wait`` seconds and goes on with the portion that failed; after ``attempts`` of these
    the task fails, and whatever runs next, another try of Spark's or the repeated micro-batch, starts from the first portion without a record.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{progress}/batch-{batch_id}"
        if not _exists(spark, f"{path}/_SUCCESS"):
            numbered = batch.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
            numbered.write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        parts = rows.select("_part").distinct().count()
        if parts:
            ordered = rows.repartition(parts, "_part").sortWithinPartitions("_part", "_n")
            ordered.mapInArrow(_sender(send, f"{path}-sent", size, wait, attempts), "sent long").write.format("noop").mode("overwrite").save()

    return write


def _sender(send, sent: str, size: int, wait: float, attempts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(sent) if "://" in sent else (LocalFileSystem(), sent)
        files.create_dir(root)

        def portion(part: int, n: int, rows: list[dict]) -> int:
            record = f"{root}/{part}-{n}"
            if files.get_file_info(record).type != FileType.NotFound:
                return 0
            for attempt in range(1, attempts + 1):
                try:
                    send(rows)
                    break
                except Exception:
                    if attempt == attempts:
                        raise
                    time.sleep(wait)
            with files.open_output_stream(record) as out:
                out.write(str(len(rows)).encode())
            return len(rows)

        held, part, n, done = [], None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                mine = row.pop("_part")
                row.pop("_n")
                if held and (mine != part or len(held) == size):
                    done += portion(part, n, held)
                    held, n = [], n + 1
                if mine != part:
                    part, n = mine, 0
                held.append(row)
        if held:
            done += portion(part, n, held)
        yield pa.RecordBatch.from_pydict({"sent": [done]})

    return run


def start_forwarding(rows: DataFrame, send: Callable[[list[dict]], None], progress: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Forward the rows of a stream (see ``forward_batches``)."""
    return (
        rows.writeStream.queryName("forwarding").outputMode("append").foreachBatch(forward_batches(send, progress, **options))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": FORWARD_EVERY})).start()
    )


def alert_records(alerts: DataFrame) -> DataFrame:
    """Alert records of a table, or of one micro-batch, with each entity's alerts together and in detection order."""
    return encode_alerts(alerts.repartition("stream", "key").sortWithinPartitions("stream", "key", "detected_at"))


def start_alert_log(alerts: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Hand the records of each micro-batch to ``write``, in the order of ``alert_records``. A failed batch is handed over again."""
    return (
        alerts.writeStream.queryName("alert_log").outputMode("append")
        .foreachBatch(lambda batch, i: write(alert_records(batch), i))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
    )
