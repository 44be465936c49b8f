"""Moving numpy records between tasks as one binary per target bucket, and joins with a side of a counted size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch where rows carry texts or sets. JVM and worker both hold a batch and what is made of it.
BATCH_ROWS = 1000
#: Rows up to which the smaller side of a join is broadcast; it is counted first.
BROADCAST_ROWS = 500_000


def packed(buckets: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row (bucket, data) for each bucket that occurs."""
    order = np.argsort(buckets, kind="stable")
    buckets, records = buckets[order], records[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts = np.concatenate([[0], cuts]) if len(buckets) else np.zeros(0, np.int64)
    ends = np.concatenate([cuts, [len(buckets)]]) if len(buckets) else starts
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[starts], pa.int32()), pa.array([records[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
        ["bucket", "data"],
    )


PACKED = "bucket int, data binary"


def unpacked(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All records that a task has got."""
    parts = [np.frombuffer(x, dtype) for b in batches for x in b.column(b.schema.get_field_index("data")).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def n_buckets(df: DataFrame) -> int:
    """As many as a shuffle has partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n, "bucket")


def small_or_shuffled(side: DataFrame) -> DataFrame:
    """``side`` with a broadcast hint if it has few rows; else Spark shuffles both sides. Counts it, so pass a written table."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most, from here on in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))


def give_back() -> None:
    """Freed memory goes back to the system. Python workers outlive their tasks, and Spark keeps some of them idle."""
    pa.system_memory_pool().release_unused()


def lean(run: Callable) -> Callable:
    """``run`` over Arrow batches, with Arrow's memory from the system, and given back at the end."""

    def batches(given):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(given)
        give_back()

    return batches


def lean_group(run: Callable) -> Callable:
    """The same for a function of one group."""

    def group(table):
        pa.set_memory_pool(pa.system_memory_pool())
        out = run(table)
        give_back()
        return out

    return group


def lean_cogroup(run: Callable) -> Callable:
    """The same for a function of two groups."""

    def cogroup(left, right):
        pa.set_memory_pool(pa.system_memory_pool())
        out = run(left, right)
        give_back()
        return out

    return cogroup
