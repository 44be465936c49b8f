"""Splitting busy keys so that no task gets the whole history of one.

A window function puts all rows of its partition into one task. Most keys are small
enough for that. A key with more than ``BLOCK_ROWS`` rows is cut at quantiles of its event
times into blocks, and each block is given the rows just before it as context. A rule
looks back at most ``cap`` rows, whatever its window, so the last ``cap`` rows suffice:
the result is the same as without the cut.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.staging import stage
from tidemark.profiles import Profile

BLOCK_ROWS = 500_000
MAX_BLOCKS = 4096  # per key
STRIDE = 64  # bounds per step of the two-step search
# Up to so many busy keys and bounds their table is broadcast (tens of megabytes at most).
MAX_BROADCAST_KEYS, MAX_BROADCAST_BOUNDS = 10_000, 2_000_000

ENTITY = ["stream", "key"]


def busy_keys(rows: DataFrame, size: int) -> DataFrame:
    """Keys with more than ``size`` rows; there are at most rows / ``size`` of them."""
    return rows.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > size)


def bounds(rows: DataFrame, busy: DataFrame, size: int) -> DataFrame:
    """Where to cut each busy key: ascending distinct event times, about ``size`` rows apart."""
    wanted = F.least(F.ceil(F.col("rows") / size), F.lit(MAX_BLOCKS)).cast("int")
    steps = [i / MAX_BLOCKS for i in range(1, MAX_BLOCKS)]
    cuts = (
        rows.join(busy, ENTITY)
        .groupBy(*ENTITY)
        .agg(F.percentile_approx("at_us", steps, 16 * MAX_BLOCKS).alias("q"), F.first("rows").alias("rows"))
        .select(*ENTITY, "q", wanted.alias("blocks"))
    )
    index = F.sequence(F.lit(1), F.col("blocks") - 1)
    picked = F.transform(index, lambda i: F.element_at("q", F.ceil(i * F.lit(MAX_BLOCKS) / F.col("blocks")).cast("int")))
    cuts = cuts.select(*ENTITY, F.array_sort(F.array_distinct(picked)).alias("bounds"))
    coarse = F.filter("bounds", lambda _, i: i % STRIDE == 0)
    return cuts.withColumn("coarse", coarse)


def _small(table: DataFrame) -> bool:
    n, cuts = table.agg(F.count(F.lit(1)), F.sum(F.size("bounds"))).first()
    return n <= MAX_BROADCAST_KEYS and (cuts or 0) <= MAX_BROADCAST_BOUNDS


def _block() -> Column:
    step = F.size(F.filter("coarse", lambda b: b <= F.col("at_us")))
    near = F.slice("bounds", (step - 1) * STRIDE + 1, F.lit(STRIDE))
    fine = F.size(F.filter(near, lambda b: b <= F.col("at_us")))
    return F.when(F.col("bounds").isNull() | (step < 1), 0).otherwise((step - 1) * STRIDE + fine)


def _alone() -> list[Column]:
    return [F.lit(0).alias("block"), F.lit(0).alias("last_block"), F.lit(True).alias("own")]


def with_blocks(rows: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Add ``block``, ``last_block`` (of the key) and ``own``. Rows with ``own`` false are context for their block.

    Counting rows per key reads two columns and shuffles one row per key and task; it
    runs at once, because where no key is busy, as is usual, there is nothing to join.
    """
    cap = max(p.cap for p in profiles.values())
    size = max(BLOCK_ROWS, 4 * cap)
    busy = busy_keys(rows, size)
    if busy.isEmpty():
        return rows.select("*", *_alone())
    table = stage(bounds(rows, busy, size), "bounds")
    # Past the size limit the join is left to adaptive execution, which splits skewed keys.
    lookup = F.broadcast(table) if _small(table) else table
    cut = rows.join(lookup, ENTITY, "left").withColumn("block", _block())
    # Blocks shorter than ``cap`` come about when many rows share one time, but never two
    # in a row; so the ends of the two blocks before hold at least ``cap`` rows.
    last = Window.partitionBy(*ENTITY, "block").orderBy(F.desc("at_us"), F.desc("seq"))
    tails = (
        cut.filter("bounds IS NOT NULL")
        .withColumn("from_end", F.row_number().over(last))
        .filter(F.col("from_end") <= cap)
        .withColumn("block", F.explode(F.array(F.col("block") + 1, F.col("block") + 2)))
        # Not past the key's last block: nobody would look at them.
        .filter(F.col("block") <= F.size("bounds"))
    )
    columns = [*rows.columns, "block", F.coalesce(F.size("bounds"), F.lit(0)).alias("last_block")]
    return cut.select(*columns, F.lit(True).alias("own")).unionByName(
        tails.select(*columns, F.lit(False).alias("own"))
    )
