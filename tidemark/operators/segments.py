"""Numbering the lives of a key: a new one starts after a terminal event or a silence
long enough to be reported."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cases import per_stream
from tidemark.functions.scalars import is_terminal
from tidemark.operators.frames import prepare, stall_deadline
from tidemark.operators.slices import Running, blockwise, floor_div, resolved, running
from tidemark.operators.staging import stage
from tidemark.profiles import Profile, micros

WINDOWS_PER_SLICE, SLICES_PER_BLOCK = 4, 4096


def numbered_segments(events: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Add ``segment``, counted from 0 per (stream, key) in event-time order.

    Unlike the frames this needs the previous event however long ago, and a count from
    the beginning. Inside a block of time both come from its rows. What precedes a block's first row is the last row of an earlier
    block, so one row for each block settles the rest: its first and last event and the starts inside it. The events are read once.
    """
    keys, order = ["stream", "key"], ["at_us", "seq"]
    rows = prepare(events).withColumn("terminal", is_terminal(F.col("labels")))
    width = per_stream(profiles, lambda p: WINDOWS_PER_SLICE * max(micros(p.retention), 1))
    slice_ = floor_div(F.col("at_us"), width)
    w = Window.partitionBy(*keys, slice_).orderBy(*order)
    before = F.lag(F.struct("at_us", "terminal")).over(w)
    rows = rows.select("*", _starts(profiles, before, F.col("at_us")).alias("_starts"), F.min("at_us").over(w).alias("_first_us"))
    inside = Running("segment", F.coalesce(F.col("_starts"), F.lit(False)).cast("long"), "sum")
    ends = Running("_end", F.struct("at_us", "terminal", "_first_us"), "last")
    local, totals = blockwise(rows, keys, order, [slice_, floor_div(slice_, SLICES_PER_BLOCK)], [inside, ends])
    # Over the blocks: the last event before each, whether the block starts a new life, and how many started before.
    last = Running("prev", F.col("_t__end_0"), "last")
    blocks = running(totals, keys, ["_block0"], [F.col("_outer0_0")], [last], inclusive=False, _depth=1)
    starts = F.coalesce(_starts(profiles, F.col("prev"), F.col("_t__end_0._first_us")), F.lit(False)).cast("long")
    blocks = blocks.withColumn("_own", starts)
    count = Running("_c_segment_0", F.col("_own") + F.col("_t_segment_0"), "sum")
    blocks = running(blocks, keys, ["_block0"], [F.col("_outer0_0")], [count], inclusive=False, _depth=2)
    blocks = blocks.withColumn("_c_segment_0", F.coalesce("_c_segment_0", F.lit(0).cast("long")) + F.col("_own"))
    return resolved(local, stage(blocks, "blocks"), keys, [c for c in prepare(events).columns], [inside])


def _starts(profiles: Mapping[str, Profile], before: Column, at_us: Column) -> Column:
    """Whether a life starts at ``at_us`` after the event ``before``; null where there is none."""
    silent = at_us >= stall_deadline(profiles, before["at_us"])
    return F.when(before.isNotNull(), before["terminal"] | F.coalesce(silent, F.lit(False)))
