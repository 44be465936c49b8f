"""Splitting one key's history over many tasks without changing any result.

A window function puts all rows of its partition in one task, so a key that holds
a third of the data would hold a third of the run time. Two tools avoid that:

* ``with_context`` cuts time into slices and gives each slice a copy of the rows
  just before it. Whatever looks back no further than the copied span is then
  computed per (key, slice) exactly, in one shuffle.
* ``running`` computes aggregates over *all* earlier rows of a key in blocks: a
  running value inside each block, one total per block, and a running value over
  the totals. Only the totals are ever brought together per key, and the input is
  read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.staging import stage


def floor_div(value: Column, width: Column | int) -> Column:
    """Integer division rounding down, exact for 64-bit values."""
    width = F.lit(width) if isinstance(width, int) else width
    return ((value - F.pmod(value, width)) / width).cast("long")


def with_context(df: DataFrame, us: str, slice_us: Column, overlap_us: Column) -> DataFrame:
    """Add ``slice`` and ``own``; rows in the last ``overlap_us`` of a slice also appear,
    with ``own`` false, in the next one. ``overlap_us`` must not exceed ``slice_us``."""
    home = floor_div(F.col(us), slice_us)
    staged = df.withColumn("_home", home)
    near_end = F.col(us) >= (F.col("_home") + 1) * slice_us - overlap_us
    slices = F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    return (
        staged.withColumn("slice", F.explode(slices))
        .withColumn("own", F.col("slice") == F.col("_home"))
        .drop("_home")
    )


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``how`` is sum, max or last (last non-null)."""

    name: str
    value: Column
    how: str

    def over(self, value: Column, window) -> Column:
        if self.how == "sum":
            return F.sum(value).over(window)
        if self.how == "max":
            return F.max(value).over(window)
        return F.last(value, ignorenulls=True).over(window)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Sequence[Column],
    aggs: Sequence[Running],
    inclusive: bool = True,
    _depth: int = 0,
) -> DataFrame:
    """Running aggregates over all rows of ``keys`` so far, in ``order``.

    ``blocks`` are coarser and coarser functions of the order columns, each one
    non-decreasing along the order and constant inside the blocks of the one before.
    Two blockings make a three-level scan. With ``inclusive`` false the current row
    is left out. ``keys`` must not be null.

    ``df`` is read once: its rows are written with their running value inside the block, and
    a block's total is the one at its last row.
    """
    rows, totals = blockwise(df, keys, order, blocks, aggs, inclusive, _depth)
    before = carried(totals, keys, len(blocks), aggs, _depth)
    return resolved(rows, before, keys, df.columns, aggs, _depth)


def _tmp(what: str, depth: int) -> str:
    return f"_{what}{depth}"


def blockwise(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: Sequence[Column], aggs: Sequence[Running],
    inclusive: bool = True, depth: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The written rows with running values inside their block, and one row of totals for each block, both read from one table."""
    block, outer = _tmp("block", depth), [_tmp(f"outer{i}_", depth) for i in range(len(blocks) - 1)]
    df = df.select(
        "*",
        blocks[0].alias(block),
        *[b.alias(o) for b, o in zip(blocks[1:], outer)],
        *[a.value.alias(_tmp(f"v_{a.name}_", depth)) for a in aggs],
    )
    w = Window.partitionBy(*keys, block).orderBy(*order)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    values = [F.col(_tmp(f"v_{a.name}_", depth)) for a in aggs]
    local = df.select(
        "*",
        *[a.over(v, upto).alias(_tmp(f"t_{a.name}_", depth)) for a, v in zip(aggs, values)],
        *([] if inclusive else [a.over(v, earlier).alias(_tmp(f"l_{a.name}_", depth)) for a, v in zip(aggs, values)]),
        F.lead(F.lit(1)).over(w).isNull().alias(_tmp("last", depth)),
    ).drop(*[_tmp(f"v_{a.name}_", depth) for a in aggs])
    rows = stage(local, "running")
    totals = rows.filter(_tmp("last", depth)).select(*keys, block, *outer, *[_tmp(f"t_{a.name}_", depth) for a in aggs])
    if inclusive:
        rows = rows.withColumnsRenamed({_tmp(f"t_{a.name}_", depth): _tmp(f"l_{a.name}_", depth) for a in aggs})
    return rows, totals


def carried(totals: DataFrame, keys: Sequence[str], levels: int, aggs: Sequence[Running], depth: int = 0) -> DataFrame:
    """For each block the aggregates over all blocks before it."""
    block, outer = _tmp("block", depth), [_tmp(f"outer{i}_", depth) for i in range(levels - 1)]
    sums = [Running(_tmp(f"c_{a.name}_", depth), F.col(_tmp(f"t_{a.name}_", depth)), a.how) for a in aggs]
    if outer:
        return running(totals, keys, [block], [F.col(o) for o in outer], sums, False, depth + 1)
    prefix = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("*", *[c.over(c.value, prefix).alias(c.name) for c in sums])


def resolved(
    rows: DataFrame, before: DataFrame, keys: Sequence[str], plain: Sequence[str], aggs: Sequence[Running], depth: int = 0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The columns ``plain`` of ``rows``, the aggregates made whole, and the columns ``carry`` of their block."""
    by = [*keys, _tmp("block", depth)]
    joined_on = [_tmp(f"k{i}_", depth) for i in range(len(by))]
    before = before.select(
        *[F.col(k).alias(j) for k, j in zip(by, joined_on)], *[_tmp(f"c_{a.name}_", depth) for a in aggs], *carry
    )
    match = reduce(and_, [F.col(k) == F.col(j) for k, j in zip(by, joined_on)])
    out = rows.join(before, match, "left")
    values = []
    for a in aggs:
        here, earlier = F.col(_tmp(f"l_{a.name}_", depth)), F.col(_tmp(f"c_{a.name}_", depth))
        if a.how == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        elif a.how == "max":
            value = F.greatest(here, earlier)
        else:
            value = F.coalesce(here, earlier)
        values.append(value.alias(a.name))
    return out.select(*plain, *values, *carry)
