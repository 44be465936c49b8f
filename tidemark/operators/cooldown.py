"""Thinning repeats: one alert per condition, unless it gets worse.

A candidate is suppressed while its (stream, key, rule) cools down and it is no more
severe than the alert that started the cooldown. A suppressed candidate does not
extend the cooldown; a terminal event of the key ends it.

The decision is a fold with the small state ``(until, rank)`` over the hits of an entity in
time order. What makes it parallel:

* Hits are range partitioned by entity and time into slices of about ``SLICE_ROWS`` rows, so
  an entity that fires all the time is spread over as many slices as it needs. Only what the
  fold looks at goes there: ids, places and texts stay where they are and are joined back.
* Each slice is folded at once. An entity that starts in it starts free; only the first
  entity of a slice may have come in from the slice before, in a state not known yet.
* For that first stretch a slice tells its *transfer function*: the state at the end for each
  state that may enter. For a given rank it is a step function of ``until``, kept as runs; states
  that lead to the same admitted hit share a run, and runs with equal ends are merged. It is
  built with a few passes over arrays, however often the rule fired.
* The true entry states follow by looking up one slice after the other, a few numbers each.
  Only stretches entered while cooling down are folded again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cases import per_stream
from tidemark.operators.staging import stage
from tidemark.profiles import Profile, micros

ENTITY = ["stream", "key", "rule"]
SLICE_ROWS = 1_000_000

FREE = (0, 0)  # the state in which everything is admitted
RANKS = (1, 2, 3)  # fixed values: info, warn, critical
FOREVER = 2**63 - 1

_RUN = "struct<held:int,upto:long,until:long,rank:int>"
_TOLD = f"struct<first:struct<stream:string,key:string,rule:string>,last:struct<stream:string,key:string,rule:string>,until:long,rank:int,runs:array<{_RUN}>>"
_FOLDED = f"part int, rid long, keep boolean, first boolean, idx long, clock_us long, rank int, cool_us long, ends boolean, told {_TOLD}"
_NAMES = pa.struct([("stream", pa.string()), ("key", pa.string()), ("rule", pa.string())])
_RUNS = pa.list_(pa.struct([("held", pa.int32()), ("upto", pa.int64()), ("until", pa.int64()), ("rank", pa.int32())]))
_FOLDED_ARROW = pa.schema([
    ("part", pa.int32()), ("rid", pa.int64()), ("keep", pa.bool_()), ("first", pa.bool_()), ("idx", pa.int64()), ("clock_us", pa.int64()), ("rank", pa.int32()),
    ("cool_us", pa.int64()), ("ends", pa.bool_()),
    ("told", pa.struct([("first", _NAMES), ("last", _NAMES), ("until", pa.int64()), ("rank", pa.int32()), ("runs", _RUNS)])),
])


def numbered(hits: DataFrame) -> DataFrame:
    """``hits`` written once, each with its number ``rid``: they are read to be folded, and again to be given back."""
    return stage(hits.withColumn("rid", F.monotonically_increasing_id()), "hits")


def admit(candidates: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """The hits (see ``rules.hits``, markers included) that become alerts.

    Silences pass as they are. Whoever found them has seen to their cooldown, as it
    decides whether the key lives on; in event-time order none falls into one (see
    ``frames.check_in_order``)."""
    if "rid" not in candidates.columns:
        candidates = numbered(candidates)
    columns = [c for c in candidates.columns if c != "rid"]
    kept = _kept(stage(folded(candidates, profiles), "folded"))
    # Spark broadcasts the numbers where their files are small enough, and shuffles otherwise.
    admitted = candidates.filter("NOT absence").join(kept, "rid", "left_semi")
    return admitted.select(columns).unionByName(candidates.filter("absence").select(columns))


def folded(candidates: DataFrame, profiles: Mapping[str, Profile]) -> DataFrame:
    """Each slice folded as if nothing came in: the rows kept, all rows of its first entity, and one row in which ``told`` sums it up."""
    # A terminal event ends the cooldown of every rule of its stream.
    every = F.array_distinct(F.flatten(F.array(*[
        F.when(F.col("stream") == n, F.array(*[F.lit(r.name) for r in p.active()])).otherwise(F.array().cast("array<string>"))
        for n, p in profiles.items()
    ])))
    ends = F.col("rule") == ""
    rows = candidates.filter("NOT absence").select(
        "rid", "stream", "key", F.explode(F.when(ends, every).otherwise(F.array("rule"))).alias("rule"), "clock_us", "seq", "place", "rank",
        per_stream(profiles, lambda p: micros(p.cooldown)).cast("long").alias("cool_us"), ends.alias("ends"),
    )
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SLICE_ROWS))
    # A terminal event's own hits come before the end of its key, and rules of one kind in their profile's order. The number last: rows that are equal in all
    # else need not stay together.
    order = [*ENTITY, "clock_us", "seq", "ends", "place", "rid"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("idx", F.monotonically_increasing_id())
    return rows.select("part", "idx", "rid", *ENTITY, "clock_us", "rank", "cool_us", "ends").mapInArrow(_fold_slice, _FOLDED)


def _fold_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entity, first_entity, state, part, head = None, None, FREE, 0, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(n) for n in batch.schema.names}
        names = list(zip(*(columns[n].to_pylist() for n in ENTITY)))
        part = columns["part"][0].as_py()
        first_entity = first_entity or names[0]
        keep, state = _fold(columns, names, entity, state)
        entity = names[-1]
        in_first = len(names) if entity == first_entity else next(i for i, n in enumerate(names) if n != first_entity) if names[0] == first_entity else 0
        if in_first:
            head.append({n: columns[n].slice(0, in_first).to_numpy(zero_copy_only=False) for n in ("clock_us", "rank", "cool_us", "ends")})
        first = np.arange(len(names)) < in_first
        out = pa.table({n: columns[n] for n in ("part", "rid", "idx", "clock_us", "rank", "cool_us", "ends")})
        out = out.append_column("keep", pa.array(keep)).append_column("first", pa.array(first))
        out = out.append_column("told", pa.nulls(len(names), _FOLDED_ARROW.field("told").type)).filter(pa.array(keep | first))
        yield from out.select(_FOLDED_ARROW.names).cast(_FOLDED_ARROW).to_batches()
    if head:
        runs = [r._asdict() for r in transfer(*(np.concatenate([h[n] for h in head]) for n in ("clock_us", "rank", "cool_us", "ends")))]
        told = {"first": dict(zip(ENTITY, first_entity)), "last": dict(zip(ENTITY, entity)), "until": state[0], "rank": state[1], "runs": runs}
        yield pa.RecordBatch.from_pylist([{"part": part, "told": told}], _FOLDED_ARROW)


def _fold(columns: dict, names: list, entity, state: tuple[int, int]) -> tuple[np.ndarray, tuple[int, int]]:
    """Which rows are kept, entering in ``state`` of ``entity``, and the state at the end."""
    until, held = state
    keep = np.zeros(len(names), bool)
    for i, (name, clock, rank, cool, ends) in enumerate(zip(names, *(columns[n].to_pylist() for n in ("clock_us", "rank", "cool_us", "ends")))):
        if name != entity:
            entity, (until, held) = name, FREE
        if ends:
            until, held = FREE
        elif clock >= until or rank > held:
            keep[i], until, held = True, clock + cool, rank
    return keep, (until, held)


class Run(NamedTuple):
    """States of rank ``held`` with an ``until`` up to ``upto`` (and beyond the run before) lead to (until, rank); nothing there means that they stay."""

    held: int
    upto: int
    until: int | None
    rank: int | None


def transfer(clock: np.ndarray, rank: np.ndarray, cool: np.ndarray, ends: np.ndarray) -> list[Run]:
    """The transfer function of one entity's hits in order, by rank, then ``until``."""
    n = len(clock)
    at = np.arange(n)

    def next_of(mask: np.ndarray) -> np.ndarray:
        """The first place from here on, for each place and the end, where ``mask`` holds; n if there is none."""
        found = np.where(mask, at, n)
        return np.r_[np.minimum.accumulate(found[::-1])[::-1], n]

    hit, marker = next_of(~ends), next_of(ends)
    worse = {r: next_of(~ends & (rank > r)) for r in RANKS}
    # The hit admitted after an admitted one: the first that is late enough, worse, or behind a marker.
    late = np.maximum(np.searchsorted(clock, clock + cool), at + 1)
    step = np.minimum(hit[late], hit[marker[at + 1]])
    for r in RANKS:
        step = np.where(rank == r, np.minimum(step, worse[r][at + 1]), step)
    last = np.where(step < n, step, at)
    while True:
        further = last[last]
        if (further == last).all():
            break
        last = further
    # After the last admitted hit the entity cools down, unless a marker follows.
    freed = marker[at + 1] < n
    out_until, out_rank = np.where(freed, FREE[0], clock + cool), np.where(freed, FREE[1], rank)
    runs: list[Run] = []
    # No state that enters reaches further than a cooldown from the first row.
    reach = int(np.searchsorted(clock, clock[0] + cool.max()))
    for r in RANKS:
        never_later = min(int(worse[r][0]), int(hit[marker[0]]))
        for k in range(reach + 1):
            goal = min(int(hit[k]), never_later)
            if goal < n:
                end = int(out_until[last[goal]]), int(out_rank[last[goal]])
            else:
                end = FREE if marker[0] < n else (None, None)
            upto = int(clock[k]) if k < min(reach, n) and hit[k] < never_later else FOREVER
            if runs and runs[-1].held == r and runs[-1][2:] == end:
                runs[-1] = Run(r, upto, *end)
            else:
                runs.append(Run(r, upto, *end))
            if upto == FOREVER:
                break
    return runs


def through(runs: list[Run], state: tuple[int, int]) -> tuple[int, int]:
    """The state at the end of a stretch that is entered in ``state``; a free one is admitted as one that has cooled down long ago."""
    until, held = state if state != FREE else (-FOREVER, RANKS[0])
    of_rank = [r for r in runs if r.held == held]
    run = of_rank[bisect_left([r.upto for r in of_rank], until)]
    return state if run.until is None else (run.until, run.rank)


def _follow(table: pa.Table) -> pa.Table:
    """The states in which one entity enters its slices, where it is not free."""
    state, out = None, []
    for r in sorted(table.to_pylist(), key=lambda r: (r["part"], not r["enters"])):
        if not r["enters"]:
            state = r["until"], r["rank"]
            continue
        if state is not None and state != FREE:
            out.append({"part": r["part"], "until0": state[0], "rank0": state[1]})
        state = through([Run(**x) for x in r["runs"]], state or FREE)
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("until0", pa.int64()), ("rank0", pa.int32())]))


def _fold_again(table: pa.Table) -> pa.Table:
    table = table.sort_by("idx")
    columns = {n: table.column(n) for n in table.column_names}
    keep, _ = _fold(columns, [None] * table.num_rows, None, (columns["until0"][0].as_py(), columns["rank0"][0].as_py()))
    return table.select(["rid"]).filter(pa.array(keep))


def entries(slices: DataFrame) -> DataFrame:
    """(part, until0, rank0) of the slices whose first entity comes in cooling down."""
    told = slices.filter("told IS NOT NULL").select("part", "told.*")
    enters = told.select("part", F.lit(True).alias("enters"), "first.*", F.lit(None).cast("long").alias("until"), F.lit(None).cast("int").alias("rank"), "runs")
    leaves = told.filter("first != last").select(
        "part", F.lit(False).alias("enters"), "last.*", "until", "rank", F.lit(None).cast(f"array<{_RUN}>").alias("runs"))
    return enters.unionByName(leaves).groupBy(*ENTITY).applyInArrow(_follow, "part int, until0 long, rank0 int")


def _kept(slices: DataFrame) -> DataFrame:
    """The numbers of the admitted hits."""
    kept = slices.filter("keep")
    cooling = stage(entries(slices), "entries")
    if cooling.isEmpty():
        return kept.select("rid")
    # One row for each slice at most.
    cooling = F.broadcast(cooling)
    again = slices.filter("first").join(cooling, "part").select("part", "rid", "idx", "clock_us", "rank", "cool_us", "ends", "until0", "rank0")
    again = again.groupBy("part").applyInArrow(_fold_again, "rid long")
    settled = kept.join(cooling.withColumn("first", F.lit(True)), ["part", "first"], "left_anti").select("rid")
    return settled.unionByName(again)
