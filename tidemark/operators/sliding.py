"""Statistics of sliding windows over sorted rows, in one pass over Arrow batches.

A window reaches back from a row to the oldest row that the window's span, the cap and the key's last start allow. What rules want of it
is its size, its oldest time, mean and deviation of the values before the newest, and the run of values past a bound that leads up to the row. None of this needs
the window as a list:

* Times become steps from row to row, cut where a span is exceeded and at a new key, so that one binary search finds all starts.
* Moments are merged, never subtracted, as with two stacks: a window of several rows contains a place where blocks of some power of two meet, and is the part
  that was summed up backwards from there and the part summed up forwards. All windows of a batch are worked on at once.
* Only where the newest value may be far enough off, mean and deviation are added up again in order, as the one-event-at-a-time hosts do.
* A run starts behind the last row that is not past the bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.operators.keyed_window import Geometry

IDS = 12  # fixed value: the most event ids any alert carries

NEAR = 1e-6  # by how much of a limit a value may miss it and still be looked at again

RUN = "struct<from_us:long,n:int>"
#: What a frame says about its window; ``base`` is the window without its newest point.
SUMMARY = f"points int, oldest_us long, newest_us long, base_n int, base_mean double, base_sd double, runs array<{RUN}>, last_ids array<string>"
STATISTICS = "mean double, stddev double, retained long"
_RUNS = pa.list_(pa.struct([("from_us", pa.int64()), ("n", pa.int32())]))


def moments(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each ``values[lo:hi]``; 0 where there is nothing."""
    n = hi - lo
    mean, m2 = np.zeros(len(n)), np.zeros(len(n))
    mean[n == 1] = values[lo[n == 1]]
    many = np.flatnonzero(n > 1)
    first, last = lo[many], hi[many] - 1
    level = np.frexp((first ^ last).astype(np.float64))[1] - 1
    for k in np.unique(level):
        rows = level == k
        mid = last[rows] >> k << k
        n_left, n_right = mid - first[rows], last[rows] - mid + 1
        left_mean, left_m2 = _summed_up(values, mid - 1, n_left, -1)
        right_mean, right_m2 = _summed_up(values, mid, n_right, 1)
        total, apart = n_left + n_right, right_mean - left_mean
        mean[many[rows]] = left_mean + apart * n_right / total
        m2[many[rows]] = left_m2 + right_m2 + apart * apart * n_left * n_right / total
    return mean, np.sqrt(np.divide(m2, n, out=np.zeros(len(n)), where=n > 0))


def _summed_up(values: np.ndarray, start: np.ndarray, size: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and second central moment of ``size`` values from ``start`` on, forwards or backwards; equal starts are summed up once."""
    starts, which = np.unique(start, return_inverse=True)
    steps = int(size.max())
    means, m2s = np.empty((steps, len(starts))), np.empty((steps, len(starts)))
    mean, m2 = np.zeros(len(starts)), np.zeros(len(starts))
    for s in range(steps):
        x = values[np.clip(starts + way * s, 0, len(values) - 1)]
        off = x - mean
        mean = mean + off / (s + 1)
        m2 = m2 + off * (x - mean)
        means[s], m2s[s] = mean, m2
    return means[size - 1, which], m2s[size - 1, which]


def in_order(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``moments``, by two passes over each window, added up from the oldest value on."""
    n = hi - lo
    mean, m2 = np.zeros(len(n)), np.zeros(len(n))
    for s in range(int(n.max(initial=0))):
        mean += np.where(s < n, values[np.minimum(lo + s, len(values) - 1)], 0.0)
    mean = np.divide(mean, n, out=np.zeros(len(n)), where=n > 0)
    for s in range(int(n.max(initial=0))):
        off = np.where(s < n, values[np.minimum(lo + s, len(values) - 1)] - mean, 0.0)
        m2 += off * off
    return mean, np.sqrt(np.divide(m2, n, out=np.zeros(len(n)), where=n > 0))


@dataclass(frozen=True)
class Windows:
    """The pass, by stream. Rows come by key and block, then time, with ``n`` (their number there), ``first_n`` (where the key last started),
    ``stream``, ``id``, ``at_us`` and ``value``; rows of a block before the first one that counts are context."""

    geometry: Mapping[str, Geometry]
    statistics: bool = False

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = max(g.cap for g in self.geometry.values())
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            slim = pa.Table.from_batches([batch]).select(["stream", "id", "at_us", "value", "n", "first_n"])
            before = 0 if held is None else held.num_rows
            seen = slim if held is None else pa.concat_tables([held, slim])
            added = self._summary(seen.combine_chunks(), before)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])
            held = seen.slice(max(0, seen.num_rows - keep))

    def _summary(self, rows: pa.Table, before: int) -> dict[str, pa.Array]:
        names = list(self.geometry)
        of = pc.index_in(rows["stream"], value_set=pa.array(names)).to_numpy()
        by = lambda value: np.array([value(g) for g in self.geometry.values()], np.int64)[of]
        at, values, n = rows["at_us"].to_numpy(), rows["value"].to_numpy(), rows["n"].to_numpy()
        first_n = pc.fill_null(rows["first_n"], 1).to_numpy()
        place = np.arange(len(at))
        size, cap = by(lambda g: g.size), by(lambda g: g.cap)
        # Steps in time, no longer than any span: what lies behind a longer one is out of reach, as is another key.
        reach = max(g.size + g.grace for g in self.geometry.values()) + 1
        steps = np.minimum(np.diff(at, prepend=at[0]), reach)
        steps[n == 1] = reach
        clock = np.cumsum(steps)
        floor = np.maximum(np.maximum(place - (n - first_n), place - cap + 1), 0)
        lo = np.maximum(np.searchsorted(clock, clock - size), floor)
        mine = slice(before, None)
        out = {
            "points": pa.array((place - lo + 1)[mine], pa.int32()), "oldest_us": pa.array(at[lo][mine], pa.int64()),
            "newest_us": pa.array(at[mine], pa.int64()), **self._base(values, lo, place, of, before),
            "runs": self._runs(values, at, lo, place, of, before), "last_ids": self._ids(rows["id"], lo, place, before),
        }
        if self.statistics:
            mean, sd = moments(values, lo[mine], place[mine] + 1)
            retained = place - np.maximum(np.searchsorted(clock, clock - size - by(lambda g: g.grace)), floor) + 1
            out |= {"mean": pa.array(mean), "stddev": pa.array(sd), "retained": pa.array(retained[mine], pa.int64())}
        return out

    def _base(self, values: np.ndarray, lo: np.ndarray, place: np.ndarray, of: np.ndarray, before: int) -> dict[str, pa.Array]:
        """Of the points before the newest, where a rule asks for that many."""
        least = np.array([-1 if g.samples is None else g.samples for g in self.geometry.values()])[of[before:]]
        n = (place - lo)[before:]
        asked = (least >= 0) & (n >= np.maximum(least, 1))
        mean, sd = np.zeros(len(n)), np.zeros(len(n))
        mean[asked], sd[asked] = moments(values, lo[before:][asked], place[before:][asked])
        # Merging rounds in another order than adding up does. Where the value may be far enough off, the numbers are those of adding up.
        k = np.array([g.k for g in self.geometry.values()])[of[before:]]
        far = asked & (np.abs(values[before:] - mean) >= k * sd * (1 - NEAR))
        mean[far], sd[far] = in_order(values, lo[before:][far], place[before:][far])
        return {"base_n": pa.array(n, pa.int32()), "base_mean": pa.array(mean, mask=~asked), "base_sd": pa.array(sd, mask=~asked)}

    def _runs(self, values: np.ndarray, at: np.ndarray, lo: np.ndarray, place: np.ndarray, of: np.ndarray, before: int) -> pa.Array:
        """For each bound of the stream the stretch of values past it, up to the newest, which is not tested itself."""
        bounds = [g.bounds for g in self.geometry.values()]
        most = max(map(len, bounds))
        starts = np.empty((most, len(at) - before), np.int64)
        for k in range(most):
            bound = np.array([b[k][0] if k < len(b) else 0.0 for b in bounds])[of]
            above = np.array([b[k][1] if k < len(b) else True for b in bounds])[of]
            island = np.maximum.accumulate(np.where(np.where(above, values > bound, values < bound), -1, place))
            starts[k] = np.maximum(lo, np.concatenate([[0], island[:-1] + 1]))[before:]
        n = np.array([len(b) for b in bounds])[of[before:]]
        offsets = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(len(n)), n)
        start = starts[np.arange(len(row)) - offsets[row], row] if most else row
        runs = pa.StructArray.from_arrays(
            [pa.array(at[start], pa.int64()), pa.array(place[before:][row] - start + 1, pa.int32())], ["from_us", "n"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs).cast(_RUNS)

    @staticmethod
    def _ids(ids: pa.ChunkedArray, lo: np.ndarray, place: np.ndarray, before: int) -> pa.Array:
        start = np.maximum(lo, place - IDS + 1)[before:]
        n = place[before:] - start + 1
        offsets = np.concatenate([[0], np.cumsum(n)])
        taken = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, n)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids.combine_chunks().take(pa.array(taken)))
