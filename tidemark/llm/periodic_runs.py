"""Periodic run detection: descending-LCP Kruskal over the word suffixes of each document.

Suffixes are ranked by prefix doubling, many documents at a time; the ranks of every level also give the longest common
prefix (LCP) of neighbours in suffix order. Neighbours are then united in classes by decreasing LCP, and each class keeps its
positions in order. Two positions i < j that become adjacent in a class when it is made at LCP l agree in exactly l words. If
their distance p is at most l, the l + p words from i on have period p, and no smaller one: a smaller period would have put a position of
the same class between them before. So each run is seeded once for each of its starts and kept for the first.

Classes below the smallest LCP that a run can have are never made, so positions whose start repeats nowhere take no part.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words that are worked on at a time; a longer document is worked on alone and whole.
BATCH_WORDS = 1 << 16

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, ``n_words``, its maximal ``runs`` and the ``collapsed`` text.

    Words are separated by the ASCII blanks. A run is a stretch of words of smallest period p and of at least
    ``max(least, times * p)`` words (``times`` at least 2) that no neighbouring word extends; runs come by start, then period, and may
    overlap. ``collapsed`` joins by one space the words that lie in no run after its first period. A null text has no words. Rows are judged one by one, so
    repeated rows and null ids stay as they are; an empty table gives none; other columns are not looked at. Nothing is shuffled.
    """
    if times < 2 or least < 2:
        raise ValueError("a run repeats at least twice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for first, words in _portions(texts):
                found = runs_of(words, least, times)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(words)), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found], _RUNS),
                    pa.array([_collapsed(w, rs) for w, rs in zip(words, found)], pa.binary()).cast(pa.string()),
                ], ["doc_id", "n_words", "runs", "collapsed"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, runs {RUNS}, collapsed string")


def _portions(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each row) of runs of rows."""
    first, held, n = 0, [], 0
    for i, text in enumerate(texts):
        words = (text.as_py() or b"").split()
        if held and n + len(words) > BATCH_WORDS:
            yield first, held
            first, held, n = i, [], 0
        held.append(words)
        n += len(words)
    if held:
        yield first, held


def runs_of(docs: list[list[bytes]], least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start, then period."""
    ids, ends, starts, n_ids = [], [], [], 0
    for words in docs:
        code = dict.fromkeys(words)
        for n, w in enumerate(code):
            code[w] = n_ids + n
        n_ids += len(code)
        starts.append(len(ids))
        ids += map(code.__getitem__, words)
        ends.append(len(ids))
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    if not ids:
        return out
    symbols = np.array(ids, np.int64)
    sizes = np.array(ends) - np.array(starts)
    left = np.repeat(np.array(ends), sizes) - np.arange(len(symbols))  # words from here to the document's end
    lowest = min(max(least, times * p) - p for p in range(1, least + 1))
    order, lcp = suffix_order(symbols, left, lowest)
    if len(order):
        found = [
            (i, size, p) for i, size, p in _seeds(order, lcp, least, times, lowest)
            if left[i - 1] == 1 or i == 0 or symbols[i - 1] != symbols[i + p - 1]
        ]
        where = np.searchsorted(np.array(ends), [i for i, _, _ in found], side="right")
        for d, (i, size, p) in zip(where.tolist(), found):
            out[d].append((i - starts[d], size, p))
    return [sorted(rs, key=lambda r: (r[0], r[2])) for rs in out]


def suffix_order(symbols: np.ndarray, left: np.ndarray, lowest: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that share a prefix with another of their document, in suffix order, and the LCP of each with the next.

    A rank is the place in that order of the first suffix with the same prefix, of 1, 2, 4, ... words by level. A suffix whose rank is
    its own keeps it. Suffixes that are alone at the last level not above ``lowest`` are left out. Symbols differ between documents.
    """
    n = len(symbols)
    counts = np.bincount(symbols)
    rank = (np.cumsum(counts) - counts)[symbols]
    levels = [rank.astype(np.int32)]
    active = np.flatnonzero(counts[symbols] > 1)
    step, chosen = 1, active
    while len(active):
        beyond = left[active] > step
        second = np.zeros(len(active), np.int64)
        second[beyond] = rank[active[beyond] + step] + 1
        key = rank[active] * np.int64(n + 1) + second
        by = np.argsort(key, kind="stable")
        key, active = key[by], active[by]
        old = key // (n + 1)
        new_class = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        old_class = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        sizes = np.diff(np.r_[new_class, len(key)])
        place = old + np.arange(len(key)) - np.repeat(old_class, np.diff(np.r_[old_class, len(key)]))
        rank = rank.copy()
        rank[active] = np.repeat(place[new_class], sizes)
        levels.append(rank.astype(np.int32))
        active = active[np.repeat(sizes, sizes) > 1]
        step *= 2
        if step <= lowest:
            chosen = active
    order = chosen[np.argsort(rank[chosen], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(len(order) - 1, 0), np.int64)
    rest = np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        same = lcp < rest
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        for x in (a, b, lcp):
            x[same] += 1 << k
    return order, lcp


def _seeds(order: np.ndarray, lcp: np.ndarray, least: int, times: int, lowest: int) -> Iterator[tuple[int, int, int]]:
    """(position, length, period) wherever two positions become adjacent in a class and repeat often enough."""
    edges = np.flatnonzero(lcp >= lowest)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    members: dict[int, list[int]] = {}
    parent = list(range(len(order)))
    places = order.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for e, shared in zip(edges.tolist(), lcp[edges].tolist()):
        x, y = root(e), root(e + 1)
        few, many = members.pop(x, None) or [places[x]], members.pop(y, None) or [places[y]]
        if len(few) > len(many):
            few, many, x, y = many, few, y, x
        parent[x] = y
        members[y] = many
        added = -1  # the newest place that came from the smaller class
        for n, at in enumerate(few):
            spot = bisect_left(many, at)
            for p, i in (
                (at - many[spot - 1], many[spot - 1]) if spot and many[spot - 1] != added else (0, 0),
                (many[spot] - at, at) if spot < len(many) and (n + 1 == len(few) or few[n + 1] > many[spot]) else (0, 0),
            ):
                if p and shared + p >= max(least, times * p):
                    yield i, shared + p, p
            many.insert(spot, at)
            added = at


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        gone = np.cumsum(depth) > 0
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return b" ".join(words)
