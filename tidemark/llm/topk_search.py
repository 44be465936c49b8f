"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Candidates lie in blocks. A block has a list for each component, sorted by it; a query reads the lists for its components in
step, from the end that is best for the component's sign. What has been read gives each candidate a lower and an upper
bound: components not read yet are at best what the list showed last and at worst the list's other end. A query stops
once few candidates can still reach its k-th best lower bound, in this block or in those before; their final scores are then
resolved, so the result is exact, ties included. Where the lists' ends alone cannot reach it, nothing of the block is read.
All queries of a portion read in step, their bounds are matrix products.

Queries and candidates meet in a grid of tiles. A task holds the queries of a tile with what is best so far, and blocks of
candidates pass by; so its memory grows with neither table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.exchange import lean, short_batches
from tidemark.operators.staging import stage

BLOCK_ROWS = 4096
QUERY_ROWS = 512
#: Bytes of vectors in a row of packed ones. Arrow batches have up to ``exchange.BATCH_ROWS`` such rows.
PACK_BYTES = 1 << 15
#: Components of a block at most, and of the queries that a task holds.
BLOCK_CELLS, QUERY_CELLS = 1 << 20, 1 << 23
#: Pairs of a query and a candidate that are worth a task, and tasks that queries are sent to, if candidates are not many times their number.
TILE_PAIRS, SENT_TO = 1 << 24, 32
#: Parts of the lists that are read between two looks at the bounds.
DEPTHS = (1 / 8, 1 / 4, 1 / 2)
#: Queries that look first, at the last of these depths. Where fewer than a quarter of them stop, the others look at the lists' ends only.
FIRST_ROWS = 16
#: A query stops reading once no more than this many candidates are left for each result wanted.
LEFT_PER_RESULT = 8
EXACT = {np.float32: 2**24, np.float64: 2**53}
LARGEST = 2**63 - 1
NONE = -LARGEST - 1
PACKED = "dim int, n int, asked int, width int, ids binary, vectors binary"
SCHEMA = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("asked", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", times: int = 256) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by ``every`` its k best other rows.

    Components become floor(times * x), x as double; the score is the inner product; ties go to the smaller id. Null ids, null or empty vectors, and vectors
    with a component that is null or not finite, take no part. Whole numbers beyond 64 bits are cut to the nearest that fits: components before they are multiplied, and
    scores before they are ranked. Vectors of different dimensions are not compared. Rows that repeat an id are candidates each, but none is a candidate of a query with the same id;
    a query id is asked once for each distinct vector. An empty table gives an empty result. Other columns are not read.
    """
    short_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    if not isinstance(rows.schema["v"].dataType.elementType, T.FloatType | T.DoubleType):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("v") > 0))
    packs = stage(rows.mapInArrow(lean(_packed(every, times)), PACKED), "vectors")
    n, asked, cells = packs.agg(F.sum("n"), F.sum("asked"), F.sum(F.col("asked").cast("long") * F.col("dim"))).first()
    n, asked, cells = n or 0, asked or 0, cells or 0
    parts = max(1, -(-cells // QUERY_CELLS))
    groups = max(1, min(-(-n * asked // (TILE_PAIRS * parts)), max(SENT_TO, n // max(asked, 1))))
    queries = packs.filter("asked > 0").mapInArrow(lean(_asked(every)), "dim int, id long, v binary").distinct()
    queries = queries.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")).mapInArrow(lean(_together), f"{PACKED}, part int")
    each = lambda name, many: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(name)
    columns = ["dim", "width", "ids", "vectors"]
    queries = queries.select(*columns, F.lit(0).alias("side"), "part", each("group", groups))
    candidates = packs.select(*columns, F.lit(1).alias("side"), F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("group"), each("part", parts))
    tiles = queries.unionByName(candidates).withColumn("tile", F.col("group") * parts + F.col("part")).drop("group", "part")
    tiles = tiles.repartition(groups * parts, "tile").sortWithinPartitions("tile", "dim", "side").select("tile", "side", *columns)
    found = tiles.mapInArrow(lean(_search(k)), "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _whole(v: np.ndarray, times: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = v.astype(np.float64) * times
    fits = np.abs(v) < 2.0**63
    return np.where(fits, np.floor(np.where(fits, v, 0)).astype(np.int64), np.where(v > 0, LARGEST, -LARGEST))


def _packs(dim: int, ids: np.ndarray, x: np.ndarray, every: int = 0) -> Iterator[tuple]:
    """Rows of PACKED, in the fewest bytes that hold all components."""
    big = _largest(x)
    width = 2 if big < 2**15 else 4 if big < 2**31 else 8
    step = max(1, PACK_BYTES // (width * dim))
    x = x.astype(f"<i{width}")
    for at in range(0, len(ids), step):
        some = ids[at:at + step]
        yield dim, len(some), int((some % every == 0).sum()) if every else 0, width, some.astype("<i8").tobytes(), x[at:at + step].tobytes()


def _batch(packs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, p)) for p in packs], SCHEMA)


def _packed(every: int, times: int):
    def run(batches):
        for b in batches:
            ids, v = b.column("id").to_numpy(zero_copy_only=False), b.column("v")
            lengths, flat = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), v.flatten()
            good = flat.is_valid().to_numpy(zero_copy_only=False)
            flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            ok = np.logical_and.reduceat(good & np.isfinite(flat), starts) if len(starts) else np.zeros(0, bool)
            packs = []
            for dim in np.unique(lengths[ok]):
                rows = np.flatnonzero(ok & (lengths == dim))
                packs += _packs(int(dim), ids[rows], _whole(flat[starts[rows][:, None] + np.arange(dim)], times), every)
            yield _batch(packs)

    return run


def _matrix(dim: int, width: int, vectors: bytes) -> np.ndarray:
    return np.frombuffer(vectors, f"<i{width}").reshape(-1, dim)


def _asked(every: int):
    """The queries, one a row, with components of one size, so that equal ones are equal bytes."""

    def run(batches):
        for b in batches:
            for dim, width, ids, vectors in zip(*(b.column(c).to_pylist() for c in ("dim", "width", "ids", "vectors"))):
                ids = np.frombuffer(ids, "<i8")
                own = ids % every == 0
                x = _matrix(dim, width, vectors)[own].astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), dim, np.int32)), pa.array(ids[own]), pa.array([v.tobytes() for v in x], pa.binary())], ["dim", "id", "v"])

    return run


def _together(batches):
    for b in batches:
        dims, parts, ids = (b.column(c).to_numpy() for c in ("dim", "part", "id"))
        vectors, packs, of = b.column("v").to_pylist(), [], []
        for dim, part in sorted({*zip(dims.tolist(), parts.tolist())}):
            rows = np.flatnonzero((dims == dim) & (parts == part))
            packs += _packs(dim, ids[rows], _matrix(dim, 8, b"".join(vectors[i] for i in rows)))
            of += [part] * (len(packs) - len(of))
        yield pa.RecordBatch.from_arrays([*_batch(packs).columns, pa.array(of, pa.int32())], [*SCHEMA.names, "part"])


def _search(k: int):
    """Rows come by tile and dimension, queries first."""

    def run(batches):
        at, queries, waiting, n, best = None, [], [], 0, None

        def pass_by():
            nonlocal best, waiting, n
            if waiting and queries:
                if best is None:
                    best = Best(*joined(queries), k)
                best.block(*joined(waiting))
            waiting, n = [], 0

        for b in batches:
            for tile, side, dim, width, ids, vectors in zip(*(b.column(i).to_pylist() for i in range(6))):
                if at != (tile, dim):
                    pass_by()
                    if best is not None:
                        yield from best.rows()
                    at, queries, best = (tile, dim), [], None
                pack = (np.frombuffer(ids, "<i8"), _matrix(dim, width, vectors))
                if side == 0:
                    queries.append(pack)
                    continue
                waiting.append(pack)
                n += len(pack[0])
                if n >= BLOCK_ROWS or n * dim >= BLOCK_CELLS:
                    pass_by()
        pass_by()
        if best is not None:
            yield from best.rows()

    return run


def joined(packs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([ids for ids, _ in packs]), np.concatenate([x for _, x in packs])


def _largest(v: np.ndarray) -> int:
    """The largest component without its sign."""
    return max(int(v.max(initial=0)), -int(v.min(initial=0)))


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.n = ids, x, len(x)
        self.least, self.most = (v.astype(np.float64) for v in (x.min(axis=0), x.max(axis=0)))
        self.largest = np.maximum(np.abs(self.least), np.abs(self.most))
        self._at: dict = {}

    @cached_property
    def lists(self) -> np.ndarray:
        return np.sort(self.x, axis=0)  # ascending

    def at_most(self, part: float, kind: type) -> np.ndarray:
        """Each component at its best for positive and for negative weights, once this part of the lists is read."""
        if (part, kind) not in self._at:
            x, t = self.read(1, kind), self._rows(part)
            self._at[part, kind] = np.hstack([np.maximum(x, self.lists[self.n - t].astype(kind)), np.minimum(x, self.lists[t - 1].astype(kind))])
        return self._at[part, kind]

    def at_least(self, part: float, kind: type) -> np.ndarray:
        x, t = self.read(1, kind), self._rows(part)
        return np.hstack([
            np.where(x >= self.lists[self.n - t].astype(kind), x, self.least.astype(kind)), np.where(x <= self.lists[t - 1].astype(kind), x, self.most.astype(kind))])

    def read(self, part: float, kind: type) -> np.ndarray:
        """The components themselves, as read to the lists' ends."""
        if (part, kind) not in self._at:
            self._at[part, kind] = self.x.astype(kind)
        return self._at[part, kind]

    def _rows(self, part: float) -> int:
        return max(1, int(np.ceil(self.n * part)))


class Best:
    """Queries of one dimension and the k best candidates for each, of the blocks that have passed by."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        order = np.argsort(q_ids, kind="stable")
        self.q_ids, self.q, self.k = q_ids[order], q[order], k
        self.score = np.full((len(q), k), NONE, np.int64)
        self.ids = np.full((len(q), k), LARGEST, np.int64)

    def block(self, ids: np.ndarray, x: np.ndarray) -> None:
        lists = Lists(ids, x)
        for at in range(0, len(self.q), QUERY_ROWS):
            self._portion(np.arange(at, min(at + QUERY_ROWS, len(self.q))), lists)

    def _portion(self, rows: np.ndarray, lists: Lists) -> None:
        q = self.q[rows].astype(np.float64)
        sums = np.abs(q) @ lists.largest  # bounds every partial sum
        kind = next((f for f, end in EXACT.items() if sums.max() < end), None)
        # Bounds in doubles, widened where they may be rounded.
        wide = 1e-9 * sums if kind is None else np.zeros(len(rows))
        ends = np.maximum(q, 0) @ lists.most + np.minimum(q, 0) @ lists.least + wide
        on = np.minimum(ends, LARGEST) >= self.score[rows, -1].astype(np.float64)
        rows, wide = rows[on], wide[on]
        if len(rows) > FIRST_ROWS and lists.n > 1:
            some = np.arange(len(rows)) < FIRST_ROWS
            first = self._look(rows[some], wide[some], lists, DEPTHS[-1], kind)
            if first.sum() * 4 >= FIRST_ROWS:
                open_ = np.flatnonzero(~some)
                for part in DEPTHS:
                    if len(open_):
                        open_ = open_[~self._look(rows[open_], wide[open_], lists, part, kind)]
                some[:] = False
                some[np.flatnonzero(~first)] = some[open_] = True
            else:
                some = np.concatenate([~first, np.ones(len(rows) - FIRST_ROWS, bool)])
            rows, wide = rows[some], wide[some]
        if len(rows):
            self._look(rows, wide, lists, 1, kind)

    def _look(self, rows: np.ndarray, wide: np.ndarray, lists: Lists, part: float, kind: type | None) -> np.ndarray:
        """Which queries are done with the block once this part of its lists is read; what is best for them is taken over."""
        exact, kind = kind is not None, kind or np.float64
        q = self.q[rows].astype(kind)
        if part < 1:
            q = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
        upper = q @ (lists.at_most if part < 1 else lists.read)(part, kind).T
        own = self._own(rows, lists)
        bar = self.score[rows, -1]
        new, bar = bar == NONE, bar.astype(kind)
        lower = None
        if new.any() and lists.n > self.k:
            lower = q[new] @ lists.at_least(part, kind).T if part < 1 else upper[new]
        if not exact:
            upper = np.clip(upper + wide[:, None], -LARGEST, LARGEST)
            lower = None if lower is None else np.clip(lower - wide[new, None], -LARGEST, LARGEST)
        upper[own] = -np.inf
        if lower is not None:
            lower = lower.copy()
            there = np.cumsum(new) - 1
            mine = new[own[0]]
            lower[there[own[0][mine]], own[1][mine]] = -np.inf
            bar[new] = np.maximum(bar[new], np.partition(lower, lists.n - self.k, axis=1)[:, lists.n - self.k])
        can = upper >= bar[:, None]
        done = np.ones(len(rows), bool) if part == 1 else can.sum(axis=1) <= LEFT_PER_RESULT * self.k
        i, j = np.divmod(np.flatnonzero(can & done[:, None] if part < 1 else can), lists.n)
        if exact and part == 1:
            score = upper[i, j].astype(np.int64)
        elif exact:
            score = np.einsum("ij,ij->i", self.q[rows[i]].astype(np.int64), lists.x[j].astype(np.int64))
        else:
            score = np.array([max(-LARGEST, min(LARGEST, sum(a * b for a, b in zip(self.q[r].tolist(), lists.x[c].tolist())))) for r, c in zip(rows[i], j)], np.int64)
        self._take(rows[i], lists.ids[j], score)
        return done

    def _own(self, rows: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a candidate with the same id."""
        ids = self.q_ids[rows]  # ascending
        a, b = np.searchsorted(ids, lists.ids, "left"), np.searchsorted(ids, lists.ids, "right")
        c = np.flatnonzero(b > a)
        many = (b - a)[c]
        return np.repeat(a[c], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many), np.repeat(c, many)

    def _take(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        last = self.score[rows, -1]
        better = (score > last) | ((score == last) & (ids < self.ids[rows, -1]))
        if not better.any():
            return
        rows, ids, score = rows[better], ids[better], score[better]
        who, at = np.unique(rows, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(who)), self.k), at])
        ids, score = np.concatenate([self.ids[who].ravel(), ids]), np.concatenate([self.score[who].ravel(), score])
        order = np.lexsort((ids, ~score, at))
        best = order[np.searchsorted(at[order], np.arange(len(who)))[:, None] + np.arange(self.k)]
        self.ids[who], self.score[who] = ids[best], score[best]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """(query id, id, score) of what is best."""
        for at in range(0, len(self.q), BLOCK_ROWS):
            some = slice(at, at + BLOCK_ROWS)
            i, j = np.nonzero(self.score[some] != NONE)
            got = (self.q_ids[some][i], self.ids[some][i, j], self.score[some][i, j])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["query_id", "id", "score"])


def search(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query ids, ids, scores) of each query's k best candidates in one block."""
    best = Best(q_ids, q, k)
    best.block(ids, x)
    return [np.concatenate([b.column(c).to_numpy() for b in best.rows()]) if len(q) else np.zeros(0, np.int64) for c in range(3)]
