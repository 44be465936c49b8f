"""Suffix-array dedup: removes bytes of strings of ``length`` bytes that also start in an earlier document.

The suffixes of the corpus are sorted by a distributed merge sort that is aware of common prefixes:

1. Documents are dealt to chunks. Of each window of suffixes the one with the least gram hash is its anchor, so that
   equal strings have equal anchors; only anchors are sorted (about one suffix in sixteen).
2. As in prefix doubling, hashes of the anchors' first bytes are exchanged first: an anchor whose gram occurs in one
   document alone cannot belong to a repeat, and goes no further.
3. The other anchors of a chunk form a sorted run, front-coded: a suffix is stored from its first byte that differs from
   the one before, and so is the text to its left.
4. Runs meet by gram. A loser tree merges them; it holds with each suffix the prefix it is known to share with the
   last winner and compares only beyond it. Equal contexts of a chunk enter the run once.
5. In merged order all suffixes with a common prefix are neighbours. For each offset of the anchor in a string, neighbours
   that share the rest to the right and the bytes to the left hold the same string; the smallest id keeps it.

A chunk and what it is told meet by chunk number, so no list is ever held for the whole corpus. Everything is derived
again from the documents if an executor is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.exchange import lean_cogroup, lean_group, n_buckets
from tidemark.llm.textbytes import BYTE_CODES, mix, powers, text_slices

CHUNK_BYTES = 8 << 20
GRAM = 20
LAST = np.iinfo(np.int64).max
FLAG = np.dtype([("group", "<u4"), ("mask", "<u8")])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept, carried) for each row of ``docs``.

    Texts are UTF-8 bytes, whole; null is empty; matches never cross rows. A byte goes if a string of ``length`` bytes over
    it also starts in a row with a smaller id, judged on the input. Rows of one id do not remove each other's text; a
    row with a null id comes after all others. kept holds the bytes that stay; ``as_text``, as a text, without what a cut leaves of a
    character. An empty table gives an empty result.
    carried is a struct of the columns named in ``carry``; others are not read. ``length`` lies between 28 and 83.
    """
    if not GRAM + 8 <= length <= GRAM + 63:
        raise ValueError(f"length must lie between {GRAM + 8} and {GRAM + 63}")
    carried = F.struct(F.lit(True).alias("row"), *(F.col(c) for c in carry)).alias("carried")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), carried)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    source = source.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    buckets = n_buckets(docs)

    grams = source.groupBy("chunk").applyInArrow(lean_group(_grams(length, buckets)), "bucket int, chunk int, data binary")
    told = grams.groupBy("bucket").applyInArrow(lean_group(_repeated), "chunk int, bucket int, data binary")
    runs = source.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lean_cogroup(_runs(length, buckets)), "bucket int, chunk int, data binary")
    flags = runs.groupBy("bucket").applyInArrow(lean_group(_merged(length)), "chunk int, data binary")
    schema = StructType.fromDDL("id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept " + ("string" if as_text else "binary")).add(source.schema["carried"])
    return source.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(lean_cogroup(_removed(length, as_text)), schema).withColumnRenamed("id", id_col)


class _Chunk:
    """The rows of a chunk in a fixed order, and its anchors, grouped by equal surroundings."""

    def __init__(self, table: pa.Table, length: int):
        ids = table.column("id").cast(pa.int64())
        rank = ids.fill_null(LAST).to_numpy()
        texts = table.column("text").cast(pa.large_string()).fill_null("").combine_chunks()
        order = np.array(sorted(range(len(rank)), key=lambda i: (rank[i], texts[i].as_py())) if _tied(rank) else np.argsort(rank), dtype=np.int64)
        self.order = order
        self.ids, self.rank, texts = ids.take(pa.array(order)), rank[order], texts.take(pa.array(order))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        # the bytes of all rows, as they lie in the array
        _, self.buf, self.offsets = next(text_slices(texts, 1 << 62), (0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        place = np.int32 if len(self.buf) < 1 << 30 else np.int64
        parts, base = [[np.zeros(0, t)] for t in (place,) * 3 + (np.uint64,) * 2], 0
        for _, b, o in text_slices(texts):
            at, p0, p1, gram, seen = _anchors(b, o, length)
            for part, x in zip(parts, ((at + base).astype(place), (p0 + base).astype(place), (p1 + base).astype(place), gram, seen)):
                part.append(x)
            base += len(b)
        for i, part in enumerate(parts):  # one column at a time is held twice
            parts[i] = np.concatenate(part)
            part.clear()
        self.at, self.p0, self.p1, self.gram, seen = parts
        del parts
        self.row = np.empty(len(self.at), place)
        for lo in range(0, len(self.at), 1 << 16):
            self.row[lo: lo + (1 << 16)] = np.searchsorted(self.offsets, self.at[lo: lo + (1 << 16)], side="right") - 1
        self.first, self.group = _classes(seen)
        self.least = np.full(len(self.first), LAST)
        np.minimum.at(self.least, self.group, self.rank[self.row])


def _classes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What numpy.unique says of the first place and the class of each value, in less room."""
    place = np.int32 if len(values) < 1 << 30 else np.int64
    order = np.argsort(values, kind="stable").astype(place)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    group = np.empty(len(values), place)
    group[order] = np.cumsum(new, dtype=place) - place(1)
    return order[new], group


def _tied(rank: np.ndarray) -> bool:
    return len(np.unique(rank)) < len(rank)


def _anchors(buf: np.ndarray, offsets: np.ndarray, length: int):
    """Anchor, first and last start of the strings it stands for, gram hash, and a hash of those strings' bytes."""
    width, last = length - GRAM + 1, len(buf) - GRAM + 1
    starts, lengths = offsets[:-1], np.diff(offsets)
    if last < width or not (lengths >= length).any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODES[buf] * up[: len(buf)], out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * down[:last]
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(last, dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: -(width - step)], least[width - step:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fits = lengths >= length
    steps = np.zeros(len(buf) + 1, np.int8)
    np.add.at(steps, starts[fits], 1)
    np.add.at(steps, starts[fits] + lengths[fits] - length + 1, -1)
    valid = np.cumsum(steps[: len(at)], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
    new[starts[fits]] = True
    p0 = np.flatnonzero(new)
    ends = np.append(p0[1:], len(at))
    p1 = np.minimum(ends, (starts + lengths - length + 1)[np.searchsorted(offsets, p0, side="right") - 1]) - 1
    a = at[p0]
    seen = mix((sums[p1 + length] - sums[p0]) * down[p0] + (a - p0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (p1 - p0).astype(np.uint64))
    return a, p0, p1, mix(grams[a]), seen


def _chunk_grams(c: _Chunk, buckets: int):
    """Distinct 47-bit gram hashes of a chunk in a fixed order, their buckets, whether several ids hold them."""
    short = c.gram >> np.uint64(17)
    first, inverse = _classes(short)
    grams = short[first]
    del short
    low, high = np.full(len(grams), LAST), np.full(len(grams), np.iinfo(np.int64).min)
    rank = c.rank[c.row]
    np.minimum.at(low, inverse, rank)
    np.maximum.at(high, inverse, rank)
    return grams, (mix(grams) % np.uint64(buckets)).astype(np.int32), low < high, inverse


def _six(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _per_bucket(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def _table(names: list[str], rows: list[tuple]) -> pa.Table:
    kinds = {"data": pa.binary(), "chunk": pa.int32(), "bucket": pa.int32()}
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(list(c), kinds[n]) for n, c in zip(names, columns)})


def _grams(length: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        c = _Chunk(table, length)
        chunk = table.column("chunk")[0].as_py()
        grams, bucket, several, _ = _chunk_grams(c, buckets)
        sent = grams * np.uint64(2) + several.astype(np.uint64)
        return _table(["bucket", "chunk", "data"], [(b, chunk, _six(sent[part])) for b, part in _per_bucket(bucket)])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For each chunk, a bit for each of its grams: another document has it too."""
    chunks, lists = table.column("chunk").to_pylist(), [_unsix(x) for x in table.column("data").to_pylist()]
    sizes = np.array([len(x) for x in lists])
    sent = np.concatenate(lists)
    _, inverse, counts = np.unique(sent >> np.uint64(1), return_inverse=True, return_counts=True)
    hit = (counts[inverse] > 1) | ((sent & np.uint64(1)) > 0)
    bucket = table.column("bucket")[0].as_py()
    ends = np.cumsum(sizes)
    rows = [(k, bucket, np.packbits(hit[e - n: e]).tobytes()) for k, n, e in zip(chunks, sizes, ends) if hit[e - n: e].any()]
    return _table(["chunk", "bucket", "data"], rows)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each pair of rows."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _runs(length: int, buckets: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _table(["bucket", "chunk", "data"], [])
        c = _Chunk(docs, length)
        grams, bucket, _, inverse = _chunk_grams(c, buckets)
        bits = dict(zip(told.column("bucket").to_pylist(), told.column("data").to_pylist()))
        hit = np.zeros(len(grams), dtype=bool)
        for b, part in _per_bucket(bucket):
            if b in bits:
                hit[part] = np.unpackbits(np.frombuffer(bits[b], np.uint8))[: len(part)]
        groups = np.flatnonzero(hit[inverse[c.first]])
        one = c.first[groups]
        right, left = _surroundings(c, one, length)
        order = np.lexsort(np.vstack([right.view(">u8")[:, i] for i in range(right.shape[1] // 8)][::-1]))
        of = bucket[inverse[one]]
        chunk, rows = docs.column("chunk")[0].as_py(), []
        for b, part in _per_bucket(of[order]):
            i = order[part]
            rows.append((b, chunk, _encoded(right[i, :length], left[i], c.least[groups[i]], groups[i], (c.at - c.p1)[one[i]], (c.at - c.p0)[one[i]])))
        return _table(["bucket", "chunk", "data"], rows)

    return run


def _surroundings(c: _Chunk, one: np.ndarray, length: int):
    """Bytes from the anchor on (padded to whole 8 bytes), and those before it, nearest first; zero where not asked for."""
    reach = length - GRAM
    padded = np.concatenate([np.zeros(reach, np.uint8), c.buf, np.zeros(length + 8, np.uint8)])
    at = c.at[one] + reach
    wide = -(-length // 8) * 8
    right, left = np.zeros((len(at), wide), np.uint8), np.zeros((len(at), reach), np.uint8)
    for lo in range(0, len(at), 1 << 14):  # the numbers of the bytes take eight times the room of the bytes
        part = slice(lo, lo + (1 << 14))
        right[part] = padded[at[part, None] + np.arange(wide)]
        left[part] = padded[at[part, None] - 1 - np.arange(reach)]
    right[np.arange(wide)[None, :] >= (c.p1[one] + length - c.at[one])[:, None]] = 0
    left[np.arange(reach)[None, :] >= (c.at[one] - c.p0[one])[:, None]] = 0
    return right, left


HEAD = np.dtype([("rank", "<i8"), ("group", "<u4"), ("low", "u1"), ("high", "u1"), ("lcp", "u1"), ("lcs", "u1")])


def _encoded(right, left, rank, group, low, high) -> bytes:
    """A front-coded run: count, heads, then of each row the bytes that are not shared with the row before."""
    head = np.zeros(len(right), HEAD)
    head["rank"], head["group"], head["low"], head["high"] = rank, group, low, high
    head["lcp"][1:], head["lcs"][1:] = _common(right[1:], right[:-1]), _common(left[1:], left[:-1])
    r = right[np.arange(right.shape[1])[None, :] >= head["lcp"][:, None]]
    s = left[np.arange(left.shape[1])[None, :] >= head["lcs"][:, None]]
    return np.uint32(len(right)).tobytes() + head.tobytes() + r.tobytes() + s.tobytes()


def _decoded(data: bytes, length: int):
    n = int(np.frombuffer(data, "<u4", 1)[0])
    head = np.frombuffer(data, HEAD, n, 4)
    at, sides = 4 + n * HEAD.itemsize, []
    for shared, width in ((head["lcp"], length), (head["lcs"], length - GRAM)):
        fresh = np.arange(width)[None, :] >= shared[:, None]
        out = np.zeros((n, width), np.uint8)
        out[fresh] = np.frombuffer(data, np.uint8, int(fresh.sum()), at)
        at += int(fresh.sum())
        for i in range(1, n):
            k = shared[i]
            if k:
                out[i, :k] = out[i - 1, :k]
        sides.append(out)
    return head, *sides


def loser_tree(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs of (strings, prefix shared with the string before): the run of each output and its shared prefix.

    Each contestant carries the prefix that it shares with the last winner. The longer one wins unseen; only on a tie are
    bytes compared, from there on, and the loser keeps what it shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known = [0 if h is not None else -1 for h in head]
    losers = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether a goes before b; leaves with the loser what both share."""
        p, q = known[a], known[b]
        if p != q:
            return p > q
        if p < 0:
            return True
        x, y = head[a], head[b]
        end = len(x)
        while p < end and x[p] == y[p]:
            p += 1
        if p == end or x[p] < y[p]:
            known[b] = p
            return True
        known[a] = p
        return False

    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winners[1] if k > 1 else 0
    out, shared = [], []
    while head[top] is not None:
        out.append(top)
        shared.append(known[top])
        strings, prefixes = runs[top]
        place[top] += 1
        if place[top] < len(strings):
            head[top], known[top] = strings[place[top]], prefixes[place[top]]
        else:
            head[top], known[top] = None, -1
        node = (top + k) // 2
        while node:
            other = losers[node]
            if not beats(top, other):
                losers[node], top = top, other
            node //= 2
    return out, shared


def _merged(length: int):
    def run(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        parts = [_decoded(x, length) for x in table.column("data").to_pylist()]
        runs = []
        for head, right, _ in parts:
            raw = right.tobytes()
            runs.append(([raw[i: i + length] for i in range(0, len(raw), length)], head["lcp"].tolist()))
        order, shared = loser_tree(runs)
        sizes = [len(h) for h, _, _ in parts]
        base = np.concatenate([[0], np.cumsum(sizes)])
        of = np.array(order, np.int64)
        # the i-th output of a run is its i-th row
        at = np.empty(len(of), np.int64)
        by_run = np.argsort(of, kind="stable")
        at[by_run] = np.arange(base[-1])
        head = np.concatenate([h for h, _, _ in parts])[at]
        left = np.concatenate([s for _, _, s in parts])[at].astype(np.uint64)
        shared = np.array(shared, np.int64)
        rank, low, high = head["rank"], head["low"].astype(np.int64), head["high"].astype(np.int64)
        mask, before = np.zeros(len(of), np.uint64), np.zeros(len(of), np.uint64)
        for l in range(length - GRAM + 1):
            if l:
                before = mix(before * np.uint64(257) + left[:, l - 1] + np.uint64(l))
            some = np.flatnonzero((low <= l) & (l <= high))
            if not len(some):
                continue
            same = np.cumsum(shared < length - l)[some].astype(np.uint64)
            key = mix(same * np.uint64(0x9E3779B97F4A7C15) + before[some])
            _, inverse = np.unique(key, return_inverse=True)
            least = np.full(inverse.max() + 1, LAST)
            np.minimum.at(least, inverse, rank[some])
            mask[some[rank[some] > least[inverse]]] |= np.uint64(1 << l)
        rows = []
        for run_no, part in _per_bucket(of.astype(np.int32)):
            part = part[mask[part] > 0]
            if len(part):
                flags = np.zeros(len(part), FLAG)
                flags["group"], flags["mask"] = head["group"][part], mask[part]
                rows.append((chunks[run_no], flags.tobytes()))
        return _table(["chunk", "data"], rows)

    return run


def _removed(length: int, as_text: bool = False):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _result(docs, np.zeros(0, np.int64), [], as_text)
        order, buf, offsets, gone = _marked(docs, told, length)
        rows = []
        for i in range(len(order)):
            a, b = offsets[i], offsets[i + 1]
            g = gone[a:b]
            spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if b > a else 0
            kept = buf[a:b][~g].tobytes()
            rows.append((int(b - a), int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if as_text else kept))
        return _result(docs, order, rows, as_text)

    return run


def _marked(docs: pa.Table, told: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, bytes and offsets of the rows of a chunk, and which bytes go; its anchors are forgotten."""
    c = _Chunk(docs, length)
    group_mask = np.zeros(len(c.first), np.uint64)
    for data in told.column("data").to_pylist():
        flags = np.frombuffer(data, FLAG)
        group_mask[flags["group"]] |= flags["mask"]
    mask = group_mask[c.group]
    mask[c.rank[c.row] > c.least[c.group]] = np.uint64(2**64 - 1)
    del group_mask, c.gram, c.row, c.first, c.group, c.least
    steps = np.zeros(len(c.buf) + 1, np.int8)  # a byte lies in ``length`` strings at most, which is under 84
    for l in range(length - GRAM + 1):
        p = c.at - l
        p = p[((mask >> np.uint64(l)) & np.uint64(1) > 0) & (p >= c.p0) & (p <= c.p1)]
        steps[p] += 1  # the starts of one offset are distinct
        steps[p + length] -= 1
    np.cumsum(steps, out=steps)
    return c.order, c.buf, c.offsets, steps[:-1] > 0


def _result(docs: pa.Table, order: np.ndarray, rows: list[tuple], as_text: bool) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary())
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    same = docs.select(["id", "carried"]).take(pa.array(order))
    out = {"id": same.column("id").cast(pa.int64())} | {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, kinds))}
    return pa.table(out | {"carried": same.column("carried")})
