"""N-gram Jaccard join: tiles of bounded size, bitmap bounds, exact intersections.

Two documents link when their sets of k-word shingles reach the Jaccard threshold. Every link between different sets
is found, except where both ends are already known to be in one component; what is returned are components.

1. A count sketch over all shingles gives each a level of frequency. It only fixes an order in which shingles are taken,
   rare ones first and the same for all documents, so it cannot change a result.
2. Each set keeps its first ``n - ceil(t * n) + 1`` shingles in that order. Sets that link share one of these.
3. The kept shingles give groups; groups with the same smallest member are joined, so that a family of copies meets once
   and not once for each shingle it shares.
4. A group of up to TILE_ROWS sets is one tile. A larger one is cut by size and then by hash into blocks of about that many,
   however many tasks there are. Tiles are first all blocks alone; their links are contracted, and then come pairs of blocks of
   compatible sizes that still hold several components.
5. In a tile, bitmaps of hashed shingles bound each overlap from above: a bit that only one side has is an element that
   the other lacks. Only sets that can reach the threshold with another one are sent whole, to the same tile; there pairs
   not in one component yet are intersected exactly. A tile tells one link for each set it has joined to another, not its pairs.

Equal sets are one class from the start, whatever their number. The number of shuffle partitions grows with the shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.exchange import PACKED, by_bucket, lean, n_buckets, packed, short_batches, small_or_shuffled, unpacked
from tidemark.llm.textbytes import mix, shingle_sets
from tidemark.operators.staging import stage

SKETCH_BITS = 22
SKETCH_SLOT = 1 << 14
#: Sets of a block, about, and shingles that they have together.
TILE_ROWS = 1024
TILE_SHINGLES = 1 << 18
BLOCK_ROWS = 128
#: Kept shingles that a task sorts at once, about.
TASK_GRAMS = 1_000_000
#: Kept shingles that are dealt at once, about.
SENT_GRAMS = 100_000

GRAM = np.dtype([("gram", "<u4"), ("n", "<u4"), ("key", "<i8")])
LINKS = "a binary, b binary"
NEAR = "gram long, i long, j long, right boolean, label binary, key long"


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100, keyed: bool = False) -> DataFrame:
    """(id, n_shingles, class_id, component_id) for each row of ``docs``.

    Words are runs of other than ASCII white space, A-Z lower-cased. A text of fewer than k words is one shingle; a null
    or wordless text has none and links with nothing (its component is its own id). Rows with equal sets are one class;
    repeated rows, ties and rows with a null id are kept, a null id never becomes a component id unless there is no
    other. class_id is the smallest id with the same set. An empty table gives an empty result. Other columns of
    ``docs`` are not read. Texts are read whole.

    With ``keyed`` there are two more columns: text_key, a hash of the text, and component, which is one value in all rows of a
    component and in no other row, whatever their ids (null for a text without shingles).
    """
    short_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("text_key", F.xxhash64("text"))
    levels = _levels(source, k)
    table = stage(source.mapInArrow(lean(_profiler(k, num, den, levels)), "id long, text_key long, n long, cid binary, key long, bits binary, prefix binary"), "sets")

    grams = table.agg(F.sum("n")).first()[0] or 0
    buckets = max(n_buckets(table), -(-grams * (den - num) // (den * TASK_GRAMS)))

    groups = stage(_groups_of(table, buckets, num, den), "groups")
    sets = stage(table.join(groups.select("key").distinct(), "key", "left_semi").select("key", "cid", "n", "bits").dropDuplicates(["key"]), "distinct")
    bands = _bands(groups, num, den)

    def linked(tiles: DataFrame) -> DataFrame:
        columns = ("gram", "i", "j", "right", "label")
        near = _dealt(tiles, buckets, *columns, "key", "n", "bits").mapInArrow(lean(_near(num, den)), NEAR)
        near = stage(near, "near")
        items = _items(source, table, near, k)
        return stage(_dealt(near.join(items, "key"), buckets, *columns, "items").mapInArrow(lean(_links(num, den)), LINKS), "links")

    nodes = stage(components(linked(_tiles(groups, bands, num, den).join(sets.withColumn("label", F.col("cid")), "key"))), "nodes")
    if not bands.isEmpty():
        more = linked(_block_pairs(groups, bands, sets, nodes, num, den).join(sets, "key"))
        if not more.isEmpty():
            # a component so far is a star around its label
            nodes = stage(components(nodes.toDF("a", "b").unionByName(more)), "nodes")

    classes = table.filter("n > 0").groupBy("cid").agg(F.min("id").alias("class_id"))
    classes = stage(classes.join(nodes.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid")), "classes")
    tops = classes.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = classes.join(tops, "label").select("cid", "class_id", "component_id", "label")
    return table.select("id", "text_key", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")).join(named, "cid", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("component_id", "id").alias("component_id"), *(["text_key", F.col("label").alias("component")] if keyed else []),
    )


def _levels(source: DataFrame, k: int) -> np.ndarray:
    """A level of frequency from 0 to 15 for each counter of the sketch, two to a byte: 2 MB, whatever the input.

    What chance alone puts into a counter is taken off first; a level is one more bit of what is left.
    """
    slots = (1 << SKETCH_BITS) // SKETCH_SLOT

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint16)
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), k):
                at = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
                at, n = np.unique(at, return_counts=True)
                total[at] = np.minimum(total[at] + n, 0xFFFF)
        total = total.reshape(slots, SKETCH_SLOT)
        used = np.flatnonzero(total.any(axis=1))
        for lo in range(0, len(used), 32):
            part = used[lo: lo + 32]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([total[i].tobytes() for i in part], pa.binary())], ["bucket", "data"])

    def add(batches):
        total = {}
        for b in batches:
            for slot, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(data, np.uint16)
                if slot in total:
                    total[slot] += part
                else:
                    total[slot] = part.astype(np.uint64)
        for slot, x in total.items():
            mean = float(x.mean())
            over = np.maximum(x.astype(np.int64) - int(max(0.0, mean - 2 * mean ** 0.5)), 0)
            level = np.minimum(np.frexp(over.astype(np.float64))[1], 15).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([(level[::2] | level[1::2] << 4).tobytes()], pa.binary())], ["bucket", "data"])

    parts = source.select("text").mapInArrow(lean(count), PACKED)
    summed = by_bucket(parts, min(slots, n_buckets(parts))).mapInArrow(lean(add), PACKED)
    total = np.zeros((slots, SKETCH_SLOT // 2), np.uint8)
    for r in summed.collect():  # 2 MB, whatever the input
        total[r.bucket] = np.frombuffer(r.data, np.uint8)
    return total.ravel()


def _bits(s: np.ndarray) -> bytes:
    """The set's bitmap: a power of two of bits, four to eight for each shingle, 64 at least and 2 ** 16 at most."""
    width = min(1 << 16, max(64, 4 << int(len(s) - 1).bit_length())) if len(s) else 64
    out = np.zeros(width, dtype=bool)
    out[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _profiler(k: int, num: int, den: int, levels: np.ndarray):
    def run(batches):
        level = np.stack([levels & 15, levels >> 4], axis=1).ravel()
        for batch in batches:
            ids = batch.column(0)
            for first, sets in shingle_sets(batch.column(1), k):
                n = np.array([len(s) for s in sets], np.int64)
                cids, keys, bits, prefixes = [], [], [], []
                for s in sets:
                    digest = np.array([s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)], np.uint64)
                    cids.append(digest.tobytes())
                    keys.append(int(digest.view(np.int64)[0]))
                    bits.append(_bits(s))
                    size = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    order = np.argsort(level[s >> np.uint64(64 - SKETCH_BITS)], kind="stable")
                    prefixes.append(s[order[:size]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(sets)).cast(pa.int64()), batch.column(2).slice(first, len(sets)), pa.array(n), pa.array(cids, pa.binary()), pa.array(keys, pa.int64()),
                     pa.array(bits, pa.binary()), pa.array(prefixes, pa.binary())],
                    ["id", "text_key", "n", "cid", "key", "bits", "prefix"])

    return run


def _gram_rows(table: DataFrame, buckets: int) -> DataFrame:
    """The kept shingles of the distinct sets, dealt by shingle."""

    def run(batches):
        for batch in batches:
            keys, ns, lists = (batch.column(i) for i in range(3))
            lists = lists.cast(pa.large_binary())
            # equal sets of a batch once; the rest of them meet in the bucket
            _, first = np.unique(keys.to_numpy(zero_copy_only=False), return_index=True)
            total = np.cumsum(pc.binary_length(lists).to_numpy(zero_copy_only=False)[first] >> 3)
            for some in np.split(first, np.flatnonzero(np.diff(total // SENT_GRAMS)) + 1):
                parts = [np.frombuffer(lists[int(i)].as_buffer(), np.uint64) for i in some]
                g, sizes = np.concatenate(parts), [len(x) for x in parts]
                rows = np.zeros(len(g), GRAM)
                rows["gram"] = g & np.uint64(0xFFFFFFFF)
                for name, values in (("n", ns), ("key", keys)):
                    rows[name] = np.repeat(values.to_numpy(zero_copy_only=False)[some], sizes)
                yield packed(((g >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), rows)

    return by_bucket(table.filter("n > 0").select("key", "n", "prefix").mapInArrow(lean(run), PACKED), buckets)


def _groups_of(table: DataFrame, buckets: int, num: int, den: int) -> DataFrame:
    """(gram, key, n): the sets that share a kept shingle with another one of compatible size.

    Groups under one smallest member are joined: the sets of a family meet there once, not once for each shingle they share.
    """

    def shared(batches):
        rows = unpacked(batches, GRAM)
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["key"], rows["n"], rows["gram"]))]
        again = (rows["gram"][1:] == rows["gram"][:-1]) & (rows["key"][1:] == rows["key"][:-1])
        rows = rows[np.concatenate([[True], ~again])]
        # a stretch: rows of a shingle by size, each compatible with the next
        n = rows["n"].astype(np.int64)
        near = (rows["gram"][1:] == rows["gram"][:-1]) & (n[1:] * num <= n[:-1] * den)
        starts = np.flatnonzero(np.concatenate([[True], ~near]))
        sizes = np.diff(np.append(starts, len(rows)))
        owner = np.repeat(np.minimum.reduceat(rows["key"], starts), sizes)
        several = np.repeat(sizes > 1, sizes)
        owner, key, n = owner[several], rows["key"][several], n[several]
        order = np.lexsort((key, owner))
        owner, key, n = owner[order], key[order], n[order]
        once = np.concatenate([[True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])])[: len(owner)]
        for lo in range(0, len(owner), 50_000):
            cut = slice(lo, lo + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[cut][once[cut]], pa.int64()) for x in (owner, key, n)], ["gram", "key", "n"])

    return _gram_rows(table, buckets).mapInArrow(lean(shared), "gram long, key long, n long").distinct()


def _items(source: DataFrame, table: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(key, items): the sets of ``near``, built again from one text each."""

    def sets(batches):
        for batch in batches:
            for _, found in shingle_sets(batch.column(0), k):
                keys = np.array([s.sum(dtype=np.uint64) for s in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.tobytes() for s in found], pa.binary())], ["key", "items"])

    one = table.join(near.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(F.struct("id", "text_key")).alias("one"))
    one = small_or_shuffled(stage(one.select("one.*").distinct(), "ends")).alias("w")
    wanted = F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.text_key") == F.col("w.text_key"))
    texts = source.alias("t").join(one, wanted, "left_semi").select("text")
    return texts.mapInArrow(lean(sets), "key long, items binary").dropDuplicates(["key"])


def _band(num: int, den: int):
    """Sizes of neighbouring bands, or of one, may be compatible; no others are."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)) * (1 + 1e-9)))


def _bands(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, band, parts): for each group that is too large for a tile, its bands of sizes and how many blocks they have."""
    parts = lambda: F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n") / TILE_SHINGLES))
    large = stage(groups.groupBy("gram").agg(parts().alias("parts")).filter("parts > 1").select("gram"), "large")
    if large.isEmpty():
        return large.select("gram", F.lit(0).cast("long").alias("band"), F.lit(0).cast("long").alias("parts"))
    rows = groups.join(small_or_shuffled(large), "gram").withColumn("band", _band(num, den))
    return stage(rows.groupBy("gram", "band").agg(parts().alias("parts")), "bands")


def _blocks(groups: DataFrame, bands: DataFrame, num: int, den: int, how: str) -> DataFrame:
    """``groups`` with the block of each row; what is not in ``bands`` has none."""
    block = F.shiftleft("band", 32) + F.pmod(F.xxhash64("key"), "parts")
    rows = groups.withColumn("band", _band(num, den)).join(small_or_shuffled(bands), ["gram", "band"], how)
    return rows.select("gram", "key", "n", "band", block.alias("block"))


def _tiles(groups: DataFrame, bands: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, i, j, right, key): each block with itself. A group that fits a tile is one block."""
    rows = _blocks(groups, bands, num, den, "left").withColumn("i", F.coalesce("block", F.lit(0)))
    return rows.select("gram", "i", F.col("i").alias("j"), F.lit(True).alias("right"), "key")


def _block_pairs(groups: DataFrame, bands: DataFrame, sets: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, i, j, right, key, label): blocks i and j of a group, j on the right, that hold several components and compatible sizes."""
    labels = sets.join(small_or_shuffled(nodes.withColumnRenamed("node", "cid")), "cid", "left").select("key", F.coalesce("label", "cid").alias("label"))
    rows = stage(_blocks(groups, bands, num, den, "inner").join(labels, "key"), "rows")
    blocks = rows.groupBy("gram", "band", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("low"), F.max("label").alias("high"))
    x, y = (blocks.select("gram", *(F.col(c).alias(f"{c}_{s}") for c in ("band", "block", "least", "most", "low", "high"))) for s in "ij")
    pairs = x.join(y, "gram").filter(
        (F.col("block_i") < F.col("block_j")) & (F.col("band_j") - F.col("band_i") <= 1)
        & (F.col("least_j") * num <= F.col("most_i") * den) & (F.col("least_i") * num <= F.col("most_j") * den)
        & (F.least("low_i", "low_j") < F.greatest("high_i", "high_j")))
    side = lambda block, right: F.struct(F.col(block).alias("block"), F.lit(right).alias("right"))
    ends = pairs.select("gram", F.col("block_i").alias("i"), F.col("block_j").alias("j"), F.explode(F.array(side("block_i", False), side("block_j", True))).alias("end"))
    return rows.join(ends.select("gram", "i", "j", "end.*"), ["gram", "block"]).select("gram", "i", "j", "right", "label", "key")


def _dealt(tiles: DataFrame, buckets: int, *columns: str) -> DataFrame:
    """Whole tiles to tasks, one by one, so that a large group is not one task's work."""
    return tiles.select(*columns).repartition(buckets, "gram", "i", "j").sortWithinPartitions("gram", "i", "j")


def _each_tile(batches, of_tile):
    """What ``of_tile`` makes of the rows of each tile (gram, i, j, ...), in record batches; rows arrive sorted by tile."""
    now, rows, held, size = None, [], [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:3] != now:
                if len(rows) > 1 and (out := of_tile(rows)) is not None:
                    held.append(out)
                    size += out.num_rows
                now, rows = row[:3], []
            rows.append(row)
        if size > 10_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if len(rows) > 1 and (out := of_tile(rows)) is not None:
        held.append(out)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _folded(bits: list[np.ndarray], words: int) -> np.ndarray:
    return np.stack([x if len(x) == words else np.bitwise_or.reduce(x.reshape(-1, words), axis=0) for x in bits])


def _pairs(right: list[bool], n: np.ndarray, bits: list[bytes], open_pairs, num: int, den: int):
    """Pairs of a tile that can reach the threshold, in portions, likely ones first in each; of those that ``open_pairs`` still wants."""
    bits = [np.frombuffer(x, np.uint64) for x in bits]
    width = np.array([len(x) for x in bits])
    alone = all(right)  # a block with itself
    sides = (np.arange(len(n)),) * 2 if alone else (np.flatnonzero(~np.array(right)), np.flatnonzero(right))
    for x in range(0, len(sides[0]), BLOCK_ROWS):
        for y in range(x if alone else 0, len(sides[1]), BLOCK_ROWS):
            p, q = sides[0][x: x + BLOCK_ROWS], sides[1][y: y + BLOCK_ROWS]
            fits = (n[p][:, None] * den >= n[q][None, :] * num) & (n[q][None, :] * den >= n[p][:, None] * num)
            u, v = np.nonzero(fits & open_pairs(p, q))
            p, q = p[u], q[v]
            narrow = np.minimum(width[p], width[q])
            for words in np.unique(narrow).tolist():
                some = np.flatnonzero(narrow == words)
                step = max(1, (1 << 17) // words)
                for lo in range(0, len(some), step):
                    pp, qq = p[some[lo: lo + step]], q[some[lo: lo + step]]
                    used, at = np.unique(np.concatenate([pp, qq]), return_inverse=True)
                    b = _folded([bits[i] for i in used], words)
                    l, r = b[at[: len(pp)]], b[at[len(pp):]]
                    most = np.minimum(n[pp] - np.bitwise_count(l & ~r).sum(axis=1), n[qq] - np.bitwise_count(r & ~l).sum(axis=1))
                    # |x & y| * den >= num * (|x| + |y| - |x & y|)
                    ok = np.flatnonzero(most * (num + den) >= num * (n[pp] + n[qq]))
                    ok = ok[np.argsort(-most[ok] / (n[pp] + n[qq])[ok], kind="stable")]
                    yield pp[ok], qq[ok]


def _near(num: int, den: int):
    """The rows of each tile that can reach the threshold with another one of another label."""

    def kept(rows):
        rows.sort(key=lambda r: r[6])
        place = {}
        label = np.array([place.setdefault(r[4], len(place)) for r in rows])
        keep = np.zeros(len(rows), dtype=bool)
        wanted = lambda p, q: (label[p][:, None] != label[q][None, :]) & ~(keep[p][:, None] & keep[q][None, :])
        for p, q in _pairs([r[3] for r in rows], np.array([r[6] for r in rows]), [r[7] for r in rows], wanted, num, den):
            keep[p] = keep[q] = True
        if keep.any():
            some = [rows[i] for i in np.flatnonzero(keep)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())
            names = ["gram", "i", "j", "right", "label", "key"]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], t) for c, t in enumerate(types)], names)

    return lambda batches: _each_tile(batches, kept)


def _links(num: int, den: int):
    """Of each tile, links between the labels that its pairs join: a star around the smallest label of those joined."""

    def joined(rows):
        rows.sort(key=lambda r: len(r[5]))
        names = sorted({r[4] for r in rows})
        place = {name: i for i, name in enumerate(names)}
        first = np.array([place[r[4]] for r in rows])
        group = first.copy()
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        n = np.array([len(s) for s in sets])
        wanted = lambda p, q: group[p][:, None] != group[q][None, :]
        for p, q in _pairs([r[3] for r in rows], n, [_bits(s) for s in sets], wanted, num, den):
            for a, b in zip(p.tolist(), q.tolist()):
                if group[a] != group[b]:
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if both * (num + den) >= num * (n[a] + n[b]):
                        group[group == group[b]] = group[a]
        top, a, b = {}, [], []
        for name, g in zip(names, group[np.unique(first, return_index=True)[1]].tolist()):
            if top.setdefault(g, name) != name:
                a.append(top[g])
                b.append(name)
        if a:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (a, b)], ["a", "b"])

    return lambda batches: _each_tile(batches, joined)
