"""Token ids in shards, Re-Pair compressed, with random access by document.

A shard is a run of documents in id order. Its ids are compressed by Re-Pair: frequent pairs of neighbouring symbols are
replaced by new symbols, again and again; each round takes the most frequent pairs there are, from left to right. A
shard keeps the rules (two symbols each), the number of ids that each symbol expands to, and the symbols that are
left. Sums of these lengths tell which symbols hold a document, and only those are expanded.
The files are Parquet, a row for each shard, written and committed by Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.exchange import lean, n_buckets
from tidemark.llm.tokens import encoder, portions

SHARD_IDS = 1 << 20
ROUNDS, RULES_PER_ROUND, LEAST_COUNT = 3, 4096, 8
SLOTS = 1 << 20
SHARD = "part int, shard int, n_ids long, doc_ids array<bigint>, sizes array<bigint>, first_symbol long, rules binary, lengths binary, symbols binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> None:
    """Encode each row's whole text, append ``end_id``, and write the shards to ``path`` in ascending id order.

    A null text is empty. Rows with a null id come first; rows that share an id follow each other, by text. An empty table writes no shard. Other
    columns are not read. The shards of a task are as large as SHARD_IDS ids, or one document.
    """
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = ordered.repartitionByRange(n_buckets(docs), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    ordered.mapInArrow(lean(_shards(tokenizer, end_id)), SHARD).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: DataFrame | None = None, id_col: str = "doc_id", crc_only: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) for each document of the shards at ``path``; all of them, or those of ``ids``.

    start counts the ids of all documents before it. ids are little-endian unsigned 32-bit integers, left out with
    ``crc_only``. With ``ids``, only symbols that hold a wanted document are expanded.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_part", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "shard", (F.col("part_start") + F.col("in_part")).alias("first"))
    if ids is not None:
        wanted = shards.select("part", "shard", F.posexplode("doc_ids").alias("at", "id")).join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
        wanted = wanted.groupBy("part", "shard").agg(F.sort_array(F.collect_set("at")).alias("wanted"))
        shards = shards.join(wanted, ["part", "shard"])
    else:
        shards = shards.withColumn("wanted", F.lit(None).cast("array<int>"))
    placed = shards.join(starts, ["part", "shard"]).drop("part", "shard", "n_ids")
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ("" if crc_only else ", ids binary")
    return placed.mapInArrow(lean(_documents(crc_only)), schema).withColumnRenamed("id", id_col)


def _shards(tokenizer: str, end_id: int | None):
    end = b"" if end_id is None else np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard, ids, raw, n = encoder(tokenizer), TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for piece in portions(batch, 1):
                for i, x in zip(piece.column(0).to_pylist(), coder.encode_all(piece.column(1).to_pylist())):
                    x += end
                    if raw and n + len(x) // 4 > SHARD_IDS:
                        yield _shard(part, shard, ids, raw)
                        shard, ids, raw, n = shard + 1, [], [], 0
                    ids.append(i)
                    raw.append(x)
                    n += len(x) // 4
        if raw:
            yield _shard(part, shard, ids, raw)

    return run


def _shard(part: int, shard: int, ids: list, raw: list[bytes]) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(raw), "<u4")
    first, rules, lengths, symbols = compress(flat)
    narrow = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    row = {
        "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_ids": pa.array([len(flat)], pa.int64()),
        "doc_ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([[len(x) // 4 for x in raw]], pa.list_(pa.int64())),
        "first_symbol": pa.array([first], pa.int64()), "rules": pa.array([rules.tobytes()], pa.binary()),
        "lengths": pa.array([lengths.tobytes()], pa.binary()), "symbols": pa.array([symbols.astype(narrow).tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), list(row))


def _slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """First new symbol, rules (n, 2), ids that each rule expands to, symbols."""
    symbols = ids.astype(np.uint32)
    first = int(symbols.max()) + 1 if len(symbols) else 0
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    for _ in range(ROUNDS):
        if len(symbols) < 2:
            break
        pairs = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
        found, counts = np.unique(pairs, return_counts=True)
        found, counts = found[counts >= LEAST_COUNT], counts[counts >= LEAST_COUNT]
        if not len(found):
            break
        top = np.argsort(-counts, kind="stable")[:RULES_PER_ROUND]
        chosen = found[top]
        _, one = np.unique(_slots(chosen), return_index=True)  # of pairs in one slot, the most frequent now, others in a later round
        chosen = chosen[np.sort(one)]
        new = np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
        rule_at, pair_at = np.full(SLOTS, -1, np.int32), np.zeros(SLOTS, np.uint64)
        rule_at[_slots(chosen)], pair_at[_slots(chosen)] = np.arange(len(chosen)), chosen
        slots = _slots(pairs)
        rule = rule_at[slots]
        at = np.flatnonzero(rule >= 0)
        at = at[pair_at[slots[at]] == pairs[at]]
        # of overlapping candidates every second one, from the left
        head = np.ones(len(at), dtype=bool)
        head[1:] = np.diff(at) > 1
        starts = np.flatnonzero(head)
        at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) & 1 == 0]
        base = first + len(rules)
        symbols = symbols.copy()
        symbols[at] = base + rule[at]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        known = np.concatenate([np.ones(first, np.uint32), lengths])
        lengths = np.concatenate([lengths, known[new[:, 0]] + known[new[:, 1]]])
        rules = np.concatenate([rules, new])
    return first, rules, lengths.astype(np.uint32), symbols


class Decoder:
    """Expands symbols of one shard."""

    def __init__(self, first: int, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray):
        self.lengths = np.concatenate([np.ones(first, np.int64), lengths.astype(np.int64)])
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.table = np.zeros(self.offsets[-1], np.uint32)
        self.table[:first] = np.arange(first)
        lo = 0
        while lo < len(rules):
            # a stretch of rules whose symbols are all known
            high = np.flatnonzero((rules[lo:] >= first + lo).any(axis=1))
            hi = lo + int(high[0]) if len(high) else len(rules)
            parts = rules[lo:hi].ravel()
            sizes = self.lengths[parts]
            ends = np.cumsum(sizes)
            self.table[self.offsets[first + lo]: self.offsets[first + hi]] = self.table[np.repeat(self.offsets[parts] - ends + sizes, sizes) + np.arange(ends[-1])]
            lo = hi
        self.symbols = symbols
        self.ends = np.cumsum(self.lengths[symbols])

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from start up to end, by expanding the symbols that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(self.ends, start, side="right")), int(np.searchsorted(self.ends, end - 1, side="right")) + 1
        s = self.symbols[a:b]
        sizes = self.lengths[s]
        ends = np.cumsum(sizes)
        out = self.table[np.repeat(self.offsets[s] - ends + sizes, sizes) + np.arange(ends[-1])]
        skip = start - (int(self.ends[a - 1]) if a else 0)
        return out[skip: skip + end - start]


def _documents(crc_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                first, rules = row["first_symbol"], np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                wide = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
                decoder = Decoder(first, rules, np.frombuffer(row["lengths"], "<u4"), np.frombuffer(row["symbols"], wide))
                ends = np.cumsum(np.array(row["sizes"], np.int64))
                starts = ends - row["sizes"]
                chosen = row["wanted"] if row["wanted"] is not None else range(len(ends))
                whole = decoder.ids(0, int(ends[-1])) if row["wanted"] is None else None
                texts = [(decoder.ids(int(starts[i]), int(ends[i])) if whole is None else whole[starts[i]: ends[i]]).astype("<u4").tobytes() for i in chosen]
                columns = {
                    "id": pa.array([row["doc_ids"][i] for i in chosen], pa.int64()),
                    "start": pa.array([row["first"] + int(starts[i]) for i in chosen], pa.int64()),
                    "n_tokens": pa.array([len(x) // 4 for x in texts], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in texts], pa.int64()),
                }
                if not crc_only:
                    columns["ids"] = pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run
