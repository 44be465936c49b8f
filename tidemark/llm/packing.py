"""Best-fit packing of documents into sequences under several capacities at once.

A piece of n tokens asks for n tokens, one document place and n * n of attention cost; a sequence has a capacity of each.
What a piece asks for depends on its length alone, so the plan is made over the counts of lengths: at most as many
numbers as a sequence has tokens, whatever the corpus. Lengths are placed from long to short; each goes to the kind of
open sequence that fits best, by the weighted norm of what would be left over, or by the weighted product of what is
left and what is asked for. Sequences of equal content are one kind with a number, so the plan is that of one best-fit
run over the whole corpus. Each piece then finds its place by its number among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.exchange import lean
from tidemark.llm.tokens import encoder, portions
from tidemark.operators.staging import stage

PIECES = "id long, piece int, start long, length int, ids_crc32 long, part int, rank long"
SEATS = "length int, first long, last long, sequence long, offset int"


def packed_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tokens: int = 2048,
    documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), by: str = "norm",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes.

    A text's ids are those of the tokenizer, then ``end_id``; a null text is empty. Only documents of more than ``tokens``
    ids are cut; the first piece takes what whole ones leave over. ``documents`` and ``attention`` bound the pieces of
    a sequence and the sum of their squared lengths; by default as much as ``tokens`` allows. A piece that no empty
    sequence can hold is refused. Repeated rows and rows with a null id are packed like others. An empty table gives an empty result; other
    columns are not read.
    """
    documents, attention = documents or tokens, attention or tokens * tokens
    if documents < 1 or attention < tokens * tokens:
        raise ValueError("a whole piece must fit into an empty sequence")
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_pieces(tokenizer, end_id, tokens)), PIECES)
    pieces = stage(pieces, "pieces")
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `tokens` rows
    seats = plan(total, tokens, documents, attention, weights, by)
    of_length: dict[int, list[int]] = {}
    for i, s in enumerate(seats):
        of_length.setdefault(s[0], []).append(i)
    table = {n: np.array([seats[i][1:] for i in rows], np.int64).reshape(-1, 4) for n, rows in of_length.items()}

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int32)
            for n in np.unique(length):
                rows, at = table[int(n)], np.flatnonzero(length == n)
                k = np.searchsorted(rows[:, 0], number[at], side="right") - 1
                sequence[at], offset[at] = rows[k, 2] + number[at] - rows[k, 0], rows[k, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    numbered = pieces.join(bases, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("number"))
    placed = numbered.mapInArrow(seat, "id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset int")
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id",
        F.col("offset").cast("long").alias("offset"),
    )


def _pieces(tokenizer: str, end_id: int, tokens: int):
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        for batch in batches:
            for b in portions(batch, 1):
                rows = []
                for i, raw in zip(b.column(0).to_pylist(), coder.encode_all(b.column(1).to_pylist())):
                    raw += end
                    n, place, piece = len(raw) // 4, 0, 0
                    while place < n:
                        size = (n % tokens or tokens) if place == 0 else tokens
                        rows.append((i, piece, place, size, zlib.crc32(raw[4 * place: 4 * (place + size)]), part, int(seen[size])))
                        seen[size] += 1
                        place, piece = place + size, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def plan(counts: dict[int, int], tokens: int, documents: int, attention: int, weights=(1.0, 1e-3, 1e-3), by: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """Seats (length, first, last, sequence, offset): pieces ``first`` to ``last`` of a length, counted from 0, go to the
    sequences from ``sequence`` on, one each, at ``offset``."""
    if by not in ("norm", "product"):
        raise ValueError(by)
    capacity = np.array([tokens, documents, attention], np.float64)
    weight = np.array(weights, np.float64)
    size = 1024
    left = np.zeros((size, 3))  # of each kind of open sequence
    number = np.zeros(size, np.int64)
    content: list[list[int]] = [[]] * size  # lengths so far
    free: list[int] = list(range(size))
    for n in sorted(counts, reverse=True):
        ask, todo = np.array([n, 1, n * n], np.float64), counts[n]
        while todo:
            fits = np.flatnonzero((number > 0) & (left >= ask).all(axis=1))
            if len(fits):
                rest = (left[fits] - ask) / capacity
                score = (weight * rest * rest).sum(axis=1) if by == "norm" else -(weight * (left[fits] / capacity) * (ask / capacity)).sum(axis=1)
                k = int(fits[score.argmin()])
                room, have, held = left[k].copy(), int(number[k]), content[k]
            else:
                k, room, held = -1, capacity.copy(), []
                have = todo
            # as many of this length to each sequence as it can take, to as many sequences as that needs
            each = int(min((room[0] // ask[0]), room[1], room[2] // ask[2])) if n else 0
            each = max(1, min(each, todo))
            used = min(have, todo // each) or 1
            if k >= 0:
                number[k] -= used
                if not number[k]:
                    free.append(k)
            if not free:
                free = list(range(size, 2 * size))
                left, number = np.concatenate([left, np.zeros((size, 3))]), np.concatenate([number, np.zeros(size, np.int64)])
                content += [[]] * size
                size *= 2
            new = free.pop()
            take = min(each, todo)
            left[new], number[new], content[new] = room - ask * take, used, held + [n] * take
            todo -= take * used
    seats, taken, base = [], dict.fromkeys(counts, 0), 0
    for k in np.flatnonzero(number):
        offset = 0
        for n in content[k]:
            seats.append((n, taken[n], taken[n] + int(number[k]) - 1, base, offset))
            taken[n] += int(number[k])
            offset += n
        base += int(number[k])
    return seats
