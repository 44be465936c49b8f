"""Words, shingles and byte windows of many texts at once, with numpy over Arrow buffers.

Hashes are 64 bits wide. Two different words or shingles of the same pair of documents meet in one value with a chance
of about 1 in 10**13, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time, so that the arrays stay in cache; a longer document is worked on alone and whole.
SLICE_BYTES = 1 << 16

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GRAM_CODES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C13)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C13, -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1."""
    if len(_powers[0]) < n:
        size = 1 << max(17, int(n).bit_length())
        for i, b in enumerate((BASE, UNBASE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, data[offsets[at]: offsets[end]], offsets[at: end + 1] - offsets[at]
        at = end


def word_spans(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words do not cross rows."""
    inside = ~separators[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    keep = inside[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, by one prefix sum over all of them."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODES[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_counts(rows: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(rows, minlength=n_rows)[:n_rows]


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row) of whole lower-cased texts.

    A row of fewer than k words, but not none, has its whole sequence as one shingle; a row without words has none.
    """
    for first, buf, offsets in text_slices(texts):
        n = len(offsets) - 1
        buf = LOWER[buf]
        starts, ends, rows = word_spans(buf, offsets, SPACES)
        words = span_hashes(buf, starts, ends)
        bounds = np.concatenate([[0], np.cumsum(word_counts(rows, n))])
        grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            grams += words[j: len(words) - k + 1 + j] * GRAM_CODES[j]
        grams = mix(grams)
        out = []
        for i in range(n):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                out.append(np.unique(grams[a: b - k + 1]))
            elif b > a:
                short = np.append(words[a:b] * GRAM_CODES[: b - a], GRAM_CODES[k + b - a])
                out.append(mix(short.sum(dtype=np.uint64, keepdims=True)))
            else:
                out.append(np.zeros(0, np.uint64))
        yield first, out
