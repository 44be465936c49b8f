"""Quality classifier: a factorisation machine over hashed words, structure statistics and the stated length.

score(x) = sigmoid(w0 + <w, x> + 1/2 * sum over f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), which is linear in the number of
features that a text has. It is fitted on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import lean, short_batches
from tidemark.llm.textbytes import LOWER, SPACES, span_hashes, text_slices, word_counts, word_spans

BUCKETS = 4096
RANK = 8
#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 8192
EPOCHS, BATCH, RATE, DECAY = 10, 128, 0.02, 1e-5
KINDS = {  # classes of bytes that the structure statistics count
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9, 13), "line": (10,), "high": range(128, 256),
    "stop": (44, 46, 59, 58), "mark": (33, 63), "sign": (35, 36, 37, 38, 42, 43, 61, 64, 94, 126), "bar": (124, 47, 92, 95), "bracket": (40, 41, 60, 62, 91, 93, 123, 125),
}
N_STATS = len(KINDS) + 9


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray  # (N_STATS + BUCKETS,)
    factors: np.ndarray  # (N_STATS + BUCKETS, RANK)
    mean: np.ndarray
    scale: np.ndarray

    def raw(self, stats: np.ndarray, rows: np.ndarray, buckets: np.ndarray, values: np.ndarray) -> np.ndarray:
        n, dense = len(stats), np.clip((stats - self.mean) / self.scale, -4, 4)
        w, v = self.linear[N_STATS:][buckets], self.factors[N_STATS:][buckets]
        out = self.bias + dense @ self.linear[:N_STATS] + np.bincount(rows, w * values, n)[:n]
        squares = (dense * dense) @ (self.factors[:N_STATS] ** 2).sum(axis=1) + np.bincount(rows, (v * v).sum(axis=1) * values * values, n)[:n]
        for f in range(self.factors.shape[1]):
            s = dense @ self.factors[:N_STATS, f] + np.bincount(rows, v[:, f] * values, n)[:n]
            out += 0.5 * s * s
        return out - 0.5 * squares


def features(texts: pa.Array, stated: np.ndarray):
    """For runs of rows: first row, statistics, and of each row its word buckets and values (of unit length)."""
    for first, buf, offsets in text_slices(texts):
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        starts, ends, rows = word_spans(LOWER[buf], offsets, SPACES)
        words = span_hashes(LOWER[buf], starts, ends)
        counts = word_counts(rows, n)
        kinds = np.zeros((n, len(KINDS)))
        row_of = np.repeat(np.arange(n), sizes)
        table = np.zeros(256, np.int64)
        for j, codes in enumerate(KINDS.values()):
            table[list(codes)] = j + 1
        seen = np.bincount(row_of * (len(KINDS) + 1) + table[buf], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
        kinds = seen[:, 1:] / np.maximum(sizes, 1)[:, None]
        order = np.lexsort((words, rows))
        w, r = words[order], rows[order]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(w)))
        distinct = np.bincount(r[at], minlength=n)[:n]
        most = np.zeros(n, np.int64)
        np.maximum.at(most, r[at], times)
        lengths = np.bincount(rows, ends - starts, n)[:n]
        long_words = np.bincount(rows, (ends - starts) > 12, n)[:n]
        same = (rows[1:] == rows[:-1]) & (words[1:] == words[:-1])
        again = np.bincount(rows[1:][same], minlength=n)[:n]
        # two-word sequences that have occurred before in the text
        pairs = words[1:] * np.uint64(3) + words[:-1]
        inner = rows[1:] == rows[:-1]
        p, pr = pairs[inner], rows[1:][inner]
        o = np.lexsort((p, pr))
        p, pr = p[o], pr[o]
        fresh = np.ones(len(p), dtype=bool)
        fresh[1:] = (p[1:] != p[:-1]) | (pr[1:] != pr[:-1])
        pairs_seen, pairs_new = np.bincount(pr, minlength=n)[:n], np.bincount(pr[fresh], minlength=n)[:n]
        some = np.maximum(counts, 1)
        told = stated[first: first + n]
        stats = np.column_stack([
            kinds, np.log1p(sizes), np.log1p(counts), lengths / some, long_words / some, distinct / some, most / some, again / some,
            pairs_new / np.maximum(pairs_seen, 1), np.log1p(np.where(told < 0, sizes, told)),
        ])
        key, where = np.unique(r[at] * BUCKETS + (w[at] % np.uint64(BUCKETS)).astype(np.int64), return_inverse=True)
        values = np.bincount(where, np.log1p(times), len(key))
        key_row = key // BUCKETS
        norm = np.sqrt(np.bincount(key_row, values * values, n))[:n]
        yield first, stats, key_row, key % BUCKETS, values / norm[key_row]


def _stated(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows (those of least id hash), 256 MB of features at most.

    Null labels and ids are left out; of repeated rows of an id one counts. Without labels, or with one kind alone, scores are the share of
    ones, or one half.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(length_col).cast("long").alias("stated"))
    rows = rows.join(F.broadcast(known), "id").dropDuplicates(["id"]).select("id", "label", "text", "stated")

    def run(batches):
        for b in batches:
            ids, y = b.column(0), b.column(1)
            for first, stats, row, bucket, value in features(b.column(2), _stated(b.column(3))):
                cuts = np.searchsorted(row, np.arange(len(stats) + 1))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, len(stats)).cast(pa.int64()), y.slice(first, len(stats)),
                    pa.array([s.tobytes() for s in stats], pa.binary()),
                    pa.array([bucket[i:j].astype("<i4").tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([value[i:j].astype("<f4").tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                ], ["id", "label", "stats", "buckets", "vals"])

    got = rows.mapInArrow(lean(run), "id long, label int, stats binary, buckets binary, vals binary").toArrow().sort_by("id")
    stats = np.array([np.frombuffer(x, np.float64) for x in got.column("stats").to_pylist()]).reshape(-1, N_STATS)
    y = np.array(got.column("label").to_pylist(), np.float64)
    mean = stats.mean(axis=0) if len(y) else np.zeros(N_STATS)
    scale = stats.std(axis=0) + 1e-3 if len(y) else np.ones(N_STATS)
    d = N_STATS + BUCKETS
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(float(np.log(share / (1 - share))), np.zeros(d), np.zeros((d, RANK)), mean, scale)
    dense = np.clip((stats - mean) / scale, -4, 4)
    sparse = [(np.frombuffer(b, "<i4"), np.frombuffer(v, "<f4")) for b, v in zip(got.column("buckets").to_pylist(), got.column("vals").to_pylist())]
    return _fitted(dense, sparse, y, mean, scale)


def _fitted(dense, sparse, y, mean, scale) -> Model:
    rng = np.random.default_rng(7)
    d = N_STATS + BUCKETS
    w, v, bias = np.zeros(d), rng.normal(0, 0.05, (d, RANK)), 0.0
    gw, gv, gb = np.full(d, 1e-6), np.full((d, RANK), 1e-6), 1e-6
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            part = order[lo: lo + BATCH]
            x = np.zeros((len(part), d), np.float32)
            x[:, :N_STATS] = dense[part]
            for i, k in enumerate(part):
                x[i, N_STATS + sparse[k][0]] = sparse[k][1]
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used].astype(np.float64)
            wu, vu = w[used], v[used]
            s = x @ vu
            raw = bias + x @ wu + 0.5 * ((s * s).sum(axis=1) - (x * x) @ (vu * vu).sum(axis=1))
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
            dw = x.T @ err + DECAY * wu
            dv = x.T @ (err[:, None] * s) - ((x * x).T @ err)[:, None] * vu + DECAY * vu
            gb += err.sum() ** 2
            gw[used] += dw * dw
            gv[used] += dv * dv
            bias -= RATE * 5 * err.sum() / np.sqrt(gb)
            w[used] -= RATE * 5 * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return Model(bias, w, v, mean, scale)


def scored(docs: DataFrame, model: Model, text_col: str = "text", length_col: str = "n_chars", threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on).

    A null text is empty and scored as such, a null length is taken from the text. Repeated rows get equal scores. An empty table gives
    an empty result. Columns of ``docs`` named score or predicted are replaced.
    """
    short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches):
        for b in batches:
            text, stated = b.column(b.schema.get_field_index("__text")), _stated(b.column(b.schema.get_field_index("__stated")))
            score = np.zeros(b.num_rows)
            for first, stats, row, bucket, value in features(text, stated):
                score[first: first + len(stats)] = 1 / (1 + np.exp(-np.clip(model.raw(stats, row, bucket, value), -30, 30)))
            columns = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*kept, F.col(text_col).cast("string").alias("__text"), F.col(length_col).cast("long").alias("__stated")).mapInArrow(lean(run), schema)
