"""The operators against plain versions, on small tables with the awkward cases."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import queries as Q
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.exchange import lean_group
from tidemark.llm.licenses import aligned, known_texts, scanned
from tidemark.llm.ngram_join import linked_components
from tidemark.llm.packing import packed_documents, plan
from tidemark.llm.quality import BUCKETS, N_STATS, Model, features, fit, scored
from tidemark.llm.quotations import reply_ordered
from tidemark.llm.repair_store import Decoder, compress, read_tokens, write_tokens
from tidemark.llm.suffix_dedup import _grams, _removed, _runs, loser_tree, without_repeats
from tidemark.llm.tokens import Encoder
from tidemark.llm.topk_search import Best, search, top_k
from tidemark.llm.url_filter import judged

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon été straße".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id string, id long, chunk int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Null, empty, short, long, copies, near copies, shared passages, odd characters."""
    rng = random.Random(3)
    base, shared = prose(rng, 120), prose(rng, 40)
    near = base.split(" ")
    out = [(1, None), (2, ""), (3, "word"), (4, "Word"), (5, "a b"), (6, base), (7, base), (None, base), (8, base)]
    for i in range(9, 25):
        w = list(near)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "x"
        out.append((i, " ".join(w)))
    out += [(30 + i, prose(rng, 30) + "\n" + shared + ". " + prose(rng, 10)) for i in range(6)]
    out += [(40, "ß€😀" * 40), (41, "x" + "ß€😀" * 40), (42, "ab" * 500), (43, "b" + "ab" * 400), (44, prose(rng, 9000)), (45, "  \n \t "), (46, "a  b\n\n\nc\r\n<|endoftext|> it's")]
    return out + [(6, base), (50, prose(rng, 50)), (50, prose(rng, 50))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "clash", 7, 1) for i, t in texts], DOCS).repartition(3)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_suffix_dedup(docs, texts):
    rows = [(2**63 if i is None else i, i, (t or "").encode()) for i, t in texts]
    first = {}
    for rank, _, b in rows:
        for p in range(len(b) - 49):
            s = b[p: p + 50]
            first[s] = min(rank, first.get(s, rank))
    want = []
    for rank, i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p: p + 50]] < rank:
                gone[p: p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept, "s"))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept), r.carried.source) for r in without_repeats(docs, carry=("source",)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[2] for r in got) and without_repeats(docs.limit(0)).count() == 0


def test_loser_tree_keeps_order_and_shared_prefixes():
    rng = random.Random(1)
    runs, everything = [], []
    for _ in range(7):
        run = sorted(bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(rng.randrange(0, 30)))
        shared = [0] + [next((k for k in range(8) if x[k] != y[k]), 8) for x, y in zip(run, run[1:])]
        runs.append((run, shared))
        everything += run
    order, shared = loser_tree(runs)
    at = [0] * 7
    out = []
    for r in order:
        out.append(runs[r][0][at[r]])
        at[r] += 1
    assert out == sorted(everything)
    assert shared[1:] == [next((k for k in range(8) if x[k] != y[k]), 8) for x, y in zip(out, out[1:])]


def test_ngram_join(docs, texts):
    sets = []
    for i, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t)) if x]
        sets.append((i, frozenset(tuple(w[j: j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[top(a)] = top(b)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    want = sorted(((i, len(s), least.get(top(k))) for k, (i, s) in enumerate(sets)), key=repr)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in linked_components(docs).collect()), key=repr)
    assert got == want
    assert linked_components(docs.limit(0)).count() == 0


def test_decontamination(spark, docs, texts):
    long_text = dict(texts)[44].split(" ")
    items = [(1, None), (2, ""), (3, " ".join(long_text[100:130])), (4, " ".join(long_text[110:123]).upper()), (5, "word"), (6, "a b"), (7, texts[-2][1]), (8, texts[-2][1]), (None, "word"), (None, long_text[300]), (None, " ".join(long_text[400:420]))]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = {}
    for i, t in items:
        w = cut(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s: s + 13]), set()).add(None if i is None else str(i))
    want = []
    for i, t in texts:
        w, hit, found = cut(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s: s + k]) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[tuple(w[s: s + k])]
        listed = ",".join(sorted(found - {None}))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = [tuple(r[n] for n in names) for r in decontaminated(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert not decontaminated(docs, bench.limit(0)).filter("contaminated or n_hit > 0").count() and decontaminated(docs.limit(0), bench).count() == 0


def test_tokens_are_those_of_the_library(texts):
    library, encoder = Tokenizer.from_file(Q.tokenizer()), Encoder(Q.tokenizer())
    odd = ["a b\n\nc", "a\n\n", "\nabc", " x", "x ", "it's  so\t ok", "\n", "é\xa0b", "'s 's x's\n's", "日本 語\n語", "1 2\n3!! !!", "ǅ ª² ½\n¾", "\n\n\nx", "a\x85b"]
    given = [t for _, t in texts] + odd
    for x, got in zip(given, encoder.encode_all(given)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(x or "", add_special_tokens=False).ids


def test_words_with_marks_are_encoded_together(monkeypatch):
    """Words that are not letters alone are learned strung together, not one call's text each."""
    library, encoder, alone = Tokenizer.from_file(Q.tokenizer()), Encoder(Q.tokenizer()), []
    plain = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: alone.extend(texts) or plain(texts))
    text = "start " + " ".join(f"it's-{i} ({i}) \"q{i}\" É{i}" for i in range(200)) + "\n" + "\n".join(f"l{i}." for i in range(200))
    assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(alone) <= 5


def test_words_are_remembered_and_forgotten(monkeypatch):
    """A word is learned once, with or without a mark after it, and the ids stay when it is forgotten."""
    library, encoder, learned = Tokenizer.from_file(Q.tokenizer()), Encoder(Q.tokenizer()), []
    learn = encoder._learned
    monkeypatch.setattr(encoder, "_learned", lambda new: learned.extend(new) or learn(new))
    texts = ["x " + " ".join(f"w{a}{b} w{a}{b}, élan{a}." for a in "abcdefgh" for b in "ijklmnop"), "y élana wai; wai . , élana"]
    texts = [t.replace("w", "é" * n + "W") for n in range(6) for t in texts] * 2
    for few in (400_000, 20):
        monkeypatch.setattr("tidemark.llm.tokens.CACHED", few)
        learned.clear()
        got = [raw for t in texts for raw in encoder.encode_all([t])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        if few > 20:
            assert len(learned) == len(set(learned)) and not any(c[-1] in ".,;" for c in learned if len(c) > 1)


def test_remembered_words_take_few_bytes():
    encoder = Encoder(Q.tokenizer())
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    encoder.encode_all(["x " + " ".join(np.base_repr(i, 26).translate(str.maketrans("0123456789", "qrstuvwxyz")) for i in range(50_000, 100_000))])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 60 * 50_000


def test_re_pair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for ids in (rng.integers(0, 30, 20000), np.zeros(5000, int), np.array([5]), np.zeros(0, int), rng.integers(0, 50000, 3000)):
        first, rules, lengths, symbols = compress(ids.astype("<u4"))
        decoder = Decoder(first, rules, lengths, symbols)
        assert (decoder.ids(0, len(ids)) == ids).all()
        for a in range(0, len(ids), 97):
            assert (decoder.ids(a, min(a + 40, len(ids))) == ids[a: a + 40]).all()
    assert len(compress(rng.integers(0, 3, 20000).astype("<u4"))[3]) < 8000


def test_token_store(spark, docs, texts, tmp_path):
    library, path = Tokenizer.from_file(Q.tokenizer()), str(tmp_path / "tokens")
    write_tokens(docs, path, Q.tokenizer())
    want, start = [], 0
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        raw = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        want.append((i, start, len(raw) // 4, zlib.crc32(raw), raw))
        start += len(raw) // 4
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in read_tokens(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    some = spark.createDataFrame([(44,), (6,), (6,), (999,)], "doc_id long")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in read_tokens(spark, path, some).collect()]
    assert sorted(got, key=lambda r: r[1]) == [w for w in want if w[0] in (44, 6)]
    write_tokens(docs.limit(0), path, Q.tokenizer())
    assert read_tokens(spark, path).count() == 0


def check_packing(rows, tokens, documents=10**9, attention=10**18):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for held in by.values():
        end = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= tokens and len(held) <= documents and sum(r.length**2 for r in held) <= attention
    return len(by)


def test_packing(docs, texts):
    library = Tokenizer.from_file(Q.tokenizer())
    rows = packed_documents(docs, Q.tokenizer()).collect()
    sequences = check_packing(rows, 2048)
    assert sequences <= -(-sum(r.length for r in rows) // 2048) + 1
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in texts:
        ids, want, at = library.encode(t or "", add_special_tokens=False).ids + [0], [], 0
        while at < len(ids):
            size = (len(ids) % 2048 or 2048) if at == 0 else 2048
            want.append((len(want), at, size, zlib.crc32(np.array(ids[at: at + size], "<u4").tobytes())))
            at += size
        for w in want:
            got[i].remove(w)
    assert not any(got.values())
    assert packed_documents(docs.limit(0), Q.tokenizer()).count() == 0


@pytest.mark.parametrize("by", ["norm", "product"])
def test_plan_holds_every_capacity(by):
    rng = random.Random(5)
    counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 101), 60)}
    seats = plan(counts, 100, 4, 10_000, by=by)
    given, held = {}, {}
    for n, first, last, sequence, offset in seats:
        for k in range(first, last + 1):
            assert given.setdefault((n, k), 1)
            held.setdefault(sequence + k - first, []).append((offset, n))
    assert len(given) == sum(counts.values()) == sum(map(len, held.values()))
    for rows in held.values():
        assert len(rows) <= 4 and sum(n for _, n in rows) <= 100 and sum(n * n for _, n in rows) <= 10_000
        assert [o for o, _ in sorted(rows)] == np.cumsum([0] + [n for _, n in sorted(rows)])[:-1].tolist()


def test_quality(spark, docs):
    rng = random.Random(9)
    rows = [(i, prose(rng, 60) if i % 2 else "!!$$ ".join(prose(rng, 3).split(" ") * 20), i % 2) for i in range(400)]
    made = spark.createDataFrame([(i, t, len(t)) for i, t, _ in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i < 200] + [(None, 1), (3, None), (5, 1), (9999, 0)], "doc_id long, quality int")
    model = fit(made, labels)
    got = {r.doc_id: r for r in scored(made, model).collect()}
    assert sum(got[i].predicted == q for i, _, q in rows if i >= 200) >= 195
    out = scored(docs.withColumnRenamed("item_id", "score"), model)
    assert out.columns.count("score") == 1 and out.count() == docs.count() and not out.filter("score < 0 or score > 1 or score is null").count()
    assert scored(docs.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.filter("quality = 1")):
        assert len({round(r.score, 9) for r in scored(docs, fit(made, none)).collect()}) == 1


def test_factorisation_is_the_sum_over_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    d = N_STATS + BUCKETS
    model = Model(0.3, rng.normal(size=d), rng.normal(size=(d, 4)), np.zeros(N_STATS), np.ones(N_STATS))
    for _, stats, rows, buckets, values in features(pa.array(["one two two three", "", None]), np.array([3, -1, 0])):
        got = model.raw(stats, rows, buckets, values)
        for i in range(3):
            x = np.zeros(d)
            x[:N_STATS] = np.clip(stats[i], -4, 4)
            x[N_STATS + buckets[rows == i]] = values[rows == i]
            at = np.flatnonzero(x)
            pairs = sum(model.factors[a] @ model.factors[b] * x[a] * x[b] for k, a in enumerate(at) for b in at[:k])
            assert abs(got[i] - (0.3 + model.linear @ x + pairs)) < 1e-9


def test_url_filter(spark):
    rules = spark.createDataFrame(Q.URL_RULES + [("x.org", "", "block"), ("x.org", "", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["https://EXAMPLE.org/es/a", "http://a.example.org/en/15?q=/es/", "http://example.org/en/2", "https://badexample.org/es/", "http://b.com/fr/x", "http://b.com/de/x#y",
            "http://b.com", "http://x.org", "http://y.x.org?z", "no scheme/es/", None, "", "http://x://example.org/", "ftp://example.org/es", "http://example.org:80/es/", "http://a.net/" + "p" * 5000]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls + urls[:2])], "page_id long, url string, host string, rule int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(pages, rules).collect()}
    known = [(h, p, v) for h, p, v in Q.URL_RULES] + [("x.org", "", "block")]
    for i, u in enumerate(urls + urls[:2]):
        m = re.match(r"(?s)^.*?://([^/?#]*)(/[^?#]*)?", u or "")
        host, path = (lower(m[1]), m[2] or "") if m else ("", "")
        fit_ = [(len(h + p), h + p, v) for h, p, v in known if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit_)[1:] if fit_ else (None, "allow")
        assert got[i] == (host, path, *want), u
    assert judged(pages.limit(0), rules).count() == 0 and judged(pages, rules.limit(0)).filter("verdict != 'allow'").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(20)]
    rows += [(300, None), (350, []), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] + [1.0] * 5), (303, [float("inf")] * 6), (None, [9.0] * 6), (50, rows[50][1]), (304, [1.0, 2.0]), (400, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    live = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, x in {(i, tuple(v)) for i, v in live if i % 50 == 0}:
        best = sorted((-int(np.dot(x, v)), i) for i, v in live if i != q and len(v) == len(x))[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in top_k(df).select("query_id", "rank", "vec_id", "score").collect()} == want
    assert top_k(df.limit(0)).count() == 0


def test_top_k_keeps_large_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0**23, 0.0]), (2, [-(2.0**40), 1.0]), (3, [3.0, 3.0]), (4, [float("inf"), 1.0]), (5, [float("nan"), 1.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**39), (3, 256 * 256 * 9), (2, 256 * 256 * (2 - 2**40))]


def test_top_k_cuts_what_64_bits_cannot_hold(spark):
    rows = [(0, [1.0, 1e300]), (1, [1e300, 0.0]), (2, [0.0, -1e300]), (3, [1.0, 1.0]), (4, [0.0, 1e250]), (50, [1.0, 0.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    top = 2**63 - 1
    assert [got[0, r] for r in range(1, 6)] == [(1, top), (3, top), (4, top), (50, 65536), (2, -top)]
    assert [got[50, r] for r in range(1, 6)] == [(1, top), (0, 65536), (3, 65536), (2, 0), (4, 0)]


def test_search_is_exact_for_large_components_and_ties():
    rng = np.random.default_rng(6)
    for scale in (3, 2**30):
        x, q = rng.integers(-scale, scale, (300, 5)), rng.integers(-scale, scale, (7, 5))
        got = list(zip(*(c.tolist() for c in search(np.arange(7) + 1000, q, np.arange(300), x, 5))))
        want = [(1000 + i, c, s) for i in range(7) for s, c in ((-a, b) for a, b in sorted((-sum(int(u) * int(v) for u, v in zip(q[i], x[c])), c) for c in range(300))[:5])]
        assert sorted(got) == sorted(want)


def test_search_holds_bounds_for_a_portion_of_queries_only():
    rng = np.random.default_rng(8)
    x, q = rng.integers(-300, 300, (4096, 2)), rng.integers(-300, 300, (4000, 2))
    tracemalloc.start()
    try:
        got = search(np.arange(4000) * 50, q, np.arange(4096), x, 5)
        assert tracemalloc.get_traced_memory()[1] < 150_000_000
    finally:
        tracemalloc.stop()
    of = {}
    for i, c, s in zip(*(v.tolist() for v in got)):
        of.setdefault(i // 50, set()).add((-s, c))
    for i in range(0, 4000, 97):
        assert of[i] == set(sorted((-int(s), c) for c, s in enumerate(x @ q[i]) if c != i * 50)[:5])


def test_top_k_sends_vectors_in_small_rows(spark, monkeypatch):
    """No row holds a whole block, and queries are not sent to each block, so Arrow batches stay small whatever the input."""
    frame = type(spark.range(0))
    given, before = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: given.append(self) or before(self, *a, **b))
    rng = np.random.default_rng(9)
    rows = [(50 * i, v.tolist()) for i, v in enumerate(rng.normal(size=(5000, 64)))]
    assert top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 25_000
    for df in given:
        binary = [c for c, kind in df.dtypes if kind == "binary"]
        if binary:
            size = F.lit(0) + sum(F.octet_length(c) for c in binary)
            most, total = df.agg(F.max(size), F.sum(size)).first()
            assert most < 50_000 and total < 5000 * 64 * 8 * 2


def test_a_block_that_cannot_reach_the_best_changes_nothing():
    x = np.zeros((3000, 4), np.int64)
    x[:40, 0] = 1000 + np.arange(40)
    best = Best(np.array([7, 9]), np.array([[3, 0, 0, 1], [-1, 0, 0, 0]]), 2)
    best.block(np.arange(3000), x)
    best.block(np.arange(3000, 6000), x * 0)
    assert best.ids.tolist() == [[39, 38], [40, 41]] and best.score.tolist() == [[3117, 3114], [0, 0]]


@pytest.mark.parametrize("scale", [3, 2**12, 2**30])
def test_blocks_that_pass_by_give_what_all_pairs_give(scale):
    """Sorted lists that let queries stop early among them; ids of queries and candidates repeat."""
    rng = np.random.default_rng(scale)
    x = (rng.integers(-scale, scale, (900, 3)) * rng.choice([0, 0, 1, 7], (900, 1))).astype(np.int64)
    ids = rng.integers(0, 700, 900)
    q_ids, q = rng.integers(0, 700, 70), rng.integers(-scale, scale, (70, 3))
    best = Best(q_ids, q, 4)
    for at in (0, 3, 300, 600):
        end = {0: 3, 3: 300, 300: 600, 600: 900}[at]
        best.block(ids[at:end], x[at:end])
    for i, v, got, score in zip(best.q_ids, best.q, best.ids, best.score):
        want = sorted((max(1 - 2**63, min(2**63 - 1, -sum(int(a) * int(b) for a, b in zip(v, x[c])))), int(ids[c])) for c in range(900) if ids[c] != i)[:4]
        assert [(-s, c) for s, c in zip(score.tolist(), got.tolist())] == want


def test_licenses(docs, spark):
    mit = "MIT notice. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Program without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    rows = [(1, "x " * 5000 + mit), (2, "Licensed under CC BY-NC 4.0.\nother text"), (3, "the license under version 2"), (4, None), (5, (mit + " ") * 3), (5, "")]
    got = {r.doc_id: r for r in scanned(spark.createDataFrame(rows, "doc_id long, text string").filter("text is null or text != ''")).collect()}
    assert got[1].license == "MIT" and got[1].variant == 1 and 0.9 < got[1].coverage < 1 and got[1].first_word >= 5000
    assert got[2].license == "CC-BY-NC-4.0" and got[2].coverage == 1 and (got[2].first_word, got[2].last_word) == (0, 6)
    assert got[3].license is None and got[4].license is None and got[5].license == "MIT"
    assert scanned(docs).count() == docs.count() and scanned(docs.limit(0)).count() == 0


def test_licenses_are_told_from_their_siblings(spark):
    texts, rng = known_texts(), random.Random(4)
    damaged = {n: " ".join("zz" if rng.random() < 0.04 and "version" not in w.lower() else w for w in texts[n][-1].split(" ")) for n in ("BSD-3-Clause", "BSD-2-Clause", "MIT")}
    want = {
        "Released under the BSD License": None, "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0", "Licensed under CC BY 3.0": None, "Licensed under CC BY 4.0": "CC-BY-4.0",
        "This work is licensed under the GNU General Public License, version 2": "GPL-2.0", "Licensed under the Apache License, Version 1.1": None,
        "This work is licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0", "Released under MIT License": "MIT", "mit der Lizenz, released under the license": None,
        **{v[-1]: n for n, v in texts.items()}, **{t: n for n, t in damaged.items()},
    }
    got = {r.text: r for r in scanned(spark.createDataFrame(enumerate(want), "doc_id long, text string")).join(spark.createDataFrame(enumerate(want), "doc_id long, text string"), "doc_id").collect()}
    assert {t[:200]: got[t].license for t in want} == {t[:200]: n for t, n in want.items()}
    assert got["Released under the BSD License"].coverage == 0.8 and got[texts["BSD-3-Clause"][-1]].n_matched > 200


def test_licenses_with_inserted_words_at_every_offset(spark):
    rng = random.Random(9)
    notices = ["Released under the MIT License".split(), known_texts()["MIT"][1].split()]
    rows = []
    for notice in notices:
        for times in (1, 2, 3):
            for offset in range(0, 2 * len(notice), 1 + len(notice) // 9):
                words = ["x"] * offset + [w for n in notice for w in [n] + ([] if n == "MIT" else ["y"] * rng.randrange(2 * times))] + ["x"] * 9
                rows.append((len(rows), " ".join(words)))
    for r in scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.license, r.coverage) == ("MIT", 1.0), r


def test_alignment_is_increasing_and_equal():
    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = aligned(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
    assert len(aligned(list("abcXdefg"), list("abcdYefg"))) == 7


def test_quotations(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nThanks"), (1, 1, "assistant", "Use sorted."), (1, 2, "user", "> how do  I sort?\n> Thanks\nanother way"),
        (1, 3, "assistant", "You wrote:\n>> How do I sort?\n> another way\n\nNo."), (1, 4, "user", "> never said\nwhat"), (1, 4, "user", "> never said\nwhat"),
        (2, 0, "user", None), (2, 1, "user", ""), (2, None, "user", "> a"), (None, 3, "user", "> a\nb"), (3, 5, "user", "> a\nc"), (3, 7, "user", "a"), (3, 9, "user", ">a\n> b"),
    ] + [(4, t, "user", "same" if t % 2 == 0 else "> same") for t in range(2000, 2100)]
    df = spark.createDataFrame([r + (1,) for r in rows], "conv_id long, turn long, role string, text string, root int")
    got = reply_ordered(df).collect()
    assert len(got) == len(rows)
    one = {(r.conv_id, r.turn): r for r in got}
    at = lambda c, t: (one[c, t].reply_turn, one[c, t].root_turn, one[c, t].depth, one[c, t].n_quoted, one[c, t].n_linked, one[c, t].text)
    assert at(1, 2) == (0, 0, 1, 2, 2, "another way")
    assert at(1, 3) == (2, 0, 2, 2, 2, "No.")
    assert at(1, 4) == (None, 4, 0, 1, 0, "what")
    assert at(3, 9) == (7, 7, 1, 2, 1, "") and at(3, 5) == (None, 5, 0, 1, 0, "c")
    assert at(2, 0) == (None, 0, 0, 0, 0, "") and one[None, 3].reply_turn is None and one[2, None].root_turn is None
    assert all(one[4, t].reply_turn == t - 1 for t in range(2001, 2100, 2))
    assert reply_ordered(df.limit(0)).count() == 0


def test_quotations_wrapped_and_partial(spark):
    long = "The order of rows in a table is not kept unless you ask for it with a sort"
    rows = [
        (1, 0, long + "\nThanks\nYes"), (1, 1, "Thanks\nYes"), (1, 2, "> The order of rows in a\n> table is not kept unless\n> you ask for it with a sort\n\n> Thanks\n\n> Yes\nwhy"),
        (1, 3, "> rows in a table is\nwhich rows"), (1, 4, "> not kept with a sort\nno such words in a row"),
        (2, 0, "One paragraph that\nwas wrapped by hand\nlong ago"), (2, 1, "later"), (2, 2, "> One paragraph that was wrapped by hand long ago\nyes"),
        (2, 3, "so was this later thing"), (2, 4, "> later\nok"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_turn, r.n_quoted, r.n_linked) for r in reply_ordered(df).collect()}
    assert got[1, 2] == (0, 5, 5) and got[1, 3] == (0, 1, 1) and got[1, 4] == (None, 1, 0)
    assert got[2, 2] == (0, 1, 1) and got[2, 4] == (1, 1, 1)


def test_removing_takes_little_memory_for_each_byte():
    """Counts of strings over a byte fit 8 bits; texts are not copied once more."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(3000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 3000, 500)) for _ in range(1200)]
    n = len(texts)
    docs = pa.table({"id": pa.array(range(n), pa.int64()), "text": texts, "carried": [{"row": True}] * n, "chunk": pa.array([0] * n, pa.int32())})
    told = pa.table({"chunk": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
    run, size = _removed(50), sum(map(len, texts))
    run(docs, told)  # powers are made once
    tracemalloc.start()
    run(docs, told)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * size


@pytest.mark.parametrize("step", ["grams", "runs", "removed"])
def test_anchors_of_a_chunk_take_little_memory(step):
    """Numbers and classes of the anchors are held once, in the room that they need."""
    rng = np.random.default_rng(2)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(3000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 3000, 500)) for _ in range(1200)]
    n = len(texts)
    docs = pa.table({"id": pa.array(range(n), pa.int64()), "text": texts, "carried": [{"row": True}] * n, "chunk": pa.array([0] * n, pa.int32())})
    told = pa.table({"chunk": pa.array([0], pa.int32()), "bucket": pa.array([9], pa.int32()), "data": pa.array([b""], pa.binary())})
    run, given = {"grams": (_grams(50, 4), [docs]), "runs": (_runs(50, 4), [docs, told]), "removed": (_removed(50), [docs, told.slice(0, 0)])}[step]
    run(*given)  # powers are made once
    tracemalloc.start()
    run(*given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 7 * sum(map(len, texts))


def test_workers_give_memory_back():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def run(table):
        blocks = [b"x" * 100_000 for _ in range(2500)]
        kept.append(blocks[-1])  # at the end of the heap
        return table

    kept, before = [], held()
    lean_group(run)(None)
    assert held() - before < 100e6
