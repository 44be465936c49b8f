"""Personal data, periodic runs and conversation repair against plain versions and their SQL, on small tables with the awkward cases."""

import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.compare import compare
from tidemark.llm import conversation_repair as C
from tidemark.llm import queries as Q
from tidemark.llm.periodic_runs import periodic_runs, runs_of
from tidemark.llm.personal_data import personal_data

CLASH = {"spans": "x", "runs": 1, "n": 2, "part": 3, "idx": 4, "digest": "d", "h": 5, "found_email": "y"}


def table_dir(tmp_path, name, rows, columns, types):
    """A folder that a query can read, with further columns whose names the operators use themselves."""
    data = {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(columns, types))}
    data |= {c: pa.array([v] * len(rows)) for c, v in CLASH.items()}
    pq.write_table(pa.table(data), tmp_path / f"{name}.parquet")
    return str(tmp_path)


def doc_dir(tmp_path, texts):
    rows = [(i, t, None) for i, t in texts]
    return table_dir(tmp_path, "documents", rows, ("doc_id", "text", "lang"), (pa.int64(), pa.string(), pa.string()))


# Personal data

def luhn_ok(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    """The contract's base spans, by its own patterns."""
    t, out = text or "", []
    for k, kind, p in (
        (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), (1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        (2, "card", r"[0-9]([\x20-]?[0-9])+"), (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                0: True, 1: k == 1 and all(int(x) <= 255 for x in m[0].split(".") if k == 1), 2: 16 <= len(digits) <= 19 and luhn_ok(digits), 3: 8 <= len(digits) <= 15,
            }[k]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


PII = [
    "a@b.c.@d.e x a@b.c_d@e.f a@b@c.d", None, "", "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.1 1.2.3", "4111 1111 1111 1111 card 378282246310005, 4111111111111111 1234",
    "visa 4111111111111111 1234 é😀 +1 (555) 555-1234 x +1.2.3.4", "call (555) 123-4567 or 555-123-4567.", "IBAN GB82 WEST 1234 5698 7654 32 IS and DE89370400440532013000",
    "DE89370400440532013001 GB82WEST12345698765432X XX82WEST12345698765432", "version 555-123-4567 tel 555-123-4567 9", "😀 a@b.cc\n+49 30 1234567\t+1 2", "a@b.co " * 700,
    "1" * 5000 + " card", "a@a" + ".b" * 5000, "+1" + " " * 5000 + "1", "x" * 5000 + "@", "card 378282246310006 amex 378282246310005 invoice", "a@b.c", "a@b.c",
    "99999999999999999999.1.1.1 0000000000000000000000000000000000000000000001.1.1.1", "phone:+1 555 555 1234,+1 555 555 1234; 12345-678-9012 tel",
]


def test_personal_data(spark, tmp_path):
    texts = [(None if i == 5 else i // 2, t) for i, t in enumerate(PII)]
    sf_dir = doc_dir(tmp_path, texts)
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert sorted(([(s.kind, s.start, s.end) for s in r.spans if s.base] for r in found)) == sorted(plain_base(t) for _, t in texts)
    for r in found:
        for s in r.spans:
            assert any((t or "")[s.start:s.end] == s.found for i, t in texts if i == r.doc_id) and (s.base or s.score >= 60)
    added = sorted((s.kind, s.found) for r in found for s in r.spans if not s.base)
    assert added == sorted([
        ("card", "378282246310005"), ("card", "4111111111111111"), ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32"),
        ("phone", "(555) 123-4567"), ("phone", "12345-678-9012"),
    ])
    assert compare(spark, "op11", Q.QUERIES["op11_personal_data"], Q.SQL["op11_personal_data"], sf_dir)[0] is None


def test_personal_data_of_nothing(spark):
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Periodic runs

def plain_runs(words, least=6, times=4):
    out = set()
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            s = words[i:j + q]
            if j > i and len(s) >= max(least, times * q) and not any(s[d:] == s[:-d] for d in range(1, q)):
                out.add((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(1500):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            words = [rng.choice([b"a", b"b", b"c"][:rng.choice((1, 2, 3))]) for _ in range(rng.randrange(40))]
            if rng.random() < 0.5 and words:
                unit = words[:rng.randrange(1, 6)]
                words += unit * rng.randrange(2, 9) + words[:3]
            docs.append(words)
        least, times = rng.choice([(6, 4), (6, 4), (2, 2), (5, 3)])
        assert runs_of(docs, least, times) == [plain_runs(d, least, times) for d in docs]


def test_periodic_runs(spark, tmp_path):
    rng = random.Random(4)
    texts = [(0, None), (1, ""), (2, " \t\n"), (3, "a"), (None, "b " * 9), (None, "b " * 9), (4, "x  a b\na b\ta b a b a é é é é é é"), (4, "x y"), (5, "w " * 20000)]
    texts += [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60)))) for i in range(6, 150)]
    texts += [(200, " ".join([f"w{rng.randrange(400)}" for _ in range(700)] * 5))]
    sf_dir = doc_dir(tmp_path, texts)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()]
    want = []
    for i, t in texts:
        words = (t or "").encode().split()
        runs = [(0, len(words), 1)] if len(words) > 5000 and len(set(words)) == 1 else plain_runs(words)
        gone = {x for s, n, p in runs for x in range(s + p, s + n)}
        want.append((i, len(words), runs, " ".join(w.decode() for x, w in enumerate(words) if x not in gone)))
    assert sorted(found, key=repr) == sorted(want, key=repr)
    small = tmp_path / "small"
    small.mkdir()
    assert compare(spark, "op12", Q.QUERIES["op12_periodic_runs"], Q.SQL["op12_periodic_runs"], doc_dir(small, [t for t in texts if t[0] != 5]))[0] is None
    assert periodic_runs(spark.createDataFrame([], "doc_id string, text string")).count() == 0


# Conversation repair

def plain_repair(messages):
    """(cost, letters) by dynamic programming over whole strings."""
    def inserted(best):
        for _ in range(2):
            for q, (cost, letters) in list(best.items()):
                r, new = C._after(q), (cost + 3, letters + "I")
                best[r] = min(best.get(r, new), new)
        return best

    best = inserted({C.START: (0, "")})
    for initial, fault in messages:
        after = {}
        for q, (cost, letters) in best.items():
            more = 3 * (fault == "truncated")
            moves = [("D", 4, q)]
            if fault in ("", "truncated"):
                moves.append(("R", 3 + more, C._after(q)))
                if initial == "s" and q == C.START:
                    moves.append(("K", more, C.SYSTEM))
                if initial == ("a" if q == C.USER else "u"):
                    moves.append(("K", more, C._after(q)))
            for letter, c, r in moves:
                new = (cost + c, letters + letter)
                after[r] = min(after.get(r, new), new)
        best = inserted(after)
    return min(best[q] for q in (C.START, C.ASSISTANT) if q in best)


def random_messages(rng, n):
    return [(rng.choice(["s", "u", "a", "", "u", "a"]), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]


def test_auction_finds_the_cheapest_least_edits(monkeypatch):
    rng = random.Random(2)
    for _ in range(800):
        messages = random_messages(rng, rng.randrange(1, 12))
        monkeypatch.setattr(C, "BLOCK", rng.choice([1, 2, 3, 64]))
        blocks = C.lattices(messages, C.FINAL)
        want = plain_repair(messages)
        assert (blocks[0].distance(C.START), C.traced(blocks, C.START)[0]) == want
        cuts = sorted(rng.sample(range(1, len(messages)), min(len(messages) - 1, rng.randrange(4)))) if len(messages) > 1 else []
        parts = [messages[a:b] for a, b in zip([0, *cuts], [*cuts, len(messages)])]
        to_go, ends = [0, 6, 3, 0], []
        for part in reversed(parts):
            ends.insert(0, to_go)
            way = C.distances(part)
            to_go = [min(way[q][e] + to_go[e] for e in range(4)) for q in range(4)]
        ends[-1], state, told = C.FINAL, C.START, ""
        for part, end in zip(parts, ends):
            letters, state = C.traced(C.lattices(part, end), state)
            told += letters
        assert (to_go[C.START], told) == want


def test_auction_of_a_long_conversation():
    rng = random.Random(3)
    messages = random_messages(rng, 5000)
    blocks = C.lattices(messages, C.FINAL)
    assert (blocks[0].distance(C.START), C.traced(blocks, C.START)[0]) == plain_repair(messages)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    say = lambda: rng.choice(["Yes.", "No", "Why?", "", " \n", "so be it. ", "what", "été!", None, "\x0b", f"t{rng.random()}."])
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), say()) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(70, t % 190, rng.choice(["user", "assistant"]), say()) for t in range(400)]  # a busy one, with turns that come twice
    rows += [(None, t, r, say()) for t, r in ((0, "user"), (None, "system"), (1, "user"), (1, "user"), (5, "assistant"))]
    rows += [(71, None, "user", "a."), (71, None, "user", "a."), (72, 0, "system", "s."), *[(73, 2, "user", "same.")] * 40]
    rng.shuffle(rows)
    return rows


def repaired_dir(tmp_path, rows):
    return table_dir(tmp_path, "conversations", rows, ("conv_id", "turn", "role", "text"), (pa.int64(), pa.int64(), pa.string(), pa.string()))


@pytest.mark.parametrize("part_rows", [250_000, 9])
def test_conversation_repair(spark, tmp_path, talk, monkeypatch, part_rows):
    """In a few parts, and in so many that conversations cross several of them."""
    monkeypatch.setattr(C, "PART_ROWS", part_rows)
    sf_dir = repaired_dir(tmp_path, talk)
    assert compare(spark, "op13", Q.QUERIES["op13_conversation_repair"], Q.SQL["op13_conversation_repair"], sf_dir)[0] is None


def test_repaired_messages(spark, talk, monkeypatch):
    monkeypatch.setattr(C, "PART_ROWS", 40)
    given = spark.createDataFrame([(str(c) if c is not None else None, t, r, x) for c, t, r, x in talk], "conv_id string, turn long, role string, text string")
    repair = C.Repair(given.repartition(3))
    lines, audits = {}, {r.conv_id: r for r in repair.conversations().collect()}
    for m in sorted(repair.messages().collect(), key=lambda m: (m.part, m.place)):
        lines.setdefault(m.conv_id, []).append(m)
    import hashlib
    for conv, row in audits.items():
        told = lines.get(conv, [])
        assert "".join(m.edit for m in told) == row.audit.replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(m.role[:1] for m in told))
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in told).encode()).hexdigest() == row.repaired_sha256
    assert set(audits) == {str(c) if c is not None else None for c, *_ in talk}


def test_conversation_repair_of_nothing(spark, tmp_path):
    sf_dir = repaired_dir(tmp_path, [])
    assert Q.QUERIES["op13_conversation_repair"](spark, sf_dir).count() == 0


# The held-out fold of the quality classifier

def test_labels_of_the_held_out_fold_are_not_read(spark, tmp_path):
    import zlib

    given = pq.read_table("/root/testdata/sf0.001/labels.parquet")
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    kept_out = [zlib.crc32(str(i).encode()) % 4 == 2 for i in given.column("doc_id").to_pylist()]
    scores = []
    for flip in (False, True):
        folder = tmp_path / str(flip)
        folder.mkdir()
        quality = [1 - q if flip and out else q for q, out in zip(given.column("quality").to_pylist(), kept_out)]
        at = given.schema.get_field_index("quality")
        pq.write_table(given.set_column(at, given.schema.field(at), pa.array(quality, given.schema.field(at).type)), folder / "labels.parquet")
        pq.write_table(docs, folder / "documents.parquet")
        scores.append({r.doc_id: (r.held_out, r.score, r.predicted) for r in Q.QUERIES["op6_quality_classifier"](spark, str(folder)).collect()})
    assert any(kept_out) and scores[0] == scores[1] and len(scores[0]) == docs.num_rows
    for i, (out, score, predicted) in scores[0].items():
        assert out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= score <= 1 and predicted == (score >= 0.7)
