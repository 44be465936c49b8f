"""What the n-gram join makes of one large group of near copies grows with the group, not with its square."""

import random

import pytest

from tidemark.llm import ngram_join

WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku".split() for b in "lan mer nis por tun".split()]


def near_copies(n):
    """A text and copies of it, a third of them equal, the others with one to four words changed."""
    rng = random.Random(11)
    base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(150)]
    out = [(0, " ".join(base))]
    for i in range(1, n):
        words = list(base)
        for _ in range(rng.randint(1, 4) if i % 3 else 0):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(10 ** 6))
        out.append((i, " ".join(words)))
    return out


def shingles(text):
    words = text.split(" ")
    return frozenset(tuple(words[i: i + 5]) for i in range(len(words) - 4))


def components(rows):
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if top(i) != top(j) and 4 * len(a & b) >= 3 * len(a | b):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i: top(i) for i, _ in rows}


@pytest.fixture
def made(monkeypatch):
    counts, plain = [], ngram_join.stage

    def counting(df, name):
        out = plain(df, name)
        if name in ("pairs", "groups", "stars"):
            counts.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "stage", counting)
    return counts


def test_pairs_grow_with_the_group(spark, made):
    most = []
    for n in (200, 800):
        made.clear()
        rows = near_copies(n)
        got = {r.doc_id: r.component_id for r in ngram_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == components(rows)
        most.append({name: max(c for k, c in made if k == name) for name, _ in made})
    for name in most[1]:
        assert most[1][name] <= 5 * max(most[0][name], 100), (name, most)


def linked(spark, rows):
    return {r.doc_id: r.component_id for r in ngram_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_rows_of_tiles_do_not_grow_with_the_tasks(spark, monkeypatch):
    """A group is cut by its size, not by the tasks that hold it."""
    sent, plain = [], ngram_join._tiles

    def counting(*given):
        out = plain(*given)
        sent.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_tiles", counting)
    rows = near_copies(300)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert linked(spark, rows) == components(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert 0 < max(sent) <= 10 * len(rows), sent


def chain(n):
    """Each text shares more words with the next one than the threshold asks, and less with the one after that."""
    words = [f"w{i}" for i in range(60 + 6 * n)]
    return [(i, " ".join(words[6 * i: 6 * i + 60])) for i in range(n)]


def test_groups_of_many_blocks(spark, monkeypatch):
    """Sets of a group that lie in different blocks, and in different bands of sizes, are compared."""
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 16)
    rng, line = random.Random(5), " ".join(f"l{i}" for i in range(40))
    rows = near_copies(150)
    rows += [(1000 + i, line + "".join(f" x{i}.{j}" for j in range(rng.randint(0, 25)))) for i in range(120)]
    rows += [(2000 + i, t) for i, t in chain(30)]
    assert linked(spark, rows) == components(rows)
