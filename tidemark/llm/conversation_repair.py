"""Conversation structure repair: the cheapest edits to an alternating conversation, by the auction shortest-path algorithm.

A node of the lattice is (messages read, state): nothing written yet, after a system message, after a user's, after an assistant's. Arcs keep, rerole or
delete the next message or insert an empty one, and cost whole numbers. An auction for a node builds a path from it: where the price of the path's last node is below the
best arc (cost plus price of its end), the price rises to that and the path gives the node up again; else the path is extended along that
arc, until it meets a node whose price is known to be its distance. Prices never fall and never pass a distance, so at the end all of the path is exact. The edits are then traced
from the start along tight arcs, the least letter first; an arc that only looks tight is auctioned before it is taken.

Messages are ordered by a range partitioning over conversation and turn, so a conversation of any size is spread over many parts. One within a part is
repaired there, in blocks of ``BLOCK`` messages: distances at the end of a block are where the auction of the block before it ends. Of one that
crosses parts each part tells its distances between the states; these are added up backwards, and the parts then trace from each
state that they may be entered in. What meets in one place for a conversation is a few numbers for each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import small_or_shuffled
from tidemark.operators.staging import stage

#: Messages a block of the lattice; an auction takes steps in proportion to its faults times its messages.
BLOCK = 64
#: What a part holds at most, about.
PART_BYTES, PART_ROWS = 32 << 20, 250_000

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = b" \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60


def _after(state: int) -> int:
    """What must be written next."""
    return ASSISTANT if state == USER else USER


def _arcs(initial: str, fault: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of the edits of a message, the least letter first."""
    out = [("D", DELETE, state)]
    if fault in ("", "truncated"):
        more = TRUNCATED if fault else 0
        fits = {"s": state == START, "u": state != USER, "a": state == USER}.get(initial, False)
        if fits:
            out.append(("K", more, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial]))
        out.append(("R", REROLE + more, _after(state)))
    return out


_ARCS = {(i, f): [_arcs(i, f, q) for q in range(4)] for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


class Lattice:
    """A block of messages, given as (initial, fault), and the distances from the states at its end.

    ``ends`` has None for a state in which it cannot end; then messages may be inserted there. Between blocks that is left to the next.
    """

    def __init__(self, messages: list[tuple[str, str]], ends: list[int | None]):
        # Prices start at nothing and rise in small steps, so distances are counted from the nearest end.
        self.beyond = min(e for e in ends if e is not None)
        self.messages, self.ends = messages, [None if e is None else e - self.beyond for e in ends]
        self.exit = 4 * (len(messages) + 1)
        self.price = [0] * (self.exit + 1)
        self.exact = [False] * self.exit + [True]

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        at, state = divmod(node, 4)
        insert = ("I", INSERT, 4 * at + _after(state))
        if at == len(self.messages):
            end = [] if self.ends[state] is None else [("", self.ends[state], self.exit)]
            return end + [insert] if None in self.ends else end
        rest = [(letter, cost, 4 * at + 4 + q) for letter, cost, q in _ARCS[self.messages[at]][state]]
        return [rest[0], insert, *rest[1:]]

    def distance(self, state: int) -> int:
        """From ``state`` at the start of the block."""
        return self.settle(state) + self.beyond

    def settle(self, node: int) -> int:
        """The price of ``node`` at its distance, by auction."""
        path, price, exact = [node], self.price, self.exact
        while not exact[path[-1]]:
            last = path[-1]
            best, to = FAR, -1
            for _, cost, end in self.arcs(last):
                if cost + price[end] < best:
                    best, to = cost + price[end], end
            if price[last] < best:
                price[last] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        for n in path:
            exact[n] = True
        return price[node]

    def trace(self, state: int) -> tuple[str, int]:
        """The least letters of a shortest path from ``state``, and the state at the end of the block."""
        letters, node = [], state
        self.settle(node)
        while node != self.exit:
            last = node
            for letter, cost, end in self.arcs(node):
                if cost + self.price[end] == self.price[last] and cost + self.settle(end) == self.price[last]:
                    letters.append(letter)
                    node = end
                    break
        return "".join(letters), last % 4


FINAL: list[int | None] = [0, None, None, 0]


def lattices(messages: list[tuple[str, str]], ends: list[int | None]) -> list[Lattice]:
    """The blocks of a stretch of messages, auctioned from the last to the first."""
    out: list[Lattice] = []
    for at in reversed(range(0, len(messages), BLOCK)):
        out.append(Lattice(messages[at:at + BLOCK], ends))
        if at:
            ends = [out[-1].distance(q) for q in range(4)]
    return out[::-1]


def traced(blocks: list[Lattice], state: int) -> tuple[str, int]:
    letters = []
    for block in blocks:
        told, state = block.trace(state)
        letters.append(told)
    return "".join(letters), state


def distances(messages: list[tuple[str, str]]) -> list[list[int]]:
    """By state at the start, then at the end of a stretch, inserting at its end included; FAR where there is no way."""
    n = len(messages)
    out = [[FAR] * 4 for _ in range(4)]
    # Nothing written, or nothing but a system message: all others are deleted.
    out[START][START] = out[SYSTEM][SYSTEM] = DELETE * n
    kept = [TRUNCATED if f else 0 for i, f in messages if i == "s" and f in ("", "truncated")]
    out[START][SYSTEM] = DELETE * (n - 1) + min(kept) if kept else FAR
    for goal in (USER, ASSISTANT):
        first = lattices(messages, [0 if q == goal else None for q in range(4)])[0]
        for q in range(4):
            out[q][goal] = first.distance(q)
    return out


def edited(messages: Iterable[tuple[str, bytes]], letters: str, state: int) -> Iterator[tuple[str, str, bytes]]:
    """(letter, role, text) of what a repair writes."""
    rest = iter(messages)
    for letter in letters:
        role, text = ("", b"") if letter == "I" else next(rest)
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = _after(state)
            role = role if letter == "K" else ROLES[state]
        yield letter, role, text


def _line(role: str, text: bytes) -> bytes:
    return role.encode() + b":" + text


class _Stretch:
    """The messages of one conversation in one part, in order."""

    def __init__(self, rows: list[tuple], first: set[int]):
        self.turns = [r[0] for r in rows if r[0] is not None]
        self.texts = [(r[1], r[2]) for r in rows]
        self.faults = [self._fault(text, at in first) for _, _, text, at in rows]
        self.messages = [(role[:1] if role[:1] in ("s", "u", "a") else "", f) for (role, _), f in zip(self.texts, self.faults)]
        self.initials = [role[:1] for role, _ in self.texts]

    @staticmethod
    def _fault(text: bytes, is_first: bool) -> str:
        body = text.rstrip(BLANKS)
        return "blank" if not body else "duplicate" if not is_first else "" if body[-1:] in (b".", b"!", b"?") else "truncated"

    def facts(self) -> dict:
        tally = {k: self.faults.count(k) for k in ("blank", "duplicate", "truncated")}
        return tally | {
            "illegal": sum(a + b not in LEGAL for a, b in zip(self.initials, self.initials[1:])), "first": self.initials[0], "last": self.initials[-1],
            "min_turn": self.turns[0] if self.turns else None, "max_turn": self.turns[-1] if self.turns else None, "turns": len(set(self.turns)),
        }


_FACTS = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
          ("min_turn", pa.int64()), ("max_turn", pa.int64()), ("turns", pa.int64())]
_FACT_TYPES = "blank long, duplicate long, truncated long, illegal long, first string, last string, min_turn long, max_turn long, turns long"


def _blocks(s: _Stretch, given: dict) -> list[Lattice]:
    return lattices(s.messages, FINAL if given["final"] else given["ends"])


def _moves(conv, s: _Stretch, given: dict) -> Iterator[dict]:
    blocks = _blocks(s, given)
    for entry in range(4):
        yield {"conv_id": conv, "part": given["part"], "entry": entry, "exit": traced(blocks, entry)[1]}


class Repair:
    """The repair of the messages in ``conversations``: conv_id, turn, role, text.

    Messages are taken by turn (null first), then role, then the text's SHA-256; equal ones in any order. A null role or text counts as one space, a null conv_id is a
    conversation like any other. The first that holds is a message's fault: blank, duplicate (role and text seen before), truncated. Other columns are not
    looked at, whatever their names. An empty table gives empty results.
    """

    def __init__(self, conversations: DataFrame):
        id_type = conversations.schema["conv_id"].dataType
        self.id_type, self.arrow_id = id_type.simpleString(), pa.int64() if id_type.simpleString() == "bigint" else pa.string()
        if self.id_type not in ("bigint", "string"):
            raise TypeError("conv_id must be a long or a string")
        rows = conversations.select(
            "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
        self.rows = stage(self._ordered(rows), "messages")
        # The earliest of equal messages, by place; a place is met by one row, however often its text occurs.
        same = self.rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("part", "idx")).alias("at"))
        self.first = stage(same.select("at.part", "at.idx"), "first")
        self.stretches = stage(self._judged(), "stretches")

    @staticmethod
    def _ordered(rows: DataFrame) -> DataFrame:
        """Rows with their part and their place in it; rows are counted first, and parts are sized by that."""
        n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS), -(-(size or 0) // PART_BYTES))
        # The number of a row keeps apart what is equal in all else, so that no part must hold all of it.
        order = ["conv_id", "turn", "role", "digest", "tie"]
        rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("tie", F.monotonically_increasing_id())
        rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
        return rows.withColumn("part", F.spark_partition_id()).withColumn("idx", F.monotonically_increasing_id())

    def _judged(self) -> DataFrame:
        """One row for each stretch. The first and the last of a part may go on elsewhere: these tell distances; the others are repaired."""
        schema = pa.schema([("conv_id", self.arrow_id), ("part", pa.int32()), ("open", pa.bool_()), *_FACTS, ("cost", pa.int64()), ("audit", pa.string()),
                            ("repaired_sha256", pa.string()), ("distances", pa.list_(pa.int64()))])

        def judge(rows: pa.Table, first: pa.Table) -> pa.Table:
            found = _stretches(rows, first)
            part = rows.column("part")[0].as_py() if rows.num_rows else 0
            out = []
            for n, (conv, s) in enumerate(found):
                row = {"conv_id": conv, "part": part, "open": n in (0, len(found) - 1), **s.facts()}
                if row["open"]:
                    row["distances"] = [d for ds in distances(s.messages) for d in ds]
                else:
                    blocks = lattices(s.messages, FINAL)
                    row["audit"], _ = traced(blocks, START)
                    row["cost"] = blocks[0].distance(START)
                    lines = b"\n".join(_line(role, text) for _, role, text in edited(s.texts, row["audit"], START))
                    row["repaired_sha256"] = hashlib.sha256(lines).hexdigest()
                out.append(row)
            return pa.Table.from_pylist(out, schema)

        types = f"conv_id {self.id_type}, part int, open boolean, {_FACT_TYPES}, cost long, audit string, repaired_sha256 string, distances array<long>"
        return self.rows.drop("digest").groupBy("part").cogroup(self.first.groupBy("part")).applyInArrow(judge, types)

    def conversations(self) -> DataFrame:
        """One row for each conversation with a message: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        whole = self.stretches.filter("NOT open")
        opened = stage(self._met(), "met")
        ends = stage(self._digests(opened), "digests")
        told = opened.filter("part = first_part").drop("part", "first_part", "entry")
        told = told.alias("t").join(ends.alias("e"), F.col("t.conv_id").eqNullSafe(F.col("e.conv_id"))).select("t.*", "e.audit", "e.repaired_sha256")
        gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
        columns = ["conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return whole.select(*columns).unionByName(told.select(*columns))

    def _met(self) -> DataFrame:
        """For each open stretch the state that its conversation enters it in, and the facts of the whole conversation."""
        slim = self.stretches.filter("open").select("conv_id", "part", "distances", *[n for n, _ in _FACTS])
        types = f"conv_id {self.id_type}, part int, ends array<long>, final boolean, first_part int, cost long, {_FACT_TYPES}"
        schema = pa.schema([("conv_id", self.arrow_id), ("part", pa.int32()), ("ends", pa.list_(pa.int64())), ("final", pa.bool_()), ("first_part", pa.int32()),
                            ("cost", pa.int64()), *_FACTS])

        # A conversation has at most one stretch a part, of some hundred bytes.
        def add_up(table: pa.Table) -> pa.Table:
            parts = sorted(table.to_pylist(), key=lambda r: r["part"])
            to_go, ends = [0, 2 * INSERT, INSERT, 0], []
            for r in reversed(parts):
                ends.append(to_go)
                way = r["distances"]
                to_go = [min(way[4 * q + e] + to_go[e] for e in range(4)) for q in range(4)]
            whole = dict(parts[0])
            for r in parts[1:]:
                for k in ("blank", "duplicate", "truncated", "illegal"):
                    whole[k] += r[k]
                whole["illegal"] += whole["last"] + r["first"] not in LEGAL
                whole["turns"] += r["turns"] - (r["turns"] > 0 and r["min_turn"] == whole["max_turn"])
                whole["min_turn"] = r["min_turn"] if whole["min_turn"] is None else whole["min_turn"]
                whole["max_turn"] = whole["max_turn"] if r["max_turn"] is None else r["max_turn"]
                whole["last"] = r["last"]
            facts = {n: whole[n] for n, _ in _FACTS}
            return pa.Table.from_pylist([
                {"conv_id": r["conv_id"], "part": r["part"], "ends": e, "final": r is parts[-1], "first_part": parts[0]["part"], "cost": to_go[START], **facts}
                for r, e in zip(parts, reversed(ends))
            ], schema)

        ways = stage(slim.groupBy("conv_id").applyInArrow(add_up, types), "ways")
        moves = stage(self._per_stretch(ways, _moves, f"conv_id {self.id_type}, part int, entry int, exit int"), "moves")

        entered = pa.schema([("conv_id", self.arrow_id), ("part", pa.int32()), ("entry", pa.int32())])

        def follow(table: pa.Table) -> pa.Table:
            steps: dict[int, dict[int, int]] = {}
            for r in table.to_pylist():
                steps.setdefault(r["part"], {})[r["entry"]] = r["exit"]
            state, out = START, []
            for part in sorted(steps):
                out.append({"conv_id": table.column("conv_id")[0].as_py(), "part": part, "entry": state})
                state = steps[part][state]
            return pa.Table.from_pylist(out, entered)

        entries = moves.groupBy("conv_id").applyInArrow(follow, f"conv_id {self.id_type}, part int, entry int")
        same = F.col("w.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("w.part") == F.col("e.part"))
        return ways.alias("w").join(entries.alias("e"), same).select("w.*", "e.entry")

    def _per_stretch(self, given: DataFrame, make, types: str, whole: DataFrame | None = None) -> DataFrame:
        """``make(conv, stretch, its row of given)`` for the stretches in ``given``, at most two for each part."""
        given = small_or_shuffled(given) if whole is None else whole
        same = F.col("m.conv_id").eqNullSafe(F.col("g.conv_id")) & (F.col("m.part") == F.col("g.part"))
        extra = [c for c in given.columns if c in ("ends", "final", "entry")]
        rows = self.rows.alias("m").join(given.alias("g"), same).select("m.conv_id", "m.part", "turn", "role", "text", "idx", *[f"g.{c}" for c in extra])
        first = self.first.alias("f").join(F.broadcast(given.select("part").distinct()).alias("p"), F.col("f.part") == F.col("p.part"), "left_semi")

        def run(rows: pa.Table, first: pa.Table) -> pa.Table:
            found = _stretches(rows, first, extra)
            return pa.Table.from_pylist([r for conv, s, g in found for r in make(conv, s, g)], schema)

        names = [t.strip().split()[0] for t in types.split(",")]
        kinds = {"conv_id": self.arrow_id, "audit": pa.string(), "data": pa.binary(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}
        schema = pa.schema([(n, kinds.get(n, pa.int64() if n == "place" else pa.int32())) for n in names])
        return rows.groupBy("part").cogroup(first.groupBy("part")).applyInArrow(run, types)

    def _digests(self, opened: DataFrame) -> DataFrame:
        """Audit and digest of the conversations that cross parts: their lines pass through one task in order, as a digest wants them, and are not held."""
        def lines(conv, s, given):
            letters, _ = traced(_blocks(s, given), given["entry"])
            held, size, n = [], 0, 0
            for _, role, text in edited(s.texts, letters, given["entry"]):
                held.append(_line(role, text) + b"\n")
                size += len(held[-1])
                if size > 1 << 20:
                    yield {"conv_id": conv, "part": given["part"], "piece": n, "audit": "", "data": b"".join(held)}
                    held, size, n = [], 0, n + 1
            yield {"conv_id": conv, "part": given["part"], "piece": n, "audit": letters, "data": b"".join(held)}

        pieces = self._per_stretch(opened, lines, f"conv_id {self.id_type}, part int, piece int, audit string, data binary")
        pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
        schema = pa.schema([("conv_id", self.arrow_id), ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, open_, letters, h, tail = None, False, [], hashlib.sha256(), b""

            def done() -> pa.RecordBatch:
                h.update(tail[:-1])
                return pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(letters), "repaired_sha256": h.hexdigest()}], schema)

            for batch in batches:
                for i in range(batch.num_rows):
                    r = {c: batch.column(c)[i].as_py() for c in ("conv_id", "audit", "data")}
                    if open_ and r["conv_id"] != conv:
                        yield done()
                        open_ = False
                    if not open_:
                        conv, open_, letters, h, tail = r["conv_id"], True, [], hashlib.sha256(), b""
                    letters.append(r["audit"])
                    if r["data"]:
                        h.update(tail)
                        tail = r["data"]
            if open_:
                yield done()

        return pieces.mapInArrow(digest, f"conv_id {self.id_type}, audit string, repaired_sha256 string")

    def messages(self) -> DataFrame:
        """The repaired messages, spread as the given ones are: conv_id, part, place (order in the part), edit (its letter), role, text."""
        met = self._met().select("conv_id", "part", "ends", "final", "entry")
        closed = self.stretches.filter("NOT open").select(
            "conv_id", "part", F.lit(None).cast("array<long>").alias("ends"), F.lit(True).alias("final"), F.lit(START).alias("entry"))
        given = stage(closed.unionByName(met), "given")

        def write(conv, s, given):
            letters, _ = traced(_blocks(s, given), given["entry"])
            for n, (letter, role, text) in enumerate(edited(s.texts, letters, given["entry"])):
                yield {"conv_id": conv, "part": given["part"], "place": s.at + n, "edit": letter, "role": role, "text": text.decode()}

        return self._per_stretch(given, write, f"conv_id {self.id_type}, part int, place long, edit string, role string, text string", whole=given)


def _stretches(rows: pa.Table, first: pa.Table, extra: Iterable[str] = ()) -> list:
    """(conversation, stretch) of a part in order, each with its row of ``extra`` where asked."""
    rows = rows.sort_by("idx")
    earliest = set(first.column("idx").to_pylist())
    convs, parts = rows.column("conv_id").to_pylist(), rows.column("part").to_pylist()
    told = list(zip(rows.column("turn").to_pylist(), rows.column("role").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist(), rows.column("idx").to_pylist()))
    out, at, extra = [], 0, list(extra)
    for n in range(1, len(convs) + 1):
        if n == len(convs) or convs[n] != convs[at]:
            s = _Stretch(told[at:n], earliest)
            s.at = 5 * at  # a repair writes at most five messages for one
            given = {c: rows.column(c)[at].as_py() for c in extra} | {"part": parts[at]}
            out.append((convs[at], s, given) if extra else (convs[at], s))
            at = n
    return out
