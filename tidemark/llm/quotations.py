"""Chat formatting: quoted passages, the messages they come from, and conversations in reply order without quotes.

DataFrame functions only. Consecutive lines of one quote level (so many ``>``) are a passage, normalised across line ends: lower case,
runs of white space as one blank. A quoted passage is linked to the latest earlier message of its conversation that has all its words in a
row in a passage of its own; where none has, each line is linked likewise. So wrapping may differ, and a quote may be part of a line
or paragraph. Candidates come from hashes of word grams: of each quoted text the gram that the fewest passages have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.staging import stage

MARKS = r"^((?:[ \t]*>)+)"
#: Turns of one block of the search for the latest earlier message.
BLOCK = 1024
#: Words of a gram. Shorter quotes are one gram.
GRAM = 4


def lines(text: Column) -> Column:
    """(level, text) of each line, in order."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda s: F.struct(
        F.length(F.translate(F.regexp_extract(s, MARKS, 1), " \t", "")).alias("level"),
        F.regexp_replace(s, MARKS + "[ \t]?", "").alias("text"),
    ))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def passages(l: Column) -> Column:
    """(level, lines) of each run of lines of one level, the lines normalised and without blank ones."""
    starts = F.filter(F.sequence(F.lit(0), F.size(l) - 1), lambda i: (i == 0) | (F.get(l, i).level != F.get(l, i - 1).level))
    bounds = F.concat(starts, F.array(F.size(l)))
    runs = F.transform(starts, lambda s, i: F.slice(l, s + 1, F.get(bounds, i + 1) - s))
    return F.transform(runs, lambda r: F.struct(
        F.get(r, 0).level.alias("level"), F.filter(F.transform(r, lambda x: normalised(x.text)), lambda t: t != "").alias("lines")))


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, root_turn, turn, reply_turn, depth, role, text, n_quoted, n_linked, max_level) for each row.

    text is what the message says itself: its unquoted lines, without blank lines at either end and without a line that
    only announces a quote (ends in a colon, right before it). n_quoted counts quoted lines that are not blank, n_linked those with a source. reply_turn
    is the message that most words of first-level quoted lines come from (the later of equals), null if none; root_turn is where the chain of replies
    starts, depth its length. By (conv, root_turn, turn) a conversation is in reply order: a message follows what
    it answers. A null text is empty. Rows with a null conversation or turn are kept and link with nothing (root_turn is their turn). Rows
    that repeat a turn are kept, and are one message for links. An empty table gives an empty result; other columns are not read.
    """
    said = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), lines(F.col(text_col)).alias("l"))
    runs = said.filter("conv is not null and turn is not null").select("conv", "turn", F.explode(passages(F.col("l"))).alias("p"))
    runs = runs.select("conv", "turn", "p.level", "p.lines", F.array_join("p.lines", " ").alias("t")).filter("t != ''")
    quoting = runs.filter("level > 0").select("conv").distinct()
    runs = stage(runs.join(quoting, "conv", "left_semi"), "passages")  # of conversations that quote at all
    quoted = runs.filter("level > 0").select("conv", "turn", "level", F.sha2("t", 256).alias("passage"), "t", F.explode("lines").alias("x"))
    units = quoted.select("conv", F.col("t").alias("x")).union(quoted.select("conv", "x")).distinct().withColumn("line", F.sha2("x", 256))
    first = F.col("level") == 1
    quoted = quoted.groupBy("conv", "turn", "passage", F.sha2("x", 256).alias("line")).agg(
        F.sum(F.when(first, F.size(F.split("x", " "))).otherwise(0)).alias("first"), F.count("*").alias("quoted"), F.first(F.size(F.split("x", " "))).alias("words"))
    quoted = stage(quoted, "quoted")
    holders = stage(_holders(stage(units, "units"), runs.filter("level = 0").select("conv", "turn", "lines", "t")), "holders")
    asked = quoted.select("conv", F.col("passage").alias("line"), "turn").union(quoted.select("conv", "line", "turn")).distinct()
    flat = asked.withColumns({"own": F.lit(0), "whole": F.lit(0), "quoted": F.lit(1)}).unionByName(holders.withColumn("quoted", F.lit(0)))
    flat = stage(flat.groupBy("conv", "line", "turn").agg(*(F.max(c).alias(c) for c in ("own", "whole", "quoted"))), "lines")
    latest = _latest(flat, "own").join(_latest(flat, "whole").withColumnRenamed("source", "same"), ["conv", "line", "turn"])
    latest = stage(latest, "latest")
    # a few words also stand in messages that are not meant: of these a line of its own comes first
    sources = quoted.join(latest.select("conv", "turn", F.col("line").alias("passage"), F.col("source").alias("all")), ["conv", "turn", "passage"])
    sources = sources.join(latest, ["conv", "turn", "line"])
    short = F.col("words") < GRAM
    alone = F.when(short, F.coalesce("same", "source")).otherwise(F.col("source"))
    sources = stage(sources.select("conv", "turn", "first", "quoted", F.when(
        (F.col("passage") == F.col("line")) & short, alone).otherwise(F.coalesce("all", alone)).alias("source")), "sources")

    parents = sources.filter("source is not null and first > 0").groupBy("conv", "turn", "source").agg(F.sum("first").alias("n"))
    parents = parents.groupBy("conv", "turn").agg(F.max(F.struct("n", "source")).alias("m")).select("conv", "turn", F.col("m.source").alias("up"))
    roots = _roots(stage(parents.select("conv", "turn", "up"), "parents"))
    linked = sources.filter("source is not null").groupBy("conv", "turn").agg(F.sum("quoted").alias("n_linked"))

    own = F.filter(F.transform("l", lambda x, i: F.struct(
        x.text.alias("text"), x.level.alias("level"), F.coalesce(F.get(F.col("l"), i + 1).level, F.lit(0)).alias("next"))),
        lambda x: (x.level == 0) & ~((x.next > 0) & F.rtrim(x.text).endswith(":")))
    out = said.select(
        "conv", "turn", "role", F.regexp_replace(F.array_join(F.transform(own, lambda x: x.text), "\n"), r"^\s*\n|\s+$", "").alias("text"),
        F.size(F.filter("l", lambda x: (x.level > 0) & (normalised(x.text) != ""))).cast("long").alias("n_quoted"),
        F.array_max(F.transform("l", lambda x: x.level)).alias("max_level"))
    out = out.join(roots, ["conv", "turn"], "left").join(linked, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias(conv_col), F.coalesce("root", "turn").alias("root_turn"), F.col("turn").alias(turn_col), F.col("up").alias("reply_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("role").alias(role_col), F.col("text").alias(text_col), "n_quoted",
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "max_level")


def _grams(k: int) -> Column:
    """Distinct hashes of k words in a row of ``w``; none of fewer words."""
    at = F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: i + k <= F.size("w"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("w", i + 1, k))))


def _holders(units: DataFrame, own: DataFrame) -> DataFrame:
    """(conv, line, turn, own, whole): messages with a passage that has the words of a quoted text in a row (own), and whether they are a line or
    passage of their own (whole)."""
    split = units.select("conv", "line", F.split("x", " ").alias("w")).withColumn("k", F.least(F.size("w"), F.lit(GRAM)))
    grams = F.when(F.col("k") == GRAM, _grams(GRAM)).otherwise(F.array(F.xxhash64("w")))
    asked = stage(split.select("conv", "line", "k", F.explode(grams).alias("gram")), "asked")
    own = stage(own.distinct().withColumn("at", F.sha2("t", 256)), "own")
    texts = own.select("conv", "at", "t", F.split("t", " ").alias("w")).dropDuplicates(["conv", "at"])
    made = F.array(*(F.struct(F.lit(k).alias("k"), _grams(k).alias("grams")) for k in range(1, GRAM + 1)))
    had = texts.select("conv", "at", F.explode(made).alias("g")).select("conv", "at", "g.k", F.explode("g.grams").alias("gram"))
    had = stage(had.join(asked.select("conv", "k", "gram").distinct(), ["conv", "k", "gram"], "left_semi"), "grams")
    often = had.groupBy("conv", "k", "gram").agg(F.count("*").alias("n"))
    rarest = asked.join(often, ["conv", "k", "gram"], "left").groupBy("conv", "line").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k", "gram")).alias("m"))
    rarest = rarest.filter("m.n > 0").select("conv", "line", "m.k", "m.gram")
    pairs = rarest.join(had, ["conv", "k", "gram"]).select("conv", "line", "at").join(units, ["conv", "line"]).join(own, ["conv", "at"])
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    whole = (F.col("t") == F.col("x")) | F.array_contains("lines", F.col("x"))
    return pairs.filter(F.contains(padded("t"), padded("x"))).groupBy("conv", "line", "turn").agg(F.lit(1).alias("own"), F.max(whole.cast("int")).alias("whole"))


def _latest(flat: DataFrame, held: str) -> DataFrame:
    """(conv, line, turn, source): quoted texts with the latest earlier turn that is marked in ``held``. A text's turns are searched in blocks,
    each with the last one of the blocks before, so that a line that everyone repeats is not one task's work."""
    flat = flat.withColumn("block", F.floor(F.col("turn") / BLOCK))
    mine = F.when(F.col(held) == 1, F.col("turn"))
    blocks = flat.groupBy("conv", "line", "block").agg(F.max(mine).alias("last"))
    before = Window.partitionBy("conv", "line").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "line", "block", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("conv", "line", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumn("here", F.max(mine).over(inside)).join(blocks, ["conv", "line", "block"])
    return flat.filter("quoted > 0").select("conv", "line", "turn", F.coalesce("here", "carried").alias("source"))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, up, root, depth) by doubling: in each round a message learns what its so far furthest ancestor knows."""
    far = parents.select("conv", "turn", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = far.select("conv", F.col("turn").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        step = stage(far.join(up, ["conv", "root"], "left").select(
            "conv", "turn", F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            F.col("root2").isNotNull().alias("moved")), "roots")
        far = step.drop("moved")
        if step.filter("moved").isEmpty():
            return parents.join(far, ["conv", "turn"])
