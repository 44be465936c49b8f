"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item, or a whole item of fewer words. Of each run of
``window - gram + 1`` consecutive word grams the one with the least hash is a fingerprint (the first of equals), on both
sides; a shared window has the same one at the same place, so none is missed. Fingerprints of documents are joined with
those of the items; each hit is extended to the windows around it, which are compared with the items' windows word by
word. Items shorter than a window are looked up by all grams of their lengths, as winnowing promises nothing for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import small_or_shuffled
from tidemark.operators.staging import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HIGH = -(1 << 32)  # the bits of a hash that are compared; the place takes the others


def words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), NOT_WORD), "")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 13, gram: int = 8, percent: int = 5,
) -> DataFrame:
    """(id, text_key, n_words, n_hit, n_items, items, items_sha256, contaminated) for each row of ``docs``.

    A-Z are lower-cased; words are runs of ASCII letters and digits and of characters beyond ASCII. A word inside an
    occurrence of a window is hit. A row is contaminated if words are hit, and at least ``percent`` of 100 of them. items are the ids
    of the items with an occurring window, as sorted strings; items without an id count as one item, which is not listed. Null or wordless texts
    have no words and are clean; a null or wordless item has no window. Repeated rows, and rows that share an id (null as well)
    but not a text, are each judged for themselves; text_key, a hash of the text, tells them apart. Empty tables give clean or no
    rows. Other columns are not read.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w"))
    items = stage(items.filter("size(w) > 0"), "items")
    short = sorted(r.n for r in items.select(F.size("w").alias("n")).filter(F.col("n") < window).distinct().collect())  # below window many

    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    split = source.select("id", "text_key", words(F.col("text")).alias("w"))
    fingerprints = stage(_exploded(items.select("item", "w"), window, gram, short).select("mark", "kind").distinct(), "marks")
    found = (
        _exploded(split, window, gram, short).join(small_or_shuffled(fingerprints), ["mark", "kind"], "left_semi")
        .groupBy("id", "text_key").agg(F.collect_set(F.struct("kind", "place")).alias("places"))
    )
    found = small_or_shuffled(stage(found, "hits"))
    same = F.col("d.id").eqNullSafe(F.col("f.id")) & F.col("d.text_key").eqNullSafe(F.col("f.text_key"))
    near = source.alias("d").join(found.alias("f"), same).select("d.id", "d.text_key", words(F.col("d.text")).alias("w"), "f.places")
    occurring = stage(_occurring(near, items, window, gram, short), "windows")

    per_doc = occurring.groupBy("id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", "kind"))).alias("spans"))
    per_doc = per_doc.select("id", "text_key", _covered(F.col("spans")).alias("n_hit"))
    listed = (
        occurring.select("id", "text_key", "same_items").distinct()
        .join(small_or_shuffled(stage(_windows(items, window, short).select("same_items", "item").distinct(), "same")), "same_items")
        .groupBy("id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("int")).alias("unnamed"))
    )
    judged = per_doc.join(listed, per_doc.id.eqNullSafe(listed.id) & per_doc.text_key.eqNullSafe(listed.text_key)).select(
        per_doc.id, per_doc.text_key, "n_hit", "items", "unnamed")
    judged = small_or_shuffled(stage(judged, "judged"))
    sized = split.select("id", "text_key", F.size("w").cast("long").alias("n_words"))
    out = sized.alias("d").join(judged.alias("f"), same, "left").select(
        "d.id", "d.text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("unnamed", F.lit(0)).alias("unnamed"),
    )
    return out.select(
        F.col("id").alias(id_col), "text_key", "n_words", "n_hit", (F.size("items") + F.col("unnamed")).cast("long").alias("n_items"), "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )


def _grams(h: Column, k: int) -> Column:
    """Hash of the k words from each place on, by doubling; the last k - 1 places hold the hash of what is left."""
    have, out = 1, h
    while have < k:
        step = min(have, k - have)
        out = F.zip_with(out, F.slice(out, step + 1, F.greatest(F.size(out), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        have += step
    return out


def _least(marks: Column, width: int) -> Column:
    have, out = 1, marks
    while have < width:
        step = min(have, width - have)
        out = F.zip_with(out, F.slice(out, step + 1, F.greatest(F.size(out), F.lit(1))), lambda a, b: F.least(a, b))
        have += step
    return out


def _placed(h: Column) -> Column:
    return F.transform(h, lambda x, i: x.bitwiseAND(F.lit(HIGH)).bitwiseOR(i.cast("long")))


def _exploded(split: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """(…, kind, mark, place): the fingerprints, of kind ``window``, and all grams of the lengths of short items."""
    names = [c for c in split.columns if c != "w"]
    hashed = split.select(*names, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    n = F.size("h")
    marks = F.slice(_least(F.col("g"), window - gram + 1), 1, F.greatest(n - window + 1, F.lit(0)))
    made = [(window, "g", marks)] + [(k, f"g{k}", F.slice(F.col(f"g{k}"), 1, F.greatest(n - k + 1, F.lit(0)))) for k in short]
    hashed = hashed.select(*names, "h", *(_placed(_grams(F.col("h"), gram if c == "g" else k)).alias(c) for k, c, _ in made))
    out = None
    for kind, _, array in made:
        part = hashed.select(*names, F.lit(kind).alias("kind"), F.explode(F.array_distinct(array)).alias("x"))
        part = part.select(*names, "kind", F.shiftright("x", 32).cast("int").alias("mark"), F.col("x").bitwiseAND(0x7FFFFFFF).cast("int").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


def _windows(items: DataFrame, window: int, short: list[int]) -> DataFrame:
    """(item, kind, words, same_items): the windows of each item; those of items with equal words share same_items."""
    n = F.size("w")
    start = F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))))
    out = items.select("item", "w", n.alias("n"), start.alias("start"))
    return out.select(
        "item", F.least("n", F.lit(window)).alias("kind"), F.slice("w", F.col("start") + 1, window).alias("words"),
        F.sha2(F.array_join("w", " "), 256).alias("same_items"),
    )


def _occurring(near: DataFrame, items: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """(id, text_key, kind, start, same_items): windows around the hits that are windows of items, compared by words."""
    n = F.size("w")
    around = F.flatten(F.transform("places", lambda p: F.when(
        p.kind == window,
        F.transform(
            F.sequence(F.greatest(p.place - (window - gram), F.lit(0)), F.least(p.place, n - window)),
            lambda s: F.struct(p.kind.alias("kind"), s.alias("start")),
        ),
    ).otherwise(F.array(F.struct(p.kind.alias("kind"), p.place.alias("start"))))))
    cut = F.transform(F.array_distinct(around), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), F.slice(F.col("w"), s.start + 1, s.kind).alias("words")))
    mine = near.select("id", "text_key", F.explode(cut).alias("c")).select("id", "text_key", "c.*")
    theirs = stage(_windows(items, window, short).select("kind", "words", "same_items").distinct(), "windows")
    return mine.join(small_or_shuffled(theirs), ["kind", "words"]).select("id", "text_key", "kind", "start", "same_items")


def _covered(spans: Column) -> Column:
    """Words under sorted (start, kind) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc, s):
        end = F.greatest(acc.end, s.start + s.kind)
        return F.struct(end.alias("end"), (acc.n + end - F.greatest(acc.end, s.start)).alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc.n)
