"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import small_or_shuffled
from tidemark.operators.staging import stage

SHORT = 8  # hex digits of a digest that the join compares


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """All columns of ``pages`` with host, path, rule and verdict.

    ``rules`` has host, path (from its first slash on; may be empty) and verdict; a rule fits its host and the hosts below it where the url's
    path starts with the rule's path. Of several the longest wins (host and path together), then the longer host, then a
    verdict other than ``otherwise``. Where none fits, rule is null and the verdict is ``otherwise``. A null url, or one without ``://``, has an empty host and path.
    Rules with a null field are left out; repeated rules count once; repeated pages are kept. Columns of
    ``pages`` named host, path, rule or verdict are replaced. Each distinct url is judged once.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    rules = rules.select(
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), "verdict",
        _digest(F.col("host"), F.col("path")).alias("digest"),
    )
    rules = stage(rules, "rules")
    sizes = sorted(r.path_length for r in rules.select("path_length").distinct().collect())  # at most the longest path many

    urls = pages.select(F.col(url_col).alias("u")).distinct()
    urls = urls.select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sizes)), lambda p: p.isNotNull())
    prefixes = prefixes if sizes else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    asked = urls.select("u", F.explode(pairs).alias("digest"))
    asked = asked.withColumn("short", F.substring("digest", 1, SHORT))
    told = rules.withColumn("short", F.substring("digest", 1, SHORT)).withColumnRenamed("digest", "full")
    hits = asked.join(small_or_shuffled(told), "short").filter("digest = full")
    best = hits.groupBy("u").agg(F.max(F.struct(
        (F.col("host_length") + F.col("path_length")).alias("size"), "host_length",
        F.when(F.col("verdict") == otherwise, 0).otherwise(1).alias("order"), "rule", "verdict")).alias("b"))
    verdicts = urls.join(best.select(F.col("u").alias("v"), "b.rule", "b.verdict"), F.col("u").eqNullSafe(F.col("v")), "left").select("u", "host", "path", "rule", "verdict")
    return pages.alias("p").join(verdicts.alias("v"), F.col(f"p.`{url_col}`").eqNullSafe(F.col("v.u"))).select(
        *(F.col(f"p.`{c}`") for c in kept), "v.host", "v.path", "v.rule", F.coalesce("v.verdict", F.lit(otherwise)).alias("verdict"))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)
