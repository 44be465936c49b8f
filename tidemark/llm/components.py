"""Connected components by repeated contraction; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exchange import small_or_shuffled
from tidemark.operators.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b); the label is one node of its component.

    Each round sends a node to its smallest neighbour (itself included) and keeps the links between the images. With labels in random order, as digests
    are, a share of the nodes goes each round; along a path in label order one node would, so pass digests. The rounds are then read backwards. Null ends and loops are left out; an
    empty input gives an empty result. Every round is written to the shared folder, so that a lost executor costs
    one round at most.
    """
    links = links.filter("a is not null and b is not null and a != b").select("a", "b").distinct()
    links = stage(links, "links")
    rounds = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node"), "contract")
        rounds.append(to)
        image = small_or_shuffled(to)
        links = (
            links.join(image.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("x"), "b")
            .join(image.withColumnRenamed("node", "b"), "b").select("x", F.col("to").alias("y"))
            .filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        links = stage(links, "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds[-1].withColumnRenamed("to", "label")
    for to in reversed(rounds[:-1]):
        labels = to.join(
            labels.withColumnRenamed("node", "to"), "to", "left",
        ).select("node", F.coalesce("label", "to").alias("label"))
    return labels
