"""The corpus pipeline: from documents to packed sequences, each stage one of the operators in ``tidemark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.exchange import small_or_shuffled
from tidemark.llm.ngram_join import linked_components
from tidemark.llm.packing import packed_documents
from tidemark.llm.quality import scored
from tidemark.llm.queries import quality_model, read, tokenizer
from tidemark.llm.suffix_dedup import without_repeats
from tidemark.operators.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return scored(docs, quality_model(spark, docs, sf_dir)).filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id (a null one last), of equals that with the smaller text key;
    of rows that repeat an id and text, one."""
    linked = linked_components(docs, keyed=True).filter("component is not null")
    linked = stage(linked.select("doc_id", "text_key", "component").distinct(), "linked")
    first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("m"))
    gone = _without(linked, stage(first.select("m.doc_id", "m.text_key"), "first"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    repeated = stage(docs.groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key"), "repeated")
    kept = _without(docs, stage(gone.select("doc_id", "text_key"), "gone"))
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    again = _joined(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(kept, repeated).unionByName(again).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of an earlier document; bytes of a character that a cut has split go too, and so do documents that lose all."""
    out = without_repeats(docs, carry=("lang", "source"), as_text=True).filter("n_removed = 0 or n_removed < n_bytes")
    return out.select("doc_id", F.col("kept").alias("text"), "carried.lang", "carried.source").select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    found = decontaminated(docs, read(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id", "text_key").distinct()
    found = small_or_shuffled(stage(found, "contaminated"))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64("d.text") == F.col("f.text_key"))
    return docs.alias("d").join(found.alias("f"), same, "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return packed_documents(docs, tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]
#: A trained model, components and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return _joined(docs, rows, "left_anti")


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` by the (doc_id, text_key) of ``rows``, a written table."""
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key"))
    return docs.alias("d").join(small_or_shuffled(rows).alias("f"), same, how)
