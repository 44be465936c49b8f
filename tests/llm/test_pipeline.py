"""The pipeline's stages keep their promises on their own inputs; queries equal their SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_decontamination", "op7_url_filter", "op8_topk_search"])
def test_sql(spark, name):
    assert compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF)[0] is None


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        done = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert done.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < done.count() <= docs.count(), name
            if k == 1:
                assert done.count() == done.select("doc_id", "text").distinct().count()
            docs = done
    assert done.filter("piece = 0").count() == docs.count()


def test_near_duplicates_judge_rows(spark):
    """Rows without an id, and rows that share one, are kept or dropped by their own text."""
    words = lambda s, n=40: " ".join(f"{s}{i}" for i in range(n))
    a, near, clean, other, lone, pair = words("a"), words("a", 39) + " z", words("b"), words("c"), words("d"), words("e")
    rows = [(3, a), (None, near), (None, clean), (None, clean), (5, a + " y"), (5, other), (7, pair), (7, pair + " y"), (None, lone), (None, lone + " y"), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    for i, group in ((7, {pair, pair + " y"}), (None, {lone, lone + " y"})):  # one of each
        assert sum(x[0] == i and x[1] in group for x in got) == 1
    rest = [x for x in got if x[1] is None or not x[1].startswith(("d0 ", "e0 "))]
    assert sorted(rest, key=repr) == sorted([(3, a), (None, clean), (5, other), (8, None), (9, "")], key=repr)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs, SF).count() == 0, name
