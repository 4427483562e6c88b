"""Each pipeline stage against its own definition on a small fixture."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from visloom.llm import near_dup  # noqa: E402

D = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    labels = spark.read.parquet(f"{D}/labels.parquet")
    out = stages["quality"](spark, docs, D)
    good = docs.join(labels.where("quality = 1"), "doc_id")
    assert out.columns == docs.columns and good.join(out, "doc_id", "left_anti").count() <= 0.02 * good.count()
    bad = out.join(labels.where("quality = 0"), "doc_id").count()
    assert bad <= 0.05 * labels.where("quality = 0").count()
    texts = [r for r in docs.collect()]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for r in texts:
        last[r["text"].translate(low)] = max(last.get(r["text"].translate(low), -1), r["doc_id"])
    exact = stages["exact_dedup"](spark, docs, D)
    assert sorted(r["doc_id"] for r in exact.select("doc_id").collect()) == sorted(last.values())
    near = stages["near_dedup"](spark, docs, D)
    found = near_dup.near_duplicates(docs)
    assert near.count() == found.where("component_id IS NOT NULL").select("component_id").distinct().count()
    clean = stages["decontamination"](spark, docs, D)
    assert 0 < docs.count() - clean.count() < 0.1 * docs.count()
    mixed = stages["mixing"](spark, clean, D)
    assert mixed.count() == clean.count() and mixed.where("rate < 0").count() == 0


def test_empty_documents(spark):
    none = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, D).count() == 0


def test_run_is_the_stages_in_turn(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.where(F.col("rate").isNull()).count() == 0


def test_any_column_names(spark):
    """Names that the stages use themselves, dots and back quotes included, with null and repeated rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    names = ["_at", "_AT2", "_word", "_bits", "_row", "_maybe", "doc", "sid", "rk", "root", "n.chars", "a`b", "h", "rate_"]
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for i, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(f"{i}"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert 0 < out.count() <= docs.count()
        if name != "mixing":
            assert out.columns == docs.columns
            assert all(r[c] == f"{i}" for r in out.collect() for i, c in enumerate(names))
