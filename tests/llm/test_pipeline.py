from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from calltide.llm import decontaminate, jaccard_join, line_dedup
from calltide.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, columns = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.join(start, "doc_id", "left_anti").count() == 0
    assert line_dedup.judged_lines(docs).where(F.size("removed") > 0).count() == 0
    assert jaccard_join.link(docs).where("n_links > 0").count() == 0
    assert decontaminate.report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0")
    assert docs.join(labels, "doc_id").count() <= 0.1 * max(1, labels.count())


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else docs
