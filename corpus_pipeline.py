"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from calltide.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from calltide.llm.common import crc_mod, drop_table, materialize, table
from calltide.llm.queries import TOKENIZER

#: Not expressible: the first stage is a trained model and the last an evolutionary search.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the model learns from the labels outside the held-out third."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1))
    columns = docs.columns
    scored = quality.score(docs.withColumnsRenamed({c: f"__{k}" for k, c in enumerate(columns)}), model, text=f"__{columns.index('text')}", keep=tuple(f"__{k}" for k in range(len(columns))))
    return scored.where("predicted = 1").selectExpr(*(f"__{k} AS `{c}`" for k, c in enumerate(columns)))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines without those that an earlier line resembles; documents that consisted of such lines go."""
    return line_dedup.clean(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised documents' pieces with their places in training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents, each written and read again; a stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
