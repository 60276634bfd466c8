"""A training corpus from raw documents: each stage works on what the one before it kept.

Documents are known by ``doc_id``. Rows without one pass the stages that drop or cut documents unchanged; rows with
the same id share the decisions on it, and near-dedup leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import packing, passages, quality, simhash, templates
from storelens.llm.shared import scratch_path, workers_find_library, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    scored = quality.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = written(scored.where("predicted = 0").select("doc_id").distinct(), "rejected")
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    found = written(simhash.near_duplicates(docs).groupBy("doc_id").agg(
        F.max(F.col("doc_id") != F.col("component_id")).alias("drop"), F.count(F.lit(1)).alias("n")
    ).where("doc_id is not null and (drop or n > 1)"), "near-duplicates")
    kept = docs.join(found.where("drop").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("not drop").select("doc_id")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(
        kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has."""
    return passages.without_repeats(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return templates.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.packed(docs, packing.public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

# SQL expresses neither the classifier nor the tokenizer; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next."""
    workers_find_library(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
