"""The training-data pipeline: documents pass through the stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navette.llm import decontaminate, mixing, ngram_join, personal_data, quality
from navette.llm.common import held_out, release
from navette.sources.shared import fresh_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score below one half go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", F.col("quality").alias("label"))
    model, _ = quality.train(docs, labels)
    return docs.where(quality.quality_score(model, F.col("text")) >= 0.5)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: personal spans are masked; n_chars follows the text."""
    masked = personal_data.without_personal_data(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents as often as the mix takes them."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_copy),
    ("benchmark decontamination", keep_unleaked),
    ("personal data", mask_personal),
    ("mixing sources to target weights", mix_sources),
]

#: Training, components and edit distances are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        path = fresh_path(spark, f"pipeline-{number}")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        release(spark)
    return docs
