"""From raw documents to packed training sequences, in five stages.

1. ``quality``: documents that the quality classifier rejects go.
2. ``exact_dedup``: of equal texts, the document with the largest id stays.
3. ``simhash``: of each group of near duplicates, the document with the smallest id stays.
4. ``decontaminate``: documents that contain benchmark passages go.
5. ``packing``: the rest is tokenised and packed into sequences.

Each stage's result is written as Parquet to the shared folder and reread by the next, so a lost
executor never costs more than the running stage. A null text counts as empty; empty tables give
empty results; further columns of ``documents`` pass through the first four stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontaminate, exact_dedup, packing, quality, simhash
from ledgerlens.session import stage_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, weights, keep=True)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the classifier nor the token ids; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = stage_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
