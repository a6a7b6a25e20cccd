"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared checkpoint folder and reads it again for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, quality, sharding, simhash
from tessera.llm.common import read, shared_folder
from tessera.llm.queries import LANGUAGES, domain_of

#: The last stage adds ``shard`` and ``slot``; the others return the columns of documents.
SHARDS = 16


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go; all labels may teach it."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"), F.lit(False))
    return quality.keep_good(docs, model, 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items go; documents that are mostly such passages go whole."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, shared out by language weights; no document is repeated."""
    plan = mixing.mix(docs, {"lang": LANGUAGES}, domain_of(F.col("source")), (9, 10), max_epochs=1)
    return mixing.materialize(docs, plan)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return sharding.with_shards(docs, SHARDS)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
