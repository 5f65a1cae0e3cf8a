"""Training-corpus pipeline: classify, remove near-duplicates, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet below the shared folder and reads them back as the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import common, cotraining, decontaminate, mixing, near_copies, sharding, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return cotraining.filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts linked by a Jaccard similarity of 0.8 or more of their
    5-word shingles. Close SimHash fingerprints give the first links; the exact prefix filter the rest, as no
    number of blocks finds all fingerprints that this similarity leaves about ten bits apart."""
    return simhash.representatives(docs, near_copies.near_copies(docs, words=5, least=0.8))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target marginals of source, language and topic."""
    return mixing.sample(docs, keep_columns=True)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``shard`` and ``slot``."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

#: The classifier is trained and near copies are linked transitively; SQL cannot express either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = common.staged(docs, "stage")
    return docs
