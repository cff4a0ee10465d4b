"""From raw documents to shuffled shards of a training mix.

Every stage takes ``(spark, docs, sf_dir)``, works on all that the one before it kept and
returns documents in the columns it was given; the last returns their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motorlens.llm import decontaminate, language, mixing, ngram_join, sharding
from motorlens.session import table_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language the network knows; those without letters and those it is unsure of go."""
    return language.in_known_language(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.one_of_each_class(docs)


def find_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that is taken twice comes twice."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document."""
    return sharding.assign_shards(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_ngrams),
    ("benchmark decontamination", find_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

# language models and joins by signatures have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = table_folder(spark)
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
