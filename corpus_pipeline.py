"""Documents to training shards: five stages, each over everything that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as a Parquet table in the shared folder and read
again as the next stage's docs. All but the last return the columns of docs. Stages read whole texts and handle null and
repeated values as their operators say; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, langid, mixing, queries, sharding
from tidemark.llm.common import cut


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; the model learns from the documents' own labels."""
    into = langid.free_name(docs, "language")
    said = langid.identify(docs, queries.learn_language(docs), into=into)
    return said.where(~F.col(into)["rejected"]).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.keep_one(docs, n=5, percent=80)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.where(~F.col("contaminated")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and its slot there."""
    return sharding.shard(docs, sharding.balanced_tree(queries.SHARDS))


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("benchmarks", clean_of_benchmarks),
    ("mixture", mixed),
    ("shards", sharded),
]

#: SQL can express neither the compression nor the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
