"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

quality classifier -> near-duplicates -> benchmark decontamination -> mixing -> sharding. Every stage but the
last returns the columns of documents; the last adds the shard.

Cases: null and blank texts have no feature, shingle or benchmark item: the classifier's bias decides on them,
they are nobody's copy, and they have no words to mix (their copies are the whole ones of their source); very
long texts go through whole; of repeated rows, and of rows that share an id and a text, one is left by the
near-duplicate stage; equal scores, sizes and ranks are settled by values of the rows, so that reruns agree; a
null id is a document like any other; without labels every score is 0.5 and all documents stay; without
benchmark items none goes; empty tables pass through as empty tables; extra columns are kept, but for one named
shard, whose place the last stage's takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontam, minhash, mix, quality, shard
from quern.llm.common import settle

#: Near-duplicates here: five words a shingle, similarity 0.8; bands for a miss of 1e-8 at the threshold.
NEAR = minhash.NearDupParams(words=5, percent=80, bands=minhash.bands_for(80, 6), rows=6)
SHARDS = 16


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's labelled rows, gives 0.5 or more."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the least id."""
    return minhash.dedup(docs, NEAR)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and their shard of 16; copies of a document share its shard."""
    return shard.with_shard(docs, SHARDS)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", no_benchmark),
    ("mixing", target_mix),
    ("sharding", sharded),
]

#: A learned model and an edit distance search decide; SQL can't express them. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
