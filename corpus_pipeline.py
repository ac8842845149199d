"""From raw documents to shards: quality rules, near-duplicate removal, decontamination, mixing and sharding.

Each stage works on all rows which its predecessor kept and returns the columns of ``documents``; the last adds the
shard of each row. Mixing repeats documents of small sources, up to two passes, and loses none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowscope.llm import fertility, mixing, phrases, sharding, simhash
from flowscope.operators.scale import cut_lineage

#: The quality stage measures with public tokenisers, which SQL cannot state; the tests compare with brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in the fertility band of their language."""
    return fertility.keep_good(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of fingerprints within three bits."""
    return simhash.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return phrases.without_test_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources repeated up to twice, in the flattest ratio that allows."""
    return mixing.Mix(docs).realise(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard of at most 64 MiB."""
    return sharding.shards(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("simhash_near_dedup", one_per_group),
    ("benchmark_decontamination", clean_of_benchmark),
    ("source_mixing", mixed_sources),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs, name)
    return docs
