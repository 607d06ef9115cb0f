"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding, each written and read again.

Every stage takes and returns documents; the last adds `virtual_slot` and `shard`. Rows without doc_id pass the stages
that name documents by it. The mix repeats documents, so the last two tables hold some of them up to three times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from folioscope.llm.common import table
from folioscope.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the base rules or the likelihood ratio against the trusted labels reject."""
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of linked documents."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of the benchmark is found."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents until each source has its share of the words."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each row's virtual slot and shard by a map balanced for the bytes of these rows."""
    slot_map = sharding.balanced_map(docs, f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}")
    return sharding.sharded(docs, slot_map)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

# Hashes that DuckDB does not offer decide the rows; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
