"""A training corpus from `documents`: good texts, one of each group of near copies, none that
holds benchmark items, sources mixed to their target weights, dealt to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitlake.llm import leaks, mixing, near, quality, sharding
from orbitlake.llm.shared import settle, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return near.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found."""
    return leaks.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it."""
    return mixing.take_mix(docs)


def dealt_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard."""
    return sharding.with_shards(docs)


STAGES = [("quality classifier", good_quality), ("near copies", without_copies),
          ("benchmark decontamination", without_leaks), ("source mixing", mixed_sources),
          ("sharding", dealt_to_shards)]

#: No stage before the last two can be said in SQL; the tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
