"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitlake.llm import (extract, leaks, lines, mixing, near, negatives, phrases, pii, quality,
                           secret_scan, sharding, tokens, topk)
from orbitlake.llm.shared import table


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(table(spark, sf_dir, "pages"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_pii": op1_pii, "op2_sharding": op2_sharding, "op3_mixing": op3_mixing,
           "op4_topk": op4_topk, "op5_quality": op5_quality, "op6_near": op6_near,
           "op7_secrets": op7_secrets, "op8_leaks": op8_leaks,
           "op9_extraction": op9_extraction, "op10_tokens": op10_tokens,
           "op11_negatives": op11_negatives, "op12_phrases": op12_phrases,
           "op13_lines": op13_lines}
ORACLES: dict[str, str] = {"op4_topk": topk.ORACLE, "op11_negatives": negatives.ORACLE,
                           "op12_phrases": phrases.ORACLE, "op13_lines": lines.ORACLE}
