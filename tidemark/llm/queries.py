"""Registered queries of the subpackage: name -> function of (session, table directory)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    blocks,
    dialogue,
    languages,
    mixture,
    near,
    neighbours,
    packing,
    periods,
    private,
    repeats,
    rules,
    scoring,
    simhash,
)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture_digest(_documents(spark, sf_dir))


def op2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    ranks = str(tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return scoring.score(_documents(spark, sf_dir), ranks, tokenizers.PATTERN, lower=True)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_documents(spark, sf_dir), str(path))


def op4_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_digest(_documents(spark, sf_dir))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_documents(spark, sf_dir))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.exact_copies(_documents(spark, sf_dir))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(_documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(_documents(spark, sf_dir))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(_documents(spark, sf_dir))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return dialogue.repaired(conversations, dialogue.damaged(conversations))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.runs_digest(periods.with_planted_periods(_documents(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "op1_mixture": op1_mixture,
    "op2_scores": op2_scores,
    "op3_packing": op3_packing,
    "op4_private": op4_private,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_neighbours": op6_neighbours,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_repeats": op8_repeats,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_simhash": op11_simhash,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}
