"""Queries over the driver's tables, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair,
    conversation_trie,
    exact_dedup,
    learned_partitions,
    lm_scoring,
    mixing,
    near_dedup,
    pieces,
    pii,
    quality_classifier,
    quality_rules,
    substring_dedup,
    toxicity,
)

#: Key of the pseudonyms in the query, whose tables hold invented persons; real ones need a secret key.
KEY = "invented persons"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_read(spark, sf_dir, "documents"), model_path())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_read(spark, sf_dir, "documents"), KEY)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))
    return out.drop("longest_repeat")  # the levels beyond 13 words aren't SQL; tests hold them against brute force


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "position"
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.ledger(_read(spark, sf_dir, "documents")))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "failed"
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes, and what it alone removes."""
    led = quality_rules.ledger(_read(spark, sf_dir, "documents")).select("failed")
    parts = [
        quality_rules.ablations(led, p).select(F.lit(p).alias("policy"), "rule", "n_failed", "n_only")
        for p in quality_rules.POLICIES
    ]
    return parts[0].unionByName(parts[1])


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(_read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pii": op2_pii,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mixing": op4_mixing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_toxicity": op6_toxicity,
    "op7_near_dedup": op7_near_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality_rules": op10_quality_rules,
    "quality_ablations": quality_ablations,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op7_near_dedup": near_dedup.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
    "quality_ablations": quality_rules.ABLATIONS,
    "op12_prefix_trie": conversation_trie.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
