"""The queries of this subpackage's operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import concat_cut, exact_dedup, hard_negatives, lm_scoring, mixing, near_dup, packing, periodic_runs, quality_classifier, quality_rules, secret_scan, sharding, token_store
from assayer.llm.common import table


def vocabulary() -> str:
    """The path of the public vocabulary file, which stays where it is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.digest(table(spark, sf_dir, "documents"), vocabulary())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"), vocabulary())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


def op13_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_cut.digest(table(spark, sf_dir, "documents"), vocabulary())


OPERATORS = (
    op1_secret_scan,
    op2_sharding,
    op3_near_dup,
    op4_quality_rules,
    op5_mixing,
    op6_token_store,
    op7_exact_dedup,
    op8_quality_classifier,
    op9_lm_scoring,
    op10_packing,
    op11_periodic_runs,
    op12_hard_negatives,
    op13_concat_cut,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secret_scan.SQL,
        "op3_near_dup": near_dup.SQL,
        "op4_quality_rules": quality_rules.SQL,
        "op5_mixing": mixing.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
        "op11_periodic_runs": periodic_runs.SQL,
        "op12_hard_negatives": hard_negatives.SQL,
    }
