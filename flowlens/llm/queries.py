"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import (
    decontamination, embeddings, packing, pii, prefixes, quality, rollups, secrets, simhash, spelling, suffixes, toxicity, urls,
)
from flowlens.llm.common import table


def op5_packing_column_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op5(table(spark, sf_dir, "documents"))


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.op6(table(spark, sf_dir, "documents"))


def op7_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.op7(table(spark, sf_dir, "documents"))


def op8_toxicity_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op9(table(spark, sf_dir, "documents"))


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.op1(table(spark, sf_dir, "embeddings"))


def op2_quality_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op4(table(spark, sf_dir, "documents"))


def op10_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10(table(spark, sf_dir, "documents"))


def op11_url_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.op11(table(spark, sf_dir, "pages"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.op12(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_collision_counting, op2_quality_factorisation, op3_template_decontamination, op4_secret_ledger,
        op5_packing_column_generation, op6_token_rollups, op7_sparse_suffixes, op8_toxicity_instances,
        op9_simhash_near_dedup, op10_pii_disclosure,
        op11_url_regression, op12_conversation_trie, op13_spelling_variants,
    )
}

ORACLE: dict[str, str] = {
    "op3_template_decontamination": decontamination.ORACLE_SQL,
    "op12_conversation_trie": prefixes.ORACLE_SQL,
    "op13_spelling_variants": spelling.ORACLE_SQL,
}
