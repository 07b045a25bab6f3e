"""The queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import ensure_importable
from .common import small_batches
from .chat import ROTATE_SQL, rotate_perspectives
from .decontam import leaks
from .html import main_text
from .langid import language_id
from .minhash import near_duplicates
from .mixing import mixing_rates
from .quality import RULES_SQL, quality_rules
from .suffix_dedup import suffix_dedup
from .tokens import token_counts
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op3_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op5_toxicity_deobfuscated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_minmax_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 512)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing_rates,
        op2_consensus_html,
        op3_language_bitmask,
        op4_suffix_dedup,
        op5_toxicity_deobfuscated,
        op6_minmax_near_dups,
        op7_chat_perspectives,
        op8_quality_divergence,
        op9_latent_decontamination,
        op10_token_counts,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_chat_perspectives": ROTATE_SQL,
    "op8_quality_divergence": RULES_SQL,
}
