"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talkgrid.llm import oracles
from talkgrid.llm.chat_format import format_chats
from talkgrid.llm.common import table
from talkgrid.llm.decontaminate import contamination
from talkgrid.llm.html_text import extract
from talkgrid.llm.language_id import identify
from talkgrid.llm.license_scan import license_scan
from talkgrid.llm.mixing import mixture
from talkgrid.llm.near_dedup import near_groups
from talkgrid.llm.quality_classifier import quality_scores
from talkgrid.llm.quality_rules import quality
from talkgrid.llm.toxicity import toxicity


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("found")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_toxicity": op2_toxicity,
    "op3_license_scans": op3_license_scans,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_extraction": op7_html_extraction,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op4_benchmark_decontamination": oracles.LEAKS,
    "op8_mixing_sources": oracles.MIX,
    "op10_minhash_near_dedup": oracles.NEAR,
}
