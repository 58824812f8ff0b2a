"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import (
    language, leaks, lines, manifest, mixing, nearest, pages, pii, quality, simhash, spelling, tokens, urls,
)
from tallyloom.llm.shared import documents
from tallyloom.sources.tables import table


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_digest(documents(spark, folder))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_report(documents(spark, folder))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(documents(spark, folder))


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data_digest(documents(spark, folder))


def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leak_report(documents(spark, folder), table(spark, folder, "benchmark"))


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(documents(spark, folder))


def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest_report(table(spark, folder, "embeddings"))


def op8_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.fingerprint_groups(documents(spark, folder))


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(documents(spark, folder), table(spark, folder, "labels"))


def op11_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.url_report(table(spark, folder, "pages"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variant_report(documents(spark, folder))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest_report(documents(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_line_dedup,
        op2_language_id,
        op3_token_counts,
        op4_personal_data,
        op5_benchmark_decontamination,
        op6_source_mixing,
        op7_nearest_neighbours,
        op8_simhash_groups,
        op9_html_extraction,
        op10_quality_classifier,
        op11_url_filters,
        op12_spelling_variants,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": lines.ORACLE_SQL,
        "op6_source_mixing": mixing.ORACLE_SQL,
        "op11_url_filters": urls.ORACLE_SQL,
        "op12_spelling_variants": spelling.ORACLE_SQL,
        "op13_merkle_manifest": manifest.ORACLE_SQL,
    }
