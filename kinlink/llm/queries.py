"""The opN_<name> queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm import bpe, decontaminate, html_extract, language_id, line_dedup, near_dedup, quality_lm, quality_rules, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter_digest(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id_digest(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup_digest(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules_digest(_table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract_digest(_table(spark, sf_dir, "pages"))


def op10_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.quality_lm_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_language_id": op2_language_id,
        "op3_bpe": op3_bpe,
        "op4_near_dedup": op4_near_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_warc": op6_warc,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_html_extract": op9_html_extract,
        "op10_quality_lm": op10_quality_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.ORACLE,
        "op4_near_dedup": near_dedup.ORACLE,
        "op6_warc": warc.ORACLE,
        "op7_line_dedup": line_dedup.ORACLE,
        "op8_quality_rules": quality_rules.ORACLE,
        "op9_html_extract": html_extract.ORACLE,
    }
