"""Queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_model, licenses, near_dedup, packing, pii, quality, repetition, sql, substring_dedup, toxicity
from .shared import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "kept")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).drop("text")


def tokenizer_path() -> str:
    """Place of the public vocabulary; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(near_dedup.near_components(table(spark, sf_dir, "documents")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_coverage(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_substring_dedup, op3_quality_classifier, op10_toxicity, op4_packing, op5_near_dedup, op6_pii, op7_language_model, op8_license_scan, op9_quality_rules)}
ORACLE_SQL: dict[str, str] = {k: v for k, v in sql.ORACLE_SQL.items() if k in QUERIES}
