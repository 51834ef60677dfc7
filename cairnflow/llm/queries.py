"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnflow.llm import decontam, html_extract, licenses, mixing, neardup, pii, quality, secrets, sharding, toxicity
from cairnflow.llm.common import read_table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(read_table(spark, sf_dir, "documents"))


def op5_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_digest(read_table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_shard_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def queries():
    found = (
        op1_main_text,
        op2_toxicity,
        op3_quality_perplexity,
        op4_secret_scan,
        op5_license_digest,
        op6_decontaminate,
        op7_pii,
        op8_mix_sources,
        op9_near_duplicates,
        op10_shard_slots,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_license_digest": licenses.oracle()}
