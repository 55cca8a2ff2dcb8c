"""Registered queries of the corpus operators: each applies its operator, with
production parameters, to its whole table. ``ORACLE`` holds DuckDB SQL where SQL
can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockyard.llm import (
    decontaminate,
    fill_middle,
    kd_search,
    language,
    near_dup,
    packing,
    quality,
    secret_scan,
    shards,
    spelling,
    substring_dedup,
    suffix_dedup,
    token_files,
)
from stockyard.llm.common import documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.digest(documents(spark, sf_dir))


def op1_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.pages(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(documents(spark, sf_dir))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(documents(spark, sf_dir))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.digest(documents(spark, sf_dir))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.digest(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(documents(spark, sf_dir))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op1_language_id_pages, op2_decontamination, op3_secret_scan, op4_sharding,
    op5_suffix_array_dedup, op6_substring_dedup, op7_minhash_near_dedup, op8_exact_top_k, op9_packing,
    op10_quality_classifier, op11_spelling_variants, op12_token_files, op13_fill_in_middle)}
ORACLE: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE, "op3_secret_scan": secret_scan.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE, "op7_minhash_near_dedup": near_dup.ORACLE,
    "op8_exact_top_k": kd_search.ORACLE, "op11_spelling_variants": spelling.ORACLE,
    "op13_fill_in_middle": fill_middle.ORACLE}
