"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netspark.llm import (
    byte_bpe,
    decontaminate,
    hilbert_shards,
    language_id,
    license_scan,
    lm_scoring,
    merkle_manifest,
    pii_weak,
    quality_mcd,
    simhash_vp,
    spelling_fst,
    suffix_dedup,
    token_files,
)
from netspark.llm.checks import CHECKS as CHECKS
from netspark.llm.common import read


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = lm_scoring.with_target(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return lm_scoring.scores(marked, "is_target")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_weak.digests(read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.judged(read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_fst.variants(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.digests(read(spark, sf_dir, "documents"))


def op13_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shards(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_personal_data": op2_personal_data,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_license_scan": op7_license_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_files": op9_token_files,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hilbert_sharding": op13_hilbert_sharding,
}
