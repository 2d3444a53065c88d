"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, decontaminate, exact, language, licenses, mixing, negatives, pii, quality, secrets, sharding, simhash, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_read(spark, sf_dir, "documents"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_archive_rows(_read(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches of op9's index."""
    return decontaminate.near_passages(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_rows(_read(spark, sf_dir, "documents")).drop("n_candidates")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_read(spark, sf_dir, "embeddings"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(_read(spark, sf_dir, "embeddings"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_rows(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mix": op2_mix,
    "op3_warc": op3_warc,
    "op4_language": op4_language,
    "op5_shards": op5_shards,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_exact": op8_exact,
    "op9_decontaminate": op9_decontaminate,
    "op10_secrets": op10_secrets,
    "op11_negatives": op11_negatives,
    "op12_codes": op12_codes,
    "op13_licenses": op13_licenses,
    "near_passages": near_passages,
}

ORACLES: dict[str, str] = {
    "op2_mix": mixing.MIX_SQL,
    "op8_exact": exact.EXACT_SQL,
    "op9_decontaminate": decontaminate.CONTAMINATION_SQL,
    "near_passages": decontaminate.NEAR_SQL,
    "op11_negatives": negatives.NEGATIVES_SQL,
    "op12_codes": codes.CODES_SQL,
}
