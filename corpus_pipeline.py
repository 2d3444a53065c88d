"""A corpus, prepared in five stages: language, near duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of ``documents``; the driver writes each result as Parquet and reads it back for the next. Near
copies and benchmark passages are judged row by row, so rows that repeat an id or have none stay or go by their own texts.
Columns beyond those of ``documents`` come through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import decontaminate, language, mixing, nearcopies, sharding
from ebbtide.llm.text import packed, unpacked
from ebbtide.storage import durable


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without letters, or none of whose n-grams any language has, go."""
    known = docs.where(~language.held_out(F.col("doc_id"), 4, 2))
    model = language.fit(known, "text", "lang")
    told = language.predict(packed(docs), "text", model, ["doc_id", "text", "rest"])
    return unpacked(told.where("lang_pred <> 'und' and score > 0"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    rows = nearcopies.keyed(docs)
    gone = durable(nearcopies.near_copies(rows).where("row <> keep").select("row"))
    return unpacked(rows.join(gone, "row", "left_anti"), docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = durable(packed(docs))
    marks = decontaminate.contamination(rows.select("row", "text"), benchmark, id_col="row")
    gone = durable(marks.where("contaminated").select(F.col("doc_id").alias("row")))
    return unpacked(rows.join(gone, "row", "left_anti"), docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document of the mixture is put."""
    return sharding.shard_by_bytes(docs)


STAGES = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
    ("shards", shards),
]

ORACLE_SQL = None  # language ID, SimHash and the shards' checksums have no SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
