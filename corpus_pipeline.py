"""From raw documents to packed training windows, in five stages.

Each stage takes the documents that its predecessor kept, written as Parquet and read again, and returns those that it keeps itself, in the same columns; the last
returns the windows. Near copies, the difference cover, the walk embedding and the packing have no SQL, so ORACLE_SQL is None and the whole run is tested against a
brute-force version.

Rows with null text fail the quality rules as empty documents; empty tables pass through every stage; extra columns are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from needlework.llm import cgk_decontam, kk_packing, order_minhash, quality_ledger, suffix_dedup
from needlework.llm.scratch import load, shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the current policy."""
    toxic = quality_ledger.lexicon(load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents"))
    return quality_ledger.kept(docs, toxic)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return order_minhash.dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier."""
    return suffix_dedup.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return cgk_decontam.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of near-equal length."""
    return kk_packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
