"""A persisted index: the segments as Parquet by shard, with a description that is checked when it is opened."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.functions.bytes import MODES, TEXT, InvalidInput
from needlework.operators.shard import segments
from needlework.operators.suffix import suffixes

VERSION = 1


@dataclass(frozen=True)
class Index:
    segments: DataFrame
    mode: str
    sample_rate: int
    #: suffix order of every shard, where it was kept
    suffixes: DataFrame | None = None


def build(docs: DataFrame, path: str, chunk_size: int | None = None, mode: str = TEXT, sample_rate: int = 32) -> None:
    """Write docs(doc_id, source_path, content, len) as an index; chunk_size None is one shard."""
    if sample_rate < 1:
        raise InvalidInput("sample_rate is positive")
    write(segments(docs, chunk_size), path, mode, sample_rate, "errorifexists")


def write(made: DataFrame, path: str, mode: str, sample_rate: int, how: str) -> None:
    made.repartition("shard_id").sortWithinPartitions("shard_id", "ord").write.mode(how).partitionBy("shard_id").parquet(f"{path}/segments")
    about = [(json.dumps({"version": VERSION, "mode": mode, "sample_rate": sample_rate}),)]
    made.sparkSession.createDataFrame(about, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def keep_suffixes(spark: SparkSession, path: str) -> None:
    """Sort every shard of the index once and keep the order beside it; shards of a few MB are meant for this."""
    index = open_index(spark, path)
    suffixes(index.segments, index.mode).write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/suffixes")


def open_index(spark: SparkSession, path: str) -> Index:
    """The index at path; anything else is an error."""
    from pyspark.errors import AnalysisException

    try:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        made = spark.read.parquet(f"{path}/segments")
    except AnalysisException as e:
        raise InvalidInput(f"no index at {path}") from e
    if about.get("version") != VERSION or about.get("mode") not in MODES:
        raise InvalidInput(f"index of another version at {path}")
    try:
        order = spark.read.parquet(f"{path}/suffixes").withColumn("shard_id", F.col("shard_id").cast("int"))
    except AnalysisException:
        order = None
    return Index(made.withColumn("shard_id", F.col("shard_id").cast("int")), about["mode"], about["sample_rate"], order)
