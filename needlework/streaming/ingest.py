"""New files are appended to an index as they arrive: each micro-batch becomes shards of its own, so old shards never change.

A batch is known by its number and by the stream that it belongs to, which is named by the folder of its marks: several streams may fill one index, one after the other, and an
index that ``build`` made may be filled further.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.functions.bytes import TEXT, checked
from needlework.operators.shard import segments
from needlework.sources.index import write

FILES = "path string, modificationTime timestamp, length long, content binary"


def run_available(spark: SparkSession, folder: str, index: str, marks: str, chunk_size: int = 1 << 30, mode: str = TEXT) -> None:
    """Take in the files that are there and weren't before; marks keeps what is done."""

    own = hashlib.sha256(marks.encode()).hexdigest()

    def take(files: DataFrame, batch: int) -> None:
        if files.isEmpty():
            return
        try:
            old = spark.read.option("mergeSchema", True).parquet(f"{index}/segments")
            done = old.where((F.col("batch") == batch) & (F.col("stream") == own)) if {"batch", "stream"} <= set(old.columns) else old.where("false")
            if not done.isEmpty():
                return
            top = old.agg(F.max("shard_id"), F.max("doc_id"), F.max("ord")).first()
        except AnalysisException:
            top = (-1, -1, -1)
        # ids follow the order of the paths; ranges are sorted side by side
        numbered = files.select("path").orderBy("path").rdd.map(lambda r: r[0]).zipWithIndex()
        paths = spark.createDataFrame(numbered, "path string, doc_id long").withColumn("doc_id", F.col("doc_id") + F.lit(int(top[1]) + 1))
        docs = files.join(paths, "path").select("doc_id", F.col("path").alias("source_path"), checked(F.col("content"), mode).alias("content"), F.col("length").alias("len"))
        made = segments(docs, chunk_size).withColumn("shard_id", (F.col("shard_id") + int(top[0]) + 1).cast("int")).withColumn("ord", F.col("ord") + int(top[2]) + 1).withColumn("batch", F.lit(batch).cast("long")).withColumn("stream", F.lit(own))
        write(made, index, mode, 32, "append")

    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
