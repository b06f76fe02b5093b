"""Counts of bytes and sizes of shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def symbol_histogram(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, symbol, cnt) of the bytes in content; a partition's counts are added up before they move."""
    if by:
        hexed = docs.select(*by, F.hex("content").alias("h"))
        each = hexed.select(*by, F.explode(F.expr("transform(sequence(1, length(h) - 1, 2), i -> substring(h, i, 2))")).alias("x")).where("length(x) = 2")
        return each.groupBy(*by, F.conv("x", 16, 10).cast("int").alias("symbol")).agg(F.count("*").alias("cnt"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(256, np.int64)
        for batch in batches:
            x = batch.column(0).drop_null()
            if len(x):
                ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
                data = np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
                for at in range(0, len(data), 1 << 20):
                    seen += np.bincount(data[at : at + (1 << 20)], minlength=256)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["symbol", "cnt"])

    return docs.select("content").mapInArrow(count, "symbol int, cnt long").groupBy("symbol").agg(F.sum("cnt").alias("cnt"))


def c_table(histogram: DataFrame) -> DataFrame:
    """(symbol, cnt, c_start): bytes of the text below each symbol; 256 rows at most."""
    below = Window.orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return histogram.select("symbol", "cnt", F.coalesce(F.sum("cnt").over(below), F.lit(0)).cast("long").alias("c_start"))


def index_stats(segments: DataFrame, sample_rate: int = 32) -> DataFrame:
    """A row per shard: text_len (with its end mark), documents, segments, and samples that a rate gives."""
    if sample_rate < 1:
        raise ValueError("sample_rate is positive")
    by = segments.groupBy("shard_id").agg((F.sum("len") + 1).alias("text_len"), F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_segments"))
    return by.withColumn("n_samples", F.ceil(F.col("text_len") / sample_rate).cast("long"))


def totals(segments: DataFrame) -> DataFrame:
    """One row: n_docs, n_segments, n_shards, total_bytes, largest_shard."""
    shards = segments.groupBy("shard_id").agg(F.sum("len").alias("b"), F.count("*").alias("s"))
    return shards.agg(F.count("*").alias("n_shards"), F.sum("b").alias("total_bytes"), F.max("b").alias("largest_shard"), F.sum("s").alias("n_segments")).crossJoin(segments.agg(F.countDistinct("doc_id").alias("n_docs")))
