"""Next-fit packing of documents into shards of bounded size, and the segments that result.

A shard takes ``chunk_size - 1`` bytes. Documents come in id order; one that doesn't fit into what is left starts a new shard, and one larger than a shard is
split over several. The rule is a fold, but of a range of documents it is a small table: where the first new shard begins depends on how full the last one is, and all that follows
on where that is. Ranges give their tables at once (runs of beginnings that end alike are one row), the driver goes through them, and a second pass writes the segments. A range
whose table has more than ``TABLE`` rows is asked again with the state that it is entered in. Only (doc_id, len) take part; ids are unique and not null.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.functions.bytes import InvalidInput

RANGE_ROWS = 1_000_000
TABLE = 1024
TASK_BYTES, LEAST_TASKS, MOST_TASKS = 4 << 20, 64, 4096
SEGMENTS = "shard_id int, ord long, doc_id long, part_index int, is_first boolean, is_last boolean, doc_offset long, len long, shard_offset long"


def fold(lengths: np.ndarray, cap: int, used: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, part, shard, shard_offset, len) of each segment, from a shard that already holds ``used`` bytes (shard 0)."""
    shard = 0
    for row, n in enumerate(lengths.tolist()):
        if not n:
            continue
        if used == cap or (n > cap - used and used):
            shard, used = shard + 1, 0
        full = (n - 1) // cap if n > cap else 0
        for part in range(full):
            yield row, part, shard + part, 0, cap
        rest = n - full * cap
        shard += full
        if full:
            used = 0
        yield row, full, shard, used, rest
        used += rest


def endings(lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes before, used, shards) for each document that a new shard may begin with: how full the last shard is at the range's end, and how many were begun after that one."""
    n = len(lengths)
    before = np.concatenate([[0], np.cumsum(lengths)])
    full = np.where(lengths > cap, (lengths - 1) // cap, 0)
    # the shard holds the document, or its last part, and what fits behind it
    left = lengths - full * cap
    after = np.searchsorted(before, before[1:] + cap - left, "right") - 1
    used, shards = left + before[n] - before[1:], full + (after < n)
    after = np.append(after, n)
    used, shards = np.append(used, 0), np.append(shards, 0)
    end = np.arange(n + 1)
    while (after < n).any():
        # whoever goes on ends as the document that it goes on with
        shards = shards + np.where(after < n, shards[after], 0)
        end = np.where(after < n, end[after], end)
        after = np.where(after < n, after[after], after)
    return before[:n], used[end[:n]], shards[:n]


def ranged(docs: DataFrame) -> DataFrame:
    """(doc_id, len, part): ranges of about RANGE_ROWS documents by id, which stay as they are from pass to pass.

    The rows are two numbers a document. They are checkpointed where the session names a folder for that, so that a lost executor can't move a range.
    """
    sizes = docs.select(F.col("doc_id").cast("long"), F.col("len").cast("long"))
    counted = sizes.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    if counted["named"] < counted["n"]:
        raise InvalidInput("a document has no id")
    ranges = max(1, math.ceil(counted["n"] / RANGE_ROWS))
    ordered = sizes.repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id())
    context = docs.sparkSession.sparkContext
    if context.getCheckpointDir():
        return ordered.checkpoint()
    return ordered.persist(StorageLevel.MEMORY_AND_DISK if context.master.startswith("local[") else StorageLevel.MEMORY_AND_DISK_2)


RANGES = "part int, total long, n long, repeated boolean, before array<long>, used array<long>, shards array<long>"


def tables(ordered: DataFrame, cap: int) -> dict[int, dict]:
    """By range: its bytes, its segments, and its table, or none where that is too long."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        lengths = pdf["len"].to_numpy()
        lengths = lengths[lengths > 0]
        before, used, shards = endings(lengths, cap)
        lead = np.ones(len(before), bool)
        lead[1:] = (used[1:] != used[:-1]) | (shards[1:] != shards[:-1])
        lead &= before < cap
        table = [x[lead] for x in (before, used, shards)] if lead.sum() <= TABLE else [None] * 3
        segments = int(np.where(lengths > cap, (lengths - 1) // cap, 0).sum()) + len(lengths)
        ids = pdf["doc_id"].to_numpy()
        return pd.DataFrame([(int(pdf["part"].iloc[0]), int(lengths.sum()), segments, bool((ids[1:] == ids[:-1]).any()), *table)], columns=["part", "total", "n", "repeated", "before", "used", "shards"])

    return {r["part"]: r.asDict() for r in ordered.groupBy("part").applyInPandas(run, RANGES).collect()}


def entered(ordered: DataFrame, part: int, cap: int, used: int) -> tuple[int, int]:
    """(shards begun, used at the end) of one range that is entered with ``used``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last = (0, used)
        for _, _, shard, offset, size in fold(pdf.sort_values("doc_id", kind="stable")["len"].to_numpy(), cap, used):
            last = (shard, offset + size)
        return pd.DataFrame([last], columns=["shards", "used"])

    return tuple(ordered.where(F.col("part") == part).groupBy("part").applyInPandas(run, "shards long, used long").first())


def plan(docs: DataFrame, chunk_size: int | None) -> DataFrame:
    """Segments without content of docs(doc_id, len); chunk_size None is one shard for all."""
    return planned(docs, chunk_size)[0]


def planned(docs: DataFrame, chunk_size: int | None) -> tuple[DataFrame, int, int]:
    """The plan, its shards and its bytes."""
    if chunk_size is not None and chunk_size < 2:
        raise InvalidInput("chunk_size is 2 at least")
    cap = chunk_size - 1 if chunk_size is not None else 1 << 62
    ordered = ranged(docs)
    starts, shift, order, shard, at, used, total = {}, {}, {}, 0, 0, 0, 0
    for part, r in sorted(tables(ordered, cap).items()):
        if r["repeated"]:
            raise InvalidInput("a document id occurs twice")
        starts[part], shift[part], order[part] = used, shard, at
        at += r["n"]
        total += r["total"]
        if used + r["total"] <= cap:
            used += r["total"]
        elif r["before"] is None:
            begun, used = entered(ordered, part, cap, used)
            shard += begun
        else:
            # the first new shard begins with the first document that doesn't fit; an empty shard takes any
            i = bisect.bisect_right(r["before"], cap - used) - 1 if used else 0
            shard += r["shards"][i] + (used > 0)
            used = r["used"][i]

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        part = int(pdf["part"].iloc[0])
        rows = np.array(list(fold(pdf["len"].to_numpy(), cap, starts.get(part, 0))), np.int64).reshape(-1, 5)
        row, piece, shard, offset, size = rows.T
        last = np.concatenate([row[1:] != row[:-1], [True]]) if len(row) else np.zeros(0, bool)
        return pd.DataFrame(
            {
                "shard_id": (shard + shift[part]).astype(np.int32),
                "ord": np.arange(len(row)) + order[part],
                "doc_id": pdf["doc_id"].to_numpy()[row],
                "part_index": piece.astype(np.int32),
                "is_first": piece == 0,
                "is_last": last,
                "doc_offset": piece * cap,
                "len": size,
                "shard_offset": offset,
            }
        )

    return ordered.groupBy("part").applyInPandas(emit, SEGMENTS), shard + 1, total


def segments(docs: DataFrame, chunk_size: int | None, grouped: bool = False) -> DataFrame:
    """Segments with source_path and content of docs(doc_id, source_path, content, len).

    ``grouped`` puts each shard into one partition, TASK_BYTES of text in each and LEAST_TASKS to MOST_TASKS in all: what is done with a shard costs far more than its bytes,
    by which adaptive execution would put so many into a task that a few tasks hold up all others.
    """
    made, shards, total = planned(docs, chunk_size)
    made = made.withColumnRenamed("len", "seg_len")
    start, n = (F.col("doc_offset") + 1).cast("int"), F.col("seg_len").cast("int")
    found = docs.drop("len").join(made, "doc_id").select("shard_id", "ord", "doc_id", "part_index", "is_first", "is_last", "source_path", "doc_offset", F.col("seg_len").alias("len"), "shard_offset", F.substring("content", start, n).alias("content"))
    if not grouped:
        return found
    return found.repartition(min(shards, MOST_TASKS, max(LEAST_TASKS, math.ceil(total / TASK_BYTES))), "shard_id")
