"""Operator 10: consistent-hash ring with virtual nodes and bounded loads.

Every key hashes to a place of 64 bits on a ring that carries ``shards * vnodes`` virtual nodes; its home is the next virtual node clockwise. No shard takes
more than ``ceil((1 + slack) * keys / shards)`` keys: keys that find a shard full continue clockwise to the next shard with room. Keys are served in
the order (level, arc, priority, key), where level and priority come from a second hash, so the outcome depends on the set of keys only and not on
partitioning or arrival. A whole (level, arc) cell meets the same shards in the same order, so the walk is simulated over cell counts, whose number
is fixed by the ring, and only the few cells in which a shard fills up are ranked key by key.

Nulls: rows with a null key share one key (hash of null) and are spread like any others. Repeated keys count once per row; among equal keys the copies are
interchangeable. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.llm.scratch import load

LEVELS = 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, clockwise; ties on a place are ordered by shard."""
    nodes = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.md5(f"shard-{shard}-{v}".encode()).digest()
            nodes.append((int.from_bytes(digest[:8], "big"), shard))
    return sorted(nodes)


def arc_of(nodes: list[tuple[int, int]]):
    """For each hash the index of the first virtual node at or after it, clockwise; what is sent to the tasks is eight bytes a virtual node."""
    places = np.array([p for p, _ in nodes], np.uint64)

    def arc(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, h.to_numpy(np.int64).view(np.uint64)) % len(places), dtype="int32")

    return F.pandas_udf(arc, "int")


class Walks:
    """For each arc the distinct shards in the order in which a key walking clockwise meets them, found as far as they are asked for."""

    def __init__(self, nodes: list[tuple[int, int]], shards: int):
        self.nodes, self.shards = nodes, shards
        self.met: dict[int, tuple[list[int], set[int], list[int]]] = {}

    def __call__(self, arc: int) -> Iterator[int]:
        seen, have, at = self.met.setdefault(arc, ([], set(), [0]))
        for hops in range(self.shards):
            while len(seen) <= hops:
                if at[0] == len(self.nodes):
                    return
                s = self.nodes[(arc + at[0]) % len(self.nodes)][1]
                at[0] += 1
                if s not in have:
                    have.add(s)
                    seen.append(s)
            yield seen[hops]


def fill(counts: dict[tuple[int, int], int], nodes: list[tuple[int, int]], shards: int, capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Serve the cells in order; segments (level, arc, first_rank, end_rank, home, shard, hops)."""
    room = [capacity] * shards
    walks = Walks(nodes, shards)
    segments = []
    for (level, arc), n in sorted(counts.items()):
        at, home = 0, nodes[arc][1]
        for hops, shard in enumerate(walks(arc)):
            take = min(room[shard], n - at)
            if take > 0:
                segments.append((level, arc, at, at + take, home, shard, hops))
                room[shard] -= take
                at += take
            if at == n:
                break
    return segments


def assign(df: DataFrame, key: str, shards: int = 64, vnodes: int = 64, slack: float = 0.05) -> DataFrame:
    """One row per row of df: the key, home_shard, shard, hops (full shards passed)."""
    if shards < 1 or vnodes < 1 or slack < 0:
        raise ValueError("shards and vnodes must be positive and slack not negative")
    spark = df.sparkSession
    nodes = ring(shards, vnodes)
    keyed = df.select(F.col(key).alias("_key")).select(
        "_key",
        arc_of(nodes)(F.xxhash64("_key")).alias("_arc"),
        F.xxhash64("_key", F.lit("order")).alias("_p"),
    ).withColumn("_level", F.shiftrightunsigned("_p", 60).cast("int"))
    # at most LEVELS * shards * vnodes rows come back, fixed by the ring
    counts = {(r["_level"], r["_arc"]): r["n"] for r in keyed.groupBy("_level", "_arc").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    capacity = max(1, math.ceil((1 + slack) * total / shards))
    segments = fill(counts, nodes, shards, capacity)
    columns = ["_level", "_arc", "_from", "_to", "home_shard", "shard", "hops"]
    table = pd.DataFrame(segments, columns=columns)
    table["_split"] = table.duplicated(["_level", "_arc"], keep=False)
    schema = "_level int, _arc int, _from long, _to long, home_shard int, shard int, hops int, _split boolean"
    # at most LEVELS * shards * vnodes + shards rows
    plain = spark.createDataFrame(table[~table["_split"]], schema).drop("_from", "_to", "_split")
    split = spark.createDataFrame(table[table["_split"]], schema).drop("_split")
    whole = keyed.join(F.broadcast(plain), ["_level", "_arc"])
    cells = split.select("_level", "_arc").distinct()
    order = Window.partitionBy("_level", "_arc").orderBy("_p", F.col("_key").asc_nulls_first())
    ranked = keyed.join(F.broadcast(cells), ["_level", "_arc"], "left_semi").withColumn("_rank", F.row_number().over(order) - 1)
    parts = ranked.join(F.broadcast(split), ["_level", "_arc"]).where("_rank >= _from AND _rank < _to")
    names = [F.col("_key").alias(key), "home_shard", "shard", "hops"]
    return whole.select(*names).unionByName(parts.select(*names))


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 64 shards of 64 virtual nodes, 5 % slack."""
    return assign(load(spark, sf_dir, "documents"), "doc_id")


QUERIES = {"op10_ring_shards": op10_ring_shards}
SQL: dict[str, str] = {}
