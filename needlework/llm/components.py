"""Connected components of an edge table, by alternating large-star and small-star steps; each step is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needlework.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(key, root) for every end of edges(a, b): root is the least key of its component. Loops and repeated edges are harmless."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    now = written(now, "edges")
    before = None
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
    roots = now.select(F.col("v").alias("key")).distinct().withColumn("root", F.col("key"))
    return now.select(F.col("u").alias("key"), F.col("v").alias("root")).union(roots)
