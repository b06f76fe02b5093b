"""Exact substring search over documents and segments, in bytes, overlaps included.

Hits inside a segment come from a scan that moves no content. Hits that cross segment ends come from the ends alone: the last m - 1 bytes of each segment and the first m - 1
of those that follow, which is all that a shuffle carries. Which segments follow depends on the search: the next ones of the shard (the text runs on from document
to document), the next parts of the same document (seams), or neither (safe within a segment).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.functions.bytes import TEXT, hits_in, latin, one_char_per_byte, pattern_bytes, places

HITS = ["shard_id", "shard_pos", "doc_id", "doc_offset"]
BLOCK = 1 << 16


def count_per_document(docs: DataFrame, pattern: bytes | str, mode: str = TEXT) -> DataFrame:
    """(doc_id, n) of the documents with hits, none crossing a document's end; docs has doc_id and content."""
    raw = pattern_bytes(pattern, mode)
    if not raw:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n")).where("n > 0")
    return docs.select("doc_id", hits_in(one_char_per_byte(F.col("content")), raw).alias("n")).where("n > 0")


def positions(rows: DataFrame, s: Column, raw: bytes, keys: list[str]) -> DataFrame:
    """keys and pos (bytes) of each occurrence of raw in s, row by row: keys may repeat or be null."""
    found = rows.select(*keys, s.alias("_s")).where(F.contains("_s", latin(raw)))
    return found.select(*keys, F.explode(places(F.col("_s"), raw)).alias("pos"))


def locate_doc_safe(docs: DataFrame, pattern: bytes | str, mode: str = TEXT) -> DataFrame:
    """(doc_id, pos) of every hit within a document; none for the empty pattern."""
    raw = pattern_bytes(pattern, mode)
    if not raw:
        return docs.select("doc_id", F.lit(0).cast("long").alias("pos")).where("false")
    return positions(docs, one_char_per_byte(F.col("content")), raw, ["doc_id"])


def inner_hits(segments: DataFrame, raw: bytes) -> DataFrame:
    """Hits that lie within one segment."""
    keys = ["shard_id", "ord", "doc_id", "doc_offset", "shard_offset"]
    found = positions(segments, one_char_per_byte(F.col("content")), raw, keys)
    return found.select("shard_id", (F.col("shard_offset") + F.col("pos")).alias("shard_pos"), "doc_id", (F.col("doc_offset") + F.col("pos")).alias("doc_offset"))


def crossing_hits(segments: DataFrame, raw: bytes, follow: str) -> DataFrame:
    """Hits that begin in one segment and end in another. follow: "shard", "document" or "either" (the document's next part, and the shard's next document after its last)."""
    m = len(raw)
    if m < 2:
        return inner_hits(segments.where("false"), raw)
    content = F.col("content")
    ends = segments.where("len > 0").select(
        *["shard_id", "ord", "doc_id", "part_index", "is_last", "doc_offset", "shard_offset", "len"],
        one_char_per_byte(F.substring(content, 1, m - 1)).alias("_head"),
        one_char_per_byte(F.substring(content, F.greatest(F.col("len") - m + 2, F.lit(1)).cast("int"), m - 1)).alias("_tail"),
    )

    def following(window) -> Column:
        return F.substring(F.array_join(F.collect_list("_head").over(window.rowsBetween(1, m - 1)), ""), 1, m - 1)

    of_document = following(Window.partitionBy("doc_id").orderBy("part_index"))
    if follow == "document":
        ends = ends.withColumn("_after", of_document)
    else:
        # blocks of a shard side by side; the first m - 1 segments of a block are also seen by the block before it
        block = F.floor(F.col("ord") / BLOCK)
        seen = F.when(F.col("ord") % BLOCK < m - 1, F.array(block, block - 1)).otherwise(F.array(block))
        spread = ends.withColumn("_block", F.explode(seen))
        of_shard = following(Window.partitionBy("shard_id", "_block").orderBy("ord"))
        ends = spread.withColumn("_after", of_shard).where(F.col("_block") == block)
        if follow == "either":
            ends = ends.withColumn("_after", F.when(F.col("is_last"), F.col("_after")).otherwise(of_document))
    tail = F.length("_tail")
    keys = ["shard_id", "ord", "doc_id", "doc_offset", "shard_offset", "len", "_n"]
    found = positions(ends.withColumn("_n", tail), F.concat("_tail", "_after"), raw, keys).where((F.col("pos") < F.col("_n")) & (F.col("pos") + m > F.col("_n")))
    at = F.col("len") - F.col("_n") + F.col("pos")
    return found.select("shard_id", (F.col("shard_offset") + at).alias("shard_pos"), "doc_id", (F.col("doc_offset") + at).alias("doc_offset"))


def every_position(segments: DataFrame) -> DataFrame:
    """What the empty pattern locates: every byte of every shard, and the end mark after its last one."""
    each = segments.where("len > 0").select("shard_id", "shard_offset", "doc_id", "doc_offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("p"))
    inside = each.select("shard_id", (F.col("shard_offset") + F.col("p")).alias("shard_pos"), "doc_id", (F.col("doc_offset") + F.col("p")).alias("doc_offset"))
    last = segments.groupBy("shard_id").agg(F.max(F.struct(F.col("shard_offset") + F.col("len"), "doc_id", F.col("doc_offset") + F.col("len"))).alias("e"))
    return inside.union(last.select("shard_id", F.col("e.col1"), F.col("e.doc_id"), F.col("e.col3")))


def locate(segments: DataFrame, pattern: bytes | str, mode: str = TEXT) -> DataFrame:
    """Hits of each shard's text, documents run on into each other; order by HITS for the sorted list."""
    raw = pattern_bytes(pattern, mode)
    if not raw:
        return every_position(segments)
    return inner_hits(segments, raw).union(crossing_hits(segments, raw, "shard"))


def locate_safe(segments: DataFrame, pattern: bytes | str, mode: str = TEXT) -> DataFrame:
    """Hits of each shard that cross no document's end (nor a shard's)."""
    raw = pattern_bytes(pattern, mode)
    return inner_hits(segments, raw) if raw else every_position(segments).where("false")


def locate_merged(segments: DataFrame, pattern: bytes | str, mode: str = TEXT, doc_safe: bool = False) -> DataFrame:
    """(doc_id, pos), each once: hits of the shards and those over seams between parts of a document."""
    raw = pattern_bytes(pattern, mode)
    if not raw:
        hits = every_position(segments)
        return hits.select("doc_id", F.col("doc_offset").alias("pos")).distinct() if not doc_safe else hits.select("doc_id", F.col("doc_offset").alias("pos")).where("false")
    hits = inner_hits(segments, raw).union(crossing_hits(segments, raw, "document" if doc_safe else "either"))
    # inner and crossing hits are disjoint, and a place belongs to one segment: nothing to remove
    return hits.select("doc_id", F.col("doc_offset").alias("pos"))


def seam_hits(segments: DataFrame, pattern: bytes | str, mode: str = TEXT) -> DataFrame:
    """(doc_id, pos) of hits over seams between parts of one document."""
    raw = pattern_bytes(pattern, mode)
    return crossing_hits(segments, raw, "document").select("doc_id", F.col("doc_offset").alias("pos"))


def doc_hits(found: DataFrame) -> DataFrame:
    """(doc_id, positions, n): sorted distinct places of each document with hits."""
    listed = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    return listed.withColumn("n", F.size("positions").cast("long"))


def total(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n"))


def preview(found: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first hits in order."""
    return found.orderBy(*order).limit(n)


def batch_counts(docs: DataFrame, patterns: dict[str, bytes | str], mode: str = TEXT) -> DataFrame:
    """(pattern, n, n_docs) of many patterns in one scan, hits within documents."""
    s = one_char_per_byte(F.col("content"))
    columns, names = [], list(patterns)
    for i, name in enumerate(names):
        raw = pattern_bytes(patterns[name], mode)
        columns.append((hits_in(s, raw) if raw else F.lit(0).cast("long")).alias(f"c{i}"))
    sums = docs.select(*columns).agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"s{i}") for i in range(len(names))], *[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(names))])
    rows = F.array(*[F.struct(F.lit(x).alias("pattern"), F.col(f"s{i}").alias("n"), F.col(f"d{i}").alias("n_docs")) for i, x in enumerate(names)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")
