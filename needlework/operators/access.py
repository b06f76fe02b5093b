"""Random access: slices of the text, whole documents, and the document at a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.functions.bytes import BINARY, TEXT, InvalidInput
from needlework.operators.shard import ranged


def offsets(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop) of documents(doc_id, len) written one after another in id order: sums of the ranges first, then running sums within a range."""
    ordered = ranged(docs)
    # a row for each range of a million documents
    before, heads = 0, []
    for r in ordered.groupBy("part").agg(F.sum("len").alias("n")).orderBy("part").collect():
        heads.append((r["part"], before))
        before += r["n"]
    ahead = docs.sparkSession.createDataFrame(heads, "part int, _head long")
    within = Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = (F.col("_head") + F.sum("len").over(within)).cast("long")
    return ordered.join(F.broadcast(ahead), "part").select("doc_id", (stop - F.col("len")).alias("start"), stop.alias("stop"))


def documents_at(bounds: DataFrame, places: DataFrame, text_len: int) -> DataFrame:
    """(pos, doc_id, doc_offset) for each row of places(pos); no row beyond the text. The end mark belongs to the last document.

    bounds: (doc_id, start, stop). Places are paired with the last document that starts at or before them, through one sorted union; empty documents never win.
    """
    full = bounds.where("stop > start")
    marks = full.select(F.col("start").alias("at"), F.lit(0).alias("kind"), "doc_id", "start").union(places.select(F.col("pos").cast("long").alias("at"), F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("long")))
    width = 1 << 20
    # a document is also a mark at the head of each later block that it reaches
    blocks = full.select(F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("block"), "doc_id", "start").select(
        (F.greatest(F.col("block") * width, F.col("start"))).cast("long").alias("at"), F.lit(0).alias("kind"), "doc_id", "start", "block"
    )
    asked = marks.where("kind = 1").withColumn("block", F.floor(F.col("at") / width))
    last = Window.partitionBy("block").orderBy("at", "kind", "start").rowsBetween(Window.unboundedPreceding, 0)
    filled = blocks.union(asked).select("at", "kind", F.last("doc_id", True).over(last).alias("doc_id"), F.last("start", True).over(last).alias("start"))
    return filled.where((F.col("kind") == 1) & F.col("at").between(0, text_len - 1)).select(F.col("at").alias("pos"), "doc_id", (F.col("at") - F.col("start")).alias("doc_offset"))


def extract(segments: DataFrame, start: int, length: int, shard_id: int = 0, mode: str = TEXT) -> bytes:
    """Bytes [start, start + length) of a shard's text; in text mode the end mark reads as a zero byte."""
    if start < 0 or length < 0:
        raise InvalidInput("start and length aren't negative")
    if not length:
        return b""
    shard = segments.where(F.col("shard_id") == shard_id)
    text_len = (shard.agg(F.max(F.col("shard_offset") + F.col("len"))).first()[0] or 0) + 1
    if start + length > text_len:
        raise InvalidInput(f"[{start}, {start + length}) reaches beyond the text of {text_len}")
    if mode == BINARY and start + length == text_len:
        raise InvalidInput("the end mark has no byte in binary mode")
    parts = slices(shard, start, length).orderBy("shard_offset").collect()
    got = b"".join(bytes(r["part"]) for r in parts)
    return got + b"\0" * (length - len(got))


def slices(segments: DataFrame, start: int, length: int, keys: list[str] | None = None) -> DataFrame:
    """The parts of segments that [start, start + length) touches."""
    lo = F.greatest(F.lit(start) - F.col("shard_offset"), F.lit(0))
    hi = F.least(F.lit(start + length) - F.col("shard_offset"), F.col("len"))
    touched = segments.where((F.col("shard_offset") < start + length) & (F.col("shard_offset") + F.col("len") > start))
    return touched.select(*(keys or []), "shard_offset", F.substring("content", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))


def extracts(segments: DataFrame, start: int, length: int) -> DataFrame:
    """(shard_id, content): bytes [start, start + length) of every shard's text, as far as it goes, without end marks."""
    touched = slices(segments, start, length, ["shard_id"])
    return touched.groupBy("shard_id").agg(F.expr("listagg(part, x'') WITHIN GROUP (ORDER BY shard_offset)").alias("content"))


def snippet(content: Column, start: int, length: int) -> Column:
    """Bytes [start, start + length) of a document, as far as it goes."""
    return F.substring(content, start + 1, length)


def reassembled(segments: DataFrame) -> DataFrame:
    """(doc_id, content) of every document that has segments."""
    return segments.groupBy("doc_id").agg(F.expr("listagg(content, x'') WITHIN GROUP (ORDER BY part_index)").alias("content"))


def get_document(segments: DataFrame, doc_id: int) -> bytes:
    """A document's bytes from its parts; an unknown id is an error."""
    parts = segments.where(F.col("doc_id") == doc_id).select("part_index", "content").orderBy("part_index").collect()
    if not parts:
        raise KeyError(f"no document {doc_id}")
    return b"".join(bytes(r["content"]) for r in parts)


def doc_count(segments: DataFrame) -> int:
    return segments.select("doc_id").distinct().count()


def shard_count(segments: DataFrame) -> int:
    return segments.select("shard_id").distinct().count()
