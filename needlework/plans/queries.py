"""The registered searches over the tables; each takes (spark, sf_dir) and returns flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.functions.bytes import BINARY, format_bytes, one_char_per_byte
from needlework.operators import access, search, shard, stats, suffix
from needlework.sources import corpus

CHUNK = 65536
SMALL_CHUNK = 4097
THE, EE, ACCENT, TION = b"the ", b"ee", "é".encode(), b"tion"
BATCH = {"the": THE, "ee": EE, "accent": ACCENT, "tion": TION, "absent": b"qqqq", "period": b".\n"}
RANGE = (30_000, 600)
PLACES = [0, 1, 99, 100, 5000, 99999, 100000, 250000]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_table(load(spark, sf_dir, "documents"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.from_table(load(spark, sf_dir, "pages"), "html", "page_id")


def parts(spark: SparkSession, sf_dir: str, chunk: int | None = CHUNK) -> DataFrame:
    return shard.segments(docs(spark, sf_dir), chunk)


def grouped(spark: SparkSession, sf_dir: str, chunk: int | None = CHUNK) -> DataFrame:
    """The same, each shard in one partition, for what is done shard by shard."""
    return shard.segments(docs(spark, sf_dir), chunk, grouped=True)


def count_pattern_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_per_document(docs(spark, sf_dir), THE)


def count_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_per_document(docs(spark, sf_dir), EE)


def count_total_doc_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_per_document(docs(spark, sf_dir), THE).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def locate_doc_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate_doc_safe(docs(spark, sf_dir), THE)


def locate_multibyte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate_doc_safe(docs(spark, sf_dir), ACCENT)


def locate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate_doc_safe(pages(spark, sf_dir), b"</p>").withColumnRenamed("doc_id", "page_id")


def conversation_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").cast("binary").alias("content"))
    from needlework.functions.bytes import hits_in

    hits = turns.select("conv_id", "role", hits_in(one_char_per_byte(F.col("content")), TION).alias("n"))
    return hits.where("n > 0").groupBy("conv_id", "role").agg(F.sum("n").alias("n"))


def locate_cross_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as one text, hits running on from one to the next."""
    return search.locate(parts(spark, sf_dir, None), b".L").select("doc_id", F.col("doc_offset").alias("pos"), F.col("shard_pos").alias("text_pos"))


def cross_doc_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.crossing_hits(parts(spark, sf_dir, None), b".L", "shard")
    return found.select("doc_id", F.col("doc_offset").alias("pos"))


def count_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.total(search.locate(parts(spark, sf_dir, None), b".L"))


def doc_hits_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.locate_doc_safe(docs(spark, sf_dir), THE)
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def top_docs_by_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_per_document(docs(spark, sf_dir), THE).orderBy(F.desc("n"), "doc_id").limit(10)


def first5_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.preview(search.locate_doc_safe(docs(spark, sf_dir), THE), ["doc_id", "pos"])


def batch_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.batch_counts(docs(spark, sf_dir), BATCH)


def benchmark_passage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each benchmark text stands whole in a document."""
    from needlework.operators.lookup import find_all

    items = load(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", F.col("text").cast("binary").alias("pattern"))
    return find_all(docs(spark, sf_dir), items)


def hits_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    from needlework.functions.bytes import hits_in

    rows = load(spark, sf_dir, "documents").select("lang", hits_in(one_char_per_byte(F.col("text").cast("binary")), TION).alias("n"))
    return rows.groupBy("lang").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("n_docs"))


def hits_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from needlework.functions.bytes import hits_in

    rows = load(spark, sf_dir, "documents").select("source", hits_in(one_char_per_byte(F.col("text").cast("binary")), THE).alias("n"))
    return rows.groupBy("source").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("n_docs"))


def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.offsets(docs(spark, sf_dir)).select("doc_id", "start", "stop")


def pos_to_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = access.offsets(docs(spark, sf_dir))
    text_len = (bounds.agg(F.max("stop")).first()[0] or 0) + 1
    places = spark.createDataFrame([(p,) for p in [*PLACES, text_len - 1, text_len, text_len + 10]], "pos long")
    return access.documents_at(bounds, places, text_len)


def extract_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.hex(access.snippet(F.col("content"), 10, 40)).alias("snippet"))


def get_document_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = access.reassembled(parts(spark, sf_dir, SMALL_CHUNK))
    return whole.select("doc_id", F.md5("content").alias("digest"), F.octet_length("content").cast("long").alias("len"))


def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = shard.plan(docs(spark, sf_dir), CHUNK)
    return made.groupBy("shard_id").agg(F.count("*").alias("n_segments"), F.sum("len").alias("n_bytes"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.plan(docs(spark, sf_dir), SMALL_CHUNK)


def sharded_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate(parts(spark, sf_dir, SMALL_CHUNK), TION).select(*search.HITS)


def sharded_locate_doc_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate_safe(parts(spark, sf_dir, SMALL_CHUNK), TION).select(*search.HITS)


def merged_locate_doc_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate_merged(parts(spark, sf_dir, SMALL_CHUNK), THE, doc_safe=True)


def merged_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate_merged(parts(spark, sf_dir, SMALL_CHUNK), TION)


def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.total(search.locate_merged(parts(spark, sf_dir, SMALL_CHUNK), THE, doc_safe=True))


def sharded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the shards, those over seams left out, by whether they may cross documents."""
    made = parts(spark, sf_dir, SMALL_CHUNK)
    every = search.locate(made, TION).agg(F.count("*").alias("n")).select(F.lit("shards").alias("kind"), "n")
    safe = search.locate_safe(made, TION).agg(F.count("*").alias("n")).select(F.lit("doc_safe").alias("kind"), "n")
    return every.union(safe)


def seam_hits_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.seam_hits(parts(spark, sf_dir, SMALL_CHUNK), THE)


def symbol_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.symbol_histogram(docs(spark, sf_dir))


def c_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.c_table(stats.symbol_histogram(docs(spark, sf_dir)))


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard per benchmark text."""
    items = load(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    return items.select(F.col("item_id").cast("int").alias("shard_id"), F.col("item_id").alias("doc_id"), F.lit(0).cast("long").alias("shard_offset"), F.col("text").cast("binary").alias("content"))


def suffix_array_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffixes(small(spark, sf_dir)).select(F.col("shard_id").cast("long").alias("item_id"), "row", "sa")


def bwt_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffixes(small(spark, sf_dir)).select(F.col("shard_id").cast("long").alias("item_id"), "row", F.col("bwt").cast("long").alias("bwt"))


def lf_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.lf_steps(suffix.suffixes(small(spark, sf_dir))).select(F.col("shard_id").cast("long").alias("item_id"), "row", "lf")


def interval_sp_ep(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = small(spark, sf_dir)
    found = suffix.intervals(texts, suffix.suffixes(texts), {"th": b"th", "e": b"e", "on ": b"on ", "zz": b"zz", "": b""})
    return found.select(F.col("shard_id").cast("long").alias("item_id"), "pattern", "sp", "ep")


def rank_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.ranks(suffix.suffixes(small(spark, sf_dir)), ord("e"), 50)
    return found.select(F.col("shard_id").cast("long").alias("item_id"), "n")


def resolve_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of rows and rows of places."""
    table = suffix.suffixes(small(spark, sf_dir))
    rows = suffix.resolve(table, range(0, 80, 32)).select("shard_id", F.lit("sa").alias("kind"), F.col("row").alias("asked"), F.col("sa").alias("found"))
    places = suffix.inverse(table, range(0, 80, 32)).select("shard_id", F.lit("isa"), "sa", "row")
    return rows.union(places).select(F.col("shard_id").cast("long").alias("item_id"), "kind", "asked", "found")


def rank_every_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all symbols at all rows, listed where they grow."""
    return suffix.ranks_by_shard(small(spark, sf_dir)).select(F.col("shard_id").cast("long").alias("item_id"), "symbol", "row", "n")


def resolve_every_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all rows and rows of all places."""
    return suffix.resolved_by_shard(small(spark, sf_dir)).select(F.col("shard_id").cast("long").alias("item_id"), "kind", "asked", "found")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.index_stats(parts(spark, sf_dir))


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(parts(spark, sf_dir))


def locate_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations share their conversation's id: places are those within each turn."""
    turns = corpus.from_table(load(spark, sf_dir, "conversations"), "text", "conv_id")
    return search.locate_doc_safe(turns, TION).withColumnRenamed("doc_id", "conv_id")


def locate_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate_doc_safe(corpus.from_table(load(spark, sf_dir, "documents"), mode=BINARY), ACCENT, BINARY)


def locate_one_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.locate_merged(parts(spark, sf_dir, SMALL_CHUNK), b"q", doc_safe=True)


def count_empty_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty pattern stands at every byte of every shard and at its end mark."""
    return search.total(search.locate(parts(spark, sf_dir), b""))


def extract_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of every shard's text, over the ends of its documents."""
    got = access.extracts(parts(spark, sf_dir), *RANGE)
    return got.select("shard_id", F.hex("content").alias("slice"))


def locate_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits read off the suffix order of shards of several documents."""
    return suffix.located_by_shard(grouped(spark, sf_dir), TION)


def count_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in each shard from the ends of the pattern's interval."""
    found = suffix.intervals_by_shard(grouped(spark, sf_dir), {"": TION})
    return found.where("sp <= ep").select("shard_id", (F.col("ep") - F.col("sp") + 1).alias("n"))


def access_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte before the suffix of each text's third row."""
    found = suffix.access(suffix.suffixes(small(spark, sf_dir)), 2)
    return found.select(F.col("shard_id").cast("long").alias("item_id"), F.col("bwt").cast("long").alias("bwt"))


def doc_hits_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted places of each document with hits, as text."""
    found = search.doc_hits(search.locate_doc_safe(docs(spark, sf_dir), TION))
    return found.select("doc_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), "n")


def concatenated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one text with its turns' starts, cut into documents again."""
    turns = load(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.struct("turn", F.col("text").cast("binary").alias("c")).alias("t"))
    joined = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id",
        F.aggregate("t", F.lit(b""), lambda a, x: F.concat(a, x["c"])).alias("content"),
        F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.aggregate(F.slice("t", 1, i - 1), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["c"]))).alias("offsets"),
    )
    return corpus.split_column(joined).groupBy("doc_ordinal").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("n_bytes"), F.min(F.md5("content")).alias("digest"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each shard, and as shown to people."""
    by = parts(spark, sf_dir).groupBy("shard_id").agg(F.sum("len").alias("n_bytes"))
    return by.select("shard_id", "n_bytes", format_bytes(F.col("n_bytes")).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (
        count_pattern_per_doc,
        count_overlapping,
        count_total_doc_safe,
        count_total,
        locate_doc_safe,
        locate_multibyte,
        locate_pages,
        conversation_hits,
        locate_cross_doc,
        cross_doc_only,
        doc_hits_count,
        top_docs_by_hits,
        first5_preview,
        batch_pattern_counts,
        benchmark_passage_lookup,
        hits_by_lang,
        hits_by_source,
        doc_offsets,
        pos_to_doc,
        extract_snippet,
        get_document_digest,
        shard_plan,
        segment_table,
        sharded_locate,
        sharded_locate_doc_safe,
        merged_locate_doc_safe,
        merged_locate,
        merged_counts,
        sharded_counts,
        seam_hits_only,
        symbol_histogram,
        c_table,
        suffix_array_small,
        bwt_small,
        lf_small,
        interval_sp_ep,
        rank_small,
        resolve_small,
        rank_every_small,
        resolve_every_small,
        index_stats,
        ingest_totals,
        shard_sizes,
        locate_repeated_ids,
        locate_binary,
        locate_one_byte,
        count_empty_pattern,
        extract_range,
        locate_indexed,
        count_indexed,
        access_small,
        doc_hits_listed,
        concatenated_documents,
    )
}
