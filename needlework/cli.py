"""Commands: build, build-multi, ingest, query, doc, extract, stats."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from needlework.functions.bytes import MODES, TEXT, lossy
from needlework.operators import access, search, stats
from needlework.sources import config, corpus
from needlework.sources.index import build, keep_suffixes, open_index


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="needlework", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, inputs in (("build", None), ("build-multi", "+")):
        p = verbs.add_parser(verb)
        p.add_argument("input", nargs=inputs)
        p.add_argument("--output", required=True)
        p.add_argument("--sample-rate", type=int, default=32)
        p.add_argument("--encoding", choices=MODES, default=TEXT)
        p.add_argument("--suffixes", action="store_true", help="keep the suffix order too")
    p = verbs.add_parser("ingest")
    p.add_argument("--input", action="append", dest="inputs")
    p.add_argument("--output")
    p.add_argument("--config")
    p.add_argument("--chunk-size")
    p.add_argument("--read-buffer")
    p.add_argument("--workers", type=int)
    p.add_argument("--sample-rate", type=int)
    p.add_argument("--encoding", choices=MODES)
    p = verbs.add_parser("query")
    p.add_argument("index")
    p.add_argument("pattern")
    p.add_argument("--doc-safe", action="store_true")
    p = verbs.add_parser("doc")
    p.add_argument("index")
    p.add_argument("doc_id", type=int)
    p = verbs.add_parser("extract")
    p.add_argument("index")
    p.add_argument("start", type=int)
    p.add_argument("length", type=int)
    p.add_argument("--shard", type=int, default=0)
    verbs.add_parser("stats").add_argument("index")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    got = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("needlework").getOrCreate()
    show = lambda x: print(json.dumps(x))
    if got.verb in ("build", "build-multi"):
        paths = [got.input] if got.verb == "build" else got.input
        build(corpus.read_files(spark, paths, got.encoding), got.output, None, got.encoding, got.sample_rate)
        if got.suffixes:
            keep_suffixes(spark, got.output)
    elif got.verb == "ingest":
        flags = {k: getattr(got, k) for k in ("inputs", "output", "chunk_size", "read_buffer", "workers", "sample_rate", "encoding")}
        options = config.merged(config.load(got.config) if got.config else None, flags)
        show(ingest(spark, options))
    elif got.verb == "query":
        index = open_index(spark, got.index)
        hits = search.locate_merged(index.segments, got.pattern, index.mode, got.doc_safe).cache()
        show({"count": hits.count(), "preview": [list(r) for r in search.preview(hits, ["doc_id", "pos"]).collect()]})
        hits.unpersist()
    elif got.verb == "doc":
        sys.stdout.write(lossy(access.get_document(open_index(spark, got.index).segments, got.doc_id)) + "\n")
    elif got.verb == "extract":
        index = open_index(spark, got.index)
        sys.stdout.write(lossy(access.extract(index.segments, got.start, got.length, got.shard, index.mode)) + "\n")
    else:
        index = open_index(spark, got.index)
        show([r.asDict() for r in stats.index_stats(index.segments, index.sample_rate).orderBy("shard_id").collect()])


def ingest(spark: SparkSession, options: config.IngestConfig) -> dict:
    """Build a sharded index from globs; the report, also written beside it."""
    began = time.monotonic()
    docs = corpus.read_files(spark, corpus.collect_paths(options.inputs), options.encoding)
    build(docs, options.output, options.chunk_size, options.encoding, options.sample_rate)
    made = open_index(spark, options.output).segments
    report = stats.totals(made).first().asDict()
    seconds = time.monotonic() - began
    report |= {"seconds": round(seconds, 3), "bytes_per_second": round(report["total_bytes"] / max(seconds, 1e-9), 1) if report["total_bytes"] else 0.0}
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{options.output}/report")
    meta = made.groupBy("shard_id").agg(F.sum("len").alias("shard_bytes"), F.sort_array(F.collect_list(F.struct("ord", "doc_id", "part_index", "is_first", "is_last", "source_path", "doc_offset", "len", "shard_offset"))).alias("segments"))
    meta.write.mode("overwrite").json(f"{options.output}/meta")
    stats.index_stats(made, options.sample_rate).write.mode("overwrite").json(f"{options.output}/stats")
    return report


if __name__ == "__main__":
    main()
