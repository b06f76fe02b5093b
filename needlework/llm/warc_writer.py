"""Operator 1: deterministic sharded WARC writer.

Pages are put in the order of (url with its host's labels reversed, page_id, hash of the html, hash of the url). Running sizes over that order cut it into buckets of about
``bucket_bytes``, so a bucket's records depend on the pages alone and not on partitions, cores or attempts. One task writes a bucket: a gzip member per
record, a new file whenever the next record would take the file beyond ``file_bytes`` compressed. Headers are regenerated: record ids are name-based on url and payload,
dates are a parameter, lengths are counted, block and payload digests are SHA-1 in base 32. A file is written under a temporary name of its attempt and moved
to its final name when complete; attempts write the same bytes, so a lost or repeated task changes nothing. The manifest, one row per record, is written likewise
after all buckets are done: files that it doesn't list were never committed.

Nulls: a null url is written as an empty target; blanks and control characters of an url are percent-encoded in the header (the manifest has the url as it is); a null html as an empty payload. Pages given twice are written twice. Empty tables give an empty manifest and no
file. A record larger than ``file_bytes`` has a file of its own. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.llm.scratch import load, shared_path, written

BUCKET_BYTES = 64 << 20
FILE_BYTES = 16 << 20
MOST_TASKS = 50_000
DATE = "2024-01-01T00:00:00Z"
UNSAFE = re.compile(r"[\x00-\x20\x7f-\x9f\u2028\u2029]")
NAMESPACE = uuid.UUID("3d3c1f0e-5d1a-4a4e-9a53-6f1d5a1f7a10")
MANIFEST = "page_id long, url string, file string, record long, offset long, length long, payload_digest string, block_digest string"


def sort_key(url: Column) -> Column:
    """org,example,www)/path?query of an url."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?#]*", ""))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def target(url: str) -> str:
    """The url for a header line: nothing in it can end the line."""
    return UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def record(url: str, payload: bytes, date: str) -> tuple[bytes, str, str]:
    """An uncompressed response record, its payload digest and its block digest."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    of_payload, of_block = digest(payload), digest(block)
    name = uuid.uuid5(NAMESPACE, f"{url}\n{of_payload}")
    head = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {of_payload}",
        f"WARC-Block-Digest: {of_block}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", of_payload, of_block


def info(file: str, date: str) -> bytes:
    """The record that opens a file."""
    body = f"format: WARC File Format 1.1\r\nfilename: {file}\r\n".encode()
    name = uuid.uuid5(NAMESPACE, file)
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nWARC-Filename: {file}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Roller:
    """Writes the records of one bucket into files that are moved to their names when complete."""

    def __init__(self, folder: str, bucket: int, file_bytes: int, date: str):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.bucket, self.file_bytes, self.date = bucket, file_bytes, date
        self.attempt = uuid.uuid4().hex
        self.files = 0
        self.sink = None

    def open(self) -> None:
        self.name = f"part-{self.bucket:08d}-{self.files:05d}.warc.gz"
        self.fs.create_dir(f"{self.folder}/_temporary/{self.attempt}", recursive=True)
        self.path = f"{self.folder}/_temporary/{self.attempt}/{self.name}"
        self.sink = self.fs.open_output_stream(self.path, compression=None)
        self.records = 0
        self.size = self.sink.write(member(info(self.name, self.date)))
        self.files += 1

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.fs.move(self.path, f"{self.folder}/{self.name}")
            self.sink = None

    def end(self) -> None:
        self.close()
        if self.files:
            self.fs.delete_dir(f"{self.folder}/_temporary/{self.attempt}")

    def write(self, data: bytes) -> tuple[str, int, int, int]:
        """file, number in the file, offset, length."""
        packed = member(data)
        if self.sink is None:
            self.open()
        elif self.records and self.size + len(packed) > self.file_bytes:
            self.close()
            self.open()
        at = self.size
        self.sink.write(packed)
        self.size += len(packed)
        self.records += 1
        return self.name, self.records - 1, at, len(packed)


def write(pages: DataFrame, folder: str, bucket_bytes: int = BUCKET_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write pages(page_id, url, html) below folder (an URI) and return the manifest."""
    if bucket_bytes < 1 or file_bytes < 1:
        raise ValueError("sizes must be positive")
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), sort_key(F.col("url")).alias("_key"), F.xxhash64(html).alias("_hash"), F.xxhash64("url").alias("_url"))
    order = ["_key", "page_id", "_hash", "_url"]
    # running sizes over the global order, from the keys alone; partitions come and go, the order stays
    sizes = rows.select(*order, F.octet_length("html").cast("long").alias("_size")).repartitionByRange(*order).sortWithinPartitions(*order)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column(4).to_numpy()
            ends = np.cumsum(size) + so_far
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ends - size), pa.array(ends), pa.array(np.full(len(size), part, np.int32))], [*order, "_from", "_to", "_part"])
            so_far = int(ends[-1]) if len(ends) else so_far

    placed = written(sizes.mapInArrow(running, "_key string, page_id long, _hash long, _url long, _from long, _to long, _part int"), "sizes")
    # a row per partition comes to the driver, then a row per bucket
    totals = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.max("_to").alias("n")).collect()}
    before, offsets = 0, []
    for part in sorted(totals):
        offsets.append((part, before))
        before += totals[part]
    shifts = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))
    marks = placed.join(shifts, "_part").withColumn("bucket", F.floor((F.col("_before") + F.col("_from")) / bucket_bytes))
    firsts = marks.groupBy("bucket").agg(F.min(F.struct(*order)).alias("k")).orderBy("bucket").collect()
    ids = [int(r["bucket"]) for r in firsts]

    def sortable(k: str, page_id: int | None, h: int, u: int) -> tuple:
        # as Spark orders: strings by bytes, nulls first
        return k.encode(), page_id is not None, page_id or 0, h, u

    bounds = spark.sparkContext.broadcast([sortable(r["k"]["_key"], r["k"]["page_id"], r["k"]["_hash"], r["k"]["_url"]) for r in firsts])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        for batch in batches:
            keys = zip(batch.column(3).to_pylist(), batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            at = [bisect.bisect_right(bounds.value, sortable(*k)) - 1 for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([ids[i] for i in at], pa.int64()), pa.array(at, pa.int32())], [*batch.schema.names, "bucket", "_at"])

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = None
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for page_id, url, page, bucket in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "bucket")), strict=True):
                if roller is None or roller.bucket != bucket:
                    if roller is not None:
                        roller.end()
                    roller = Roller(folder, bucket, file_bytes, date)
                data, of_payload, of_block = record(url, page.encode(), date)
                for column, x in zip(out, (page_id, url, *roller.write(data), of_payload, of_block), strict=True):
                    column.append(x)
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])
        if roller is not None:
            roller.end()

    marked = rows.mapInArrow(place, "page_id long, url string, html string, _key string, _hash long, _url long, bucket long, _at int")
    # a bucket a task: hashed buckets would meet in some tasks and leave others idle
    files = marked.repartitionById(max(1, min(len(ids), MOST_TASKS)), "_at").sortWithinPartitions("bucket", *order).mapInArrow(roll, MANIFEST)
    manifest = written(files, "manifest")
    commit(manifest, folder)
    return manifest


def commit(manifest: DataFrame, folder: str) -> None:
    """List the complete files, under a temporary name first; leftovers of lost attempts are removed."""
    listed = manifest.groupBy("file").agg(F.count("*").alias("records"), F.max(F.col("offset") + F.col("length")).alias("bytes")).orderBy("file").toLocalIterator()
    at, root = fs.FileSystem.from_uri(folder)
    at.create_dir(root, recursive=True)
    path = f"{root}/manifest-{uuid.uuid4().hex}.tmp"
    with at.open_output_stream(path) as f:
        for r in listed:
            f.write((json.dumps(r.asDict()) + "\n").encode())
    at.move(path, f"{root}/manifest.jsonl")
    if at.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        at.delete_dir(f"{root}/_temporary")


def op1_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files in the shared folder; the manifest."""
    return write(load(spark, sf_dir, "pages"), shared_path(spark, "warc"))


QUERIES = {"op1_warc_writer": op1_warc_writer}
SQL: dict[str, str] = {}
