"""Documents (doc_id, source_path, content, len) from files, tables and memory."""

from __future__ import annotations

import fnmatch
import glob as globs
import os
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from needlework.functions.bytes import TEXT, InvalidInput, checked

SCHEMA = "doc_id long, source_path string, content binary, len long"
LISTED = "doc_id long, path string, size long"


def from_table(df: DataFrame, text: str = "text", doc_id: str = "doc_id", mode: str = TEXT) -> DataFrame:
    """A table's text or binary column; null contents are left out."""
    content = F.col(text).cast("binary")
    return df.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source_path"), checked(content, mode).alias("content"), F.octet_length(content).cast("long").alias("len"))


def from_memory(spark: SparkSession, documents: Sequence[bytes], mode: str = TEXT) -> DataFrame:
    """Documents in the order given."""
    if not documents:
        raise InvalidInput("no documents")
    if mode == TEXT and any(0 in d for d in documents):
        raise InvalidInput("zero byte in a text document")
    return spark.createDataFrame([(i, None, bytearray(d), len(d)) for i, d in enumerate(documents)], SCHEMA)


def from_single(spark: SparkSession, document: bytes, mode: str = TEXT) -> DataFrame:
    return from_memory(spark, [document], mode)


def validate_offsets(offsets: Sequence[int], length: int) -> None:
    """Starts of documents in one text: some, from 0, rising, within the text."""
    if not offsets:
        raise InvalidInput("no document offsets")
    if offsets[0] != 0:
        raise InvalidInput("the first document starts at 0")
    if any(b < a for a, b in zip(offsets, offsets[1:])):
        raise InvalidInput("document offsets must not fall")
    if offsets[-1] > length:
        raise InvalidInput("a document starts beyond the text")


def from_concatenated(spark: SparkSession, text: bytes, offsets: Sequence[int], mode: str = TEXT) -> DataFrame:
    """One text and its documents' starts."""
    validate_offsets(offsets, len(text))
    ends = [*offsets[1:], len(text)]
    return from_memory(spark, [text[a:b] for a, b in zip(offsets, ends)], mode)


def split_column(df: DataFrame, text: str = "content", offsets: str = "offsets") -> DataFrame:
    """Rows of (text, array of starts) cut into documents: doc_ordinal and content, inside Spark."""
    starts = df.withColumn("_n", F.octet_length(text)).select(
        "*",
        F.when((F.size(offsets) < 1) | (F.col(offsets)[0] != 0) | (F.array_max(offsets) > F.col("_n")) | (F.array_sort(offsets) != F.col(offsets)), F.raise_error(F.lit("document offsets must start at 0, rise and lie within the text"))).alias("_ok"),
    )
    exploded = starts.where("_ok IS NULL").select(text, "_n", offsets, F.posexplode(offsets).alias("doc_ordinal", "start"))
    stop = F.coalesce(F.try_element_at(offsets, F.col("doc_ordinal") + 2), F.col("_n"))
    return exploded.select(F.col("doc_ordinal").cast("long"), F.substring(F.col(text), (F.col("start") + 1).cast("int"), (stop - F.col("start")).cast("int")).alias("content"))


def collect_paths(patterns: Iterable[str]) -> list[str]:
    """Files that any of the globs (** too) names, each once, in byte order."""
    found = {os.path.abspath(p) for g in patterns for p in globs.glob(g, recursive=True, include_hidden=True) if os.path.isfile(p)}
    return sorted(found, key=os.fsencode)


def read_files(spark: SparkSession, paths: Sequence[str], mode: str = TEXT) -> DataFrame:
    """Files as documents, ids in the order given; a missing file is an error."""
    if not paths:
        raise InvalidInput("no input files")
    missing = [p for p in paths if not os.path.isfile(p)]
    if missing:
        raise FileNotFoundError(missing[0])
    order = spark.createDataFrame([(i, "file:" + os.path.abspath(p), os.path.getsize(p)) for i, p in enumerate(paths)], LISTED)
    return _contents(order, spark.read.format("binaryFile").load(sorted({os.path.abspath(p) for p in paths})), mode)


def _read_hidden(path: str | None) -> bytes | None:
    """A local file that Spark's reader skips; null for null."""
    if path is None:
        return None
    if not path.startswith("file:"):
        raise InvalidInput(f"Spark does not read {path}: names with _ or . in front are read from local folders only")
    with open(path.removeprefix("file:"), "rb") as f:
        return f.read()


def _contents(order: DataFrame, files: DataFrame, mode: str) -> DataFrame:
    """Contents for order(doc_id, path, size); Spark's reader skips files without bytes, and those with _ or . in front, which are documents all the same."""
    files = files.withColumn("path", F.regexp_replace("path", "^file:/*", "file:/"))
    joined = order.join(files, "path", "left").withColumn("_skipped", F.udf(_read_hidden, BinaryType())(F.when(F.col("content").isNull() & (F.col("size") > 0), F.col("path"))))
    content = F.coalesce(F.col("content"), F.col("_skipped"), F.lit(b""))
    return joined.select("doc_id", F.regexp_replace("path", "^file:", "").alias("source_path"), checked(content, mode).alias("content"), F.octet_length(content).cast("long").alias("len"))


def read_folder(spark: SparkSession, folder: str, name_glob: str = "*", recursive: bool = True, mode: str = TEXT) -> DataFrame:
    """Every file below a folder of any file system that Spark reads; ids are ranks of the paths in byte order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, recursive)
    found = []
    while listed.hasNext():
        status = listed.next()
        at = status.getPath()
        if fnmatch.fnmatchcase(at.getName(), name_glob):
            found.append((re.sub("^file:/*", "file:/", at.toString()), status.getLen()))
    if not found:
        raise FileNotFoundError(f"{folder}/{name_glob}")
    found.sort(key=lambda x: os.fsencode(x[0]))
    order = spark.createDataFrame([(i, *x) for i, x in enumerate(found)], LISTED)
    return _contents(order, spark.read.format("binaryFile").option("pathGlobFilter", name_glob).option("recursiveFileLookup", recursive).load(folder), mode)
