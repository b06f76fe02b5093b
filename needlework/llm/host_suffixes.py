"""Operator 4: HTML extraction by a suffix array over each host's pages.

A page becomes a stream of tokens: words, and its tags by name; comments, scripts and styles are left out. Runs of ``WINDOW`` tokens that occur on two distinct pages of
the same host are boilerplate, wherever they occur; every token that such a run covers goes, and the words of the unique runs are kept, with a line
break where a block of the page ends.

Streams move once, compressed, to bins of about ``GROUP_BYTES`` of html. A bin holds hosts whole, or parts of a larger host (by page). It concatenates its streams, cuts
out the stretches whose minimizers recur on another page, sorts their suffixes (difference cover) and reads the repeated runs off the order. A larger host's parts
tell each other what they share: first their minimizers, then the hashes of the windows round those that two parts have; both follow the bins' distinct
minimizers, not the texts, so a host may be of any size.

Nulls and empty pages give an empty text. A null url is a host of its own. A page given twice (same page_id) is one page and covers nothing of itself. Pages of any
length are read whole. Empty tables give an empty result. Columns other than page_id, url and html are ignored. Runs of one token over and over aren't boilerplate.
"""

from __future__ import annotations

import html as entities
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.llm import tokens
from needlework.llm.repeats import anchors, covered, strips
from needlework.llm.scratch import load, written

WINDOW = 12
GROUP_BYTES = 8 << 20
#: of a bin's minimizers, sorted one after the other
SHARES = 8
#: hosts of more than one part that are sent to all tasks at most; more are joined by a shuffle
BROADCAST_HOSTS = 100_000
NULL_KEY = -(2**63)
#: characters that part words by bytes but not for str.split
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f]")
MARK = "\x7f"
OPEN = "\x01"
_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>")
INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "small", "sub", "sup", "code", "font", "abbr", "mark", "img"}


def stream(page: str) -> str:
    """Words and marked tag names, parted by single spaces."""
    page = _closed(_GONE.sub(" ", _closed(CONTROL.sub(" ", page.replace(MARK, "")))))
    out, at = [], 0
    for tag in _TAG.finditer(page):
        out.append(entities.unescape(page[at : tag.start()].replace(OPEN, "<")))
        out.append(MARK + tag[1].lower())
        at = tag.end()
    out.append(entities.unescape(page[at:].replace(OPEN, "<")))
    return " ".join(_words(out))


def _closed(page: str) -> str:
    """The page with OPEN for each < that no > follows, so that no pattern reads to the page's end in vain; what an open comment hides is left out."""
    last = page.rfind(">") + 1
    tail, comment, _ = page[last:].partition("<!--")
    return page[:last] + tail.replace("<", OPEN) + comment


def _words(parts: list[str]) -> Iterator[str]:
    for i, x in enumerate(parts):
        if i % 2:
            yield x
        else:
            yield from x.replace(MARK, "").split()


def text_of(kept: list[str]) -> str:
    """Words of kept tokens; a block's tag breaks the line."""
    lines: list[list[str]] = [[]]
    for t in kept:
        if t[0] != MARK:
            lines[-1].append(t)
        elif t[1:].lstrip("/") not in INLINE and lines[-1]:
            lines.append([])
    return "\n".join(" ".join(x) for x in lines if x)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def streams(rows: DataFrame) -> DataFrame:
    """rows(key, host, parts, bin, html) with the token stream in place of the html: its size and its compressed bytes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [stream(x or "").encode() for x in part.column(4).to_pylist()]
                packed = pa.array([codec.compress(x, asbytes=True) if x else b"" for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([len(x) for x in raw], pa.int32()), packed], ["key", "host", "parts", "bin", "size", "packed"])

    return rows.select("key", "host", "parts", "bin", "html").mapInArrow(parse, "key long, host string, parts int, bin int, size int, packed binary")


class Bin:
    """The streams of a bin's pages, or of those whose hosts have several parts."""

    def __init__(self, table: pa.Table, window: int, split_only: bool):
        if split_only:
            table = table.filter(pc.greater(table.column("parts"), 1))
        codec = pa.Codec("zstd")
        self.host = table.column("host").to_pylist()
        self.key = table.column("key").to_numpy()
        sizes, packed = table.column("size").to_pylist(), table.column("packed").to_pylist()
        self.texts = [codec.decompress(x, n, asbytes=True).decode() if n else "" for x, n in zip(packed, sizes, strict=True)]
        words = tokens.words(pa.array(self.texts, pa.large_string()))
        # equal words of different hosts are different tokens
        salt = np.array([xxhash.xxh64_intdigest(x, seed=1) for x in self.host], np.uint64)
        self.words = tokens.Words(tokens.mix(words.hashes ^ np.repeat(salt, np.diff(words.first))), words.first)
        self.window = window
        self.starts, self.best, self.grams = anchors(self.words, window)
        self.anchor = self.grams[self.best]

    def windows(self) -> np.ndarray:
        """A hash of the window at each start."""
        return tokens.runs(self.words.hashes, self.window)[self.starts]

    def cover(self, foreign: np.ndarray) -> np.ndarray:
        """For each token whether a window covers it that is on another page of the bin or among the foreign ones."""
        change = np.zeros(len(self.words.hashes) + 1, np.int64)
        if not len(self.starts):
            return change[:-1] > 0
        row = np.searchsorted(self.words.first, self.starts, "right") - 1
        by = np.argsort(self.anchor, kind="stable")
        lead = np.flatnonzero(np.concatenate([[True], self.anchor[by[1:]] != self.anchor[by[:-1]]]))
        key = self.key[row[by]]
        shared = np.minimum.reduceat(key, lead) != np.maximum.reduceat(key, lead)
        chosen = np.zeros(len(by), bool)
        chosen[by] = np.repeat(shared, np.diff(np.concatenate([lead, [len(by)]])))
        # windows that are equal have equal anchors: a share of these at a time takes a share of the memory
        share = (self.anchor >> np.uint64(32)) % np.uint64(SHARES)
        for part in range(SHARES):
            own = chosen & (share == part)
            if not own.any():
                continue
            _, at, begin, data = strips(self.words, self.window, self.starts[own], self.best[own])
            table = pa.table({"key": self.key[at], "tid": at, "start": begin, "words": data})
            found = covered(table, self.window, first_stays=False)
            head = self.words.first[found.column("tid").to_numpy()]
            np.add.at(change, head + found.column("start").to_numpy(), 1)
            np.add.at(change, head + found.column("stop").to_numpy(), -1)
        if len(foreign):
            hit = self.starts[np.isin(self.windows(), foreign)]
            np.add.at(change, hit, 1)
            np.add.at(change, hit + self.window, -1)
        return np.cumsum(change[:-1]) > 0


def hashes(table: pa.Table) -> np.ndarray:
    return table.column("h").to_numpy().view(np.uint64)


def shared_by_bins(found: DataFrame) -> DataFrame:
    """The rows (h, bin) whose h another bin has too."""
    same = Window.partitionBy("h")
    return found.withColumn("_a", F.min("bin").over(same)).withColumn("_b", F.max("bin").over(same)).where("_a != _b").select("h", "bin")


def extract(pages: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """page_id, host, text, n_tokens, n_covered of every page."""
    if window < 2:
        raise ValueError("a run has two tokens at least")
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_KEY)).alias("key"), host_of(F.col("url")).alias("host"), "html")
    hosts = written(rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("n")), "hosts")
    bins = max(1, math.ceil((hosts.agg(F.sum("n")).first()[0] or 0) / group_bytes))
    large = hosts.where(F.col("n") > group_bytes).select("host", F.ceil(F.col("n") / group_bytes).cast("int").alias("parts"))
    split = large.count()
    if split:
        rows = rows.join(F.broadcast(large) if split <= BROADCAST_HOSTS else large, "host", "left")
    else:
        rows = rows.withColumn("parts", F.lit(1))
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    read = streams(rows.withColumn("bin", F.pmod(F.xxhash64("host", part), F.lit(bins)).cast("int"))).groupBy("bin")

    def emit(values: np.ndarray, key: tuple) -> pa.Table:
        values = np.unique(values)
        return pa.table({"h": pa.array(values.view(np.int64), pa.int64()), "bin": pa.array(np.full(len(values), key[0].as_py()), pa.int32())})

    def minimizers(key: tuple, table: pa.Table) -> pa.Table:
        return emit(Bin(table, window, True).anchor, key)

    def candidates(key: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return emit(np.zeros(0, np.uint64), key)
        here = Bin(table, window, True)
        return emit(here.windows()[np.isin(here.anchor, hashes(asked))], key)

    def keep(key: tuple, table: pa.Table, foreign: np.ndarray) -> pa.Table:
        here = Bin(table, window, False)
        gone = here.cover(foreign)
        first = here.words.first
        total = np.diff(first)
        before = np.concatenate([[0], np.cumsum(gone)])
        kept = [text_of(list(itertools.compress(t.split(), ~gone[a:b]))) for t, a, b in zip(here.texts, first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.table({"key": pa.array(here.key, pa.int64()), "host": pa.array(here.host, pa.string()), "text": pa.array(kept, pa.string()), "n_tokens": pa.array(total, pa.int64()), "n_covered": pa.array(before[first[1:]] - before[first[:-1]], pa.int64())})

    schema = "key long, host string, text string, n_tokens long, n_covered long"
    if split:
        # all three passes read the streams from one exchange
        asked = shared_by_bins(read.applyInArrow(minimizers, "h long, bin int"))
        foreign = shared_by_bins(read.cogroup(asked.groupBy("bin")).applyInArrow(candidates, "h long, bin int"))
        out = read.cogroup(foreign.groupBy("bin")).applyInArrow(lambda key, table, found: keep(key, table, hashes(found)), schema)
    else:
        out = read.applyInArrow(lambda key, table: keep(key, table, np.zeros(0, np.uint64)), schema)
    return out.select(F.when(F.col("key") != NULL_KEY, F.col("key")).alias("page_id"), "host", "text", "n_tokens", "n_covered")


def op4_host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of all pages."""
    return extract(load(spark, sf_dir, "pages"))


QUERIES = {"op4_host_suffixes": op4_host_suffixes}
SQL: dict[str, str] = {}
