"""Operator 5: near-duplicate documents by Order MinHash.

Words are runs of letters and digits, lower-cased. A document's k-mers are its pairs of neighbouring words, labelled with their occurrence number. Each of ``SKETCHES`` random orders picks the two least
labelled k-mers; a sketch is those two in text order, so it answers to edit similarity and not only to the set of words. Documents that share a sketch
are candidates; candidates are near copies iff the edit distance of their words is at most ``1 - similarity`` of the longer one's words, found by banded
alignment. Exact copies (equal texts) are collapsed first. Near copies are linked in two passes that together leave out only pairs already joined: each
member of a bucket against the bucket's least document, then what lies in one bucket but in different components, by classes of length and in blocks of ``BLOCK``, so that no
task holds a whole bucket. In both, word histograms rule out what can't be a near copy before any words move. Groups are the connected components.

With similarity s, two words in a row survive with about s**2; at 0.8 a sketch agrees with about 0.22 and one of 16 with about 0.98.

Nulls are copies of nothing. Empty texts (and any equal texts) are copies of each other. A null doc_id sorts before all others. A row given twice is a
copy of itself: one stays. Rows that share a doc_id
but differ in text are versions of one document: what any of them is a copy of, the document is. Texts of one word are compared by that word, texts without words
by equality only. Very long texts are compared whole. Empty tables give empty results. Columns other
than doc_id and text are carried by ``dedup`` and ignored by ``duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.llm import tokens
from needlework.llm.align import distances
from needlework.llm.components import components
from needlework.llm.scratch import load, written

K = 2
SKETCHES = 16
SIMILARITY = 0.8
NULL_KEY = -(2**63)
BINS = 256
#: documents whose keys are sent to all tasks at most; for more, the texts are shuffled
BROADCAST_KEYS = 500_000
#: members of a bucket that are compared with as many in one task
BLOCK = 1024
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, (2, 64), dtype=np.uint64)


def plain_words(texts: pa.Array) -> tokens.Words:
    """Lower-case words without ASCII punctuation: neither case nor punctuation makes a copy another text."""
    return tokens.words(pc.utf8_lower(texts), tokens.NOT_ALNUM)


def labelled(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each k-mer's hash mixed with its occurrence number within its text."""
    key = hashes ^ tokens.mix(text.astype(np.uint64) + np.uint64(1))
    by = np.argsort(key)
    same = np.zeros(len(by), bool)
    same[1:] = key[by[1:]] == key[by[:-1]]
    occurrence = np.zeros(len(hashes), np.uint64)
    if same.any():
        member = same.copy()
        member[:-1] |= same[1:]
        at = by[member]
        at = at[np.lexsort((at, key[at]))]
        lead = np.ones(len(at), bool)
        lead[1:] = key[at[1:]] != key[at[:-1]]
        start = np.flatnonzero(lead)
        occurrence[at] = (np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate([start, [len(at)]])))).astype(np.uint64)
    return tokens.mix(hashes + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketches(words: tokens.Words, k: int = K, count: int = SKETCHES) -> np.ndarray:
    """A row of ``count`` sketches for each text that has words; texts without words give zeros."""
    n = np.diff(words.first)
    out = np.zeros((len(n), count), np.uint64)
    grams = np.maximum(n - k + 1, np.minimum(n, 1))
    if not grams.sum():
        return out
    full = tokens.runs(words.hashes, k)
    text = np.repeat(np.arange(len(n)), grams)
    begin = np.cumsum(grams) - grams
    at = np.arange(grams.sum()) - begin[text] + words.first[text]
    h = np.where(n[text] >= k, full[np.minimum(at, max(len(full) - 1, 0))] if len(full) else np.uint64(0), words.hashes[at])
    x = labelled(h, text)
    rows = np.flatnonzero(grams)
    lead = begin[rows]
    many = grams[rows]
    top = np.uint64(2**64 - 1)
    for j in range(count):
        v = (x ^ _SEEDS[0, j]) * (_SEEDS[1, j] | np.uint64(1))
        v ^= v >> np.uint64(32)
        low = np.minimum.reduceat(v, lead)
        first = np.flatnonzero(v == np.repeat(low, many))
        v[first] = top
        low = np.minimum.reduceat(v, lead)
        second = np.flatnonzero(v == np.repeat(low, many))
        if len(second) > len(first):
            # one k-mer only: every value is the top one
            second = second[np.searchsorted(second, lead)]
        a, b = h[np.minimum(first, second)], h[np.maximum(first, second)]
        out[rows, j] = tokens.mix(a + tokens.mix(b + np.uint64(j + 1)))
    return out


def histograms(words: tokens.Words) -> np.ndarray:
    """Words of each text by ``BINS`` bins of their hash; counts stop at 255."""
    n = np.diff(words.first)
    at = np.repeat(np.arange(len(n)) * BINS, n) + (words.hashes >> np.uint64(64 - 8)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=len(n) * BINS), 255).astype(np.uint8).reshape(len(n), BINS)


def fixed(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of bytes."""
    width = rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def signatures(docs: DataFrame) -> DataFrame:
    """key, digest, n_words, sketches and bins of docs(doc_id, text) with a text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, 2):
                words = plain_words(batch.column(2))
                s = sketches(words).view(np.int64)
                bins = histograms(words)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, SKETCHES, dtype=np.int32)), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(words.first).astype(np.int32)), lists, fixed(bins)], ["key", "digest", "n_words", "sketches", "bins"])

    texts = docs.where("text IS NOT NULL").select(key_of(), F.unhex(F.md5("text")).alias("digest"), "text")
    return texts.mapInArrow(sign, "key long, digest binary, n_words int, sketches array<long>, bins binary")


def key_of():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key")


def possible(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that their histograms don't rule out: an edit changes two bins by one at most, so the distance is half their difference at least."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in (3, 4))
                limit = np.floor((1 - similarity) * part.column(2).to_numpy() + 1e-9)
                keep = pa.array(np.abs(x - y).sum(axis=1, dtype=np.int64) <= 2 * limit)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])

    left = signed.select(F.col("key").alias("a"), F.col("n_words").alias("_m"), F.col("bins").alias("_x"))
    right = signed.select(F.col("key").alias("b"), F.col("n_words").alias("_n"), F.col("bins").alias("_y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", F.greatest("_m", "_n").alias("_most"), "_x", "_y")
    return joined.mapInArrow(compare, "a long, b long")


def near(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are near copies."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                left = [np.frombuffer(x, np.uint32) for x in part.column(2).to_pylist()]
                right = [np.frombuffer(x, np.uint32) for x in part.column(3).to_pylist()]
                longest = np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)])
                limits = np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)
                found = pa.array(distances(list(zip(left, right, strict=True)), limits) >= 0)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(found), part.column(1).filter(found)], ["a", "b"])

    left = words.select(F.col("key").alias("a"), F.col("words").alias("_x"))
    right = words.select(F.col("key").alias("b"), F.col("words").alias("_y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(verify, "a long, b long")


def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words): 32 bits of each word's hash."""
    for whole in batches:
        for batch in tokens.slices(whole, 1):
            w = plain_words(batch.column(1))
            data = (w.hashes >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((w.first * 4).astype(np.int32)), pa.py_buffer(data)])], ["key", "words"])


def words_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, words) of the documents needed(key, digest), each once. The texts stay where they are while the keys are few enough to be sent to all tasks."""
    if needed.count() <= BROADCAST_KEYS:
        needed = F.broadcast(needed)
    texts = docs.where("text IS NOT NULL").select(key_of(), F.unhex(F.md5("text")).alias("digest"), "text")
    return written(texts.join(needed, ["key", "digest"]).dropDuplicates(["key", "digest"]).select("key", "text").mapInArrow(pack_words, "key long, words binary"), "words")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def alike(a: str, b: str, similarity: float):
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def unjoined(rows: DataFrame, bins: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows(band, key, comp, n_words) in one band and different components that lengths and histograms don't rule out.

    Near copies lie in the same class of length or in neighbouring ones. A cell holds a class (left) and that class and the next one (right); both sides are cut into blocks by a
    hash, and a task compares a block with a block.
    """
    mixed = rows.groupBy("band").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).where("_a != _b").select("band")
    size = F.floor(F.log("n_words") / -math.log(similarity) + 1e-9).cast("int") if similarity < 1 else F.col("n_words")
    placed = rows.join(mixed, "band").withColumn("size", size)
    left = placed.groupBy("band", "size").agg(F.count("*").alias("n"))
    right = left.union(left.select("band", F.col("size") - 1, "n")).groupBy("band", "size").agg(F.sum("n").alias("m"))
    # several documents on the right, one on the left at least
    cells = left.join(right.where("m > 1"), ["band", "size"]).select("band", F.col("size").alias("cell"), F.ceil(F.col("n") / BLOCK).alias("lefts"), F.ceil(F.col("m") / BLOCK).alias("rights"))
    mark = F.xxhash64("key")
    spread = placed.select("band", "key", "comp", "n_words", mark.alias("_h"), F.explode(F.array(F.struct(F.col("size").alias("cell"), F.lit(True).alias("own")), F.struct((F.col("size") - 1).alias("cell"), F.lit(False).alias("own")))).alias("_c")).select("*", "_c.cell", "_c.own")
    ways = F.concat(
        F.when(F.col("own"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1), lambda j: F.struct(F.pmod("_h", "lefts").alias("i"), j.alias("j"), F.lit(0).alias("side")))).otherwise(F.array()),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), F.pmod("_h", "rights").alias("j"), F.lit(1).alias("side"))),
    )
    sent = spread.join(cells, ["band", "cell"]).select("band", "cell", "key", "comp", "n_words", F.explode(ways).alias("_w")).select("band", "cell", "_w.i", "_w.j", "_w.side", "key", "comp", "n_words")
    full = sent.join(bins.select("key", "bins"), "key")
    group = ["band", "cell", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by group and side; a group is two blocks at most."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array([batch.column(c).to_numpy() for c in range(4)])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            if held and any(held[-1].column(c)[0].as_py() != batch.column(c)[0].as_py() for c in range(4)):
                yield from pairs_in(pa.Table.from_batches(held))
                held = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(x, y - x))
                if y < batch.num_rows:
                    yield from pairs_in(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from pairs_in(pa.Table.from_batches(held))

    def pairs_in(table: pa.Table) -> Iterator[pa.RecordBatch]:
        side, key, comp, n = (table.column(c).to_numpy() for c in ("side", "key", "comp", "n_words"))
        cut = int(np.searchsorted(side, 1))
        if not cut or cut == len(side):
            return
        x = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
        found = []
        step = max(1, (1 << 14) // (len(side) - cut))
        for at in range(0, cut, step):
            to = min(cut, at + step)
            most = np.maximum(n[at:to, None], n[None, cut:])
            ok = (np.minimum(n[at:to, None], n[None, cut:]) >= similarity * most - 1e-9) & (comp[at:to, None] != comp[None, cut:])
            i, j = np.nonzero(ok)
            near_ = np.abs(x[at + i] - x[cut + j]).sum(axis=1, dtype=np.int64) <= 2 * np.floor((1 - similarity) * most[i, j] + 1e-9)
            found.append((key[at + i[near_]], key[cut + j[near_]]))
        a, b = (np.concatenate(z) for z in zip(*found, strict=True))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    ordered = full.select(*group, "side", "key", "comp", "n_words", "bins").repartition(*group).sortWithinPartitions(*group, "side")
    return ordered.mapInArrow(compare, "a long, b long").where("a != b").distinct()


def duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document that goes: key, digest, duplicate_of (the least doc_id of its group, as key), kind (exact or near), copies (rows with this key and text)."""
    signed = written(signatures(docs), "signatures")
    bins = signed.select("key", "n_words", "bins")
    each = signed.groupBy("digest", "key").agg(F.count("*").alias("copies"))
    named = written(each.join(each.groupBy("digest").agg(F.min("key").alias("rep")), "digest"), "texts")
    reps = named.where("key = rep").select("digest", "key")
    bands = signed.where("n_words > 0").select("key", "digest", "n_words", "sketches").join(reps, ["key", "digest"]).select("key", "n_words", F.explode("sketches").alias("band"))
    heads = bands.groupBy("band").agg(F.min(F.struct("key", "n_words")).alias("_p"), F.count("*").alias("_n")).where("_n > 1").select("band", F.col("_p.key").alias("pivot"), F.col("_p.n_words").alias("pivot_words"), "_n")
    buckets = written(bands.join(heads, "band").where("key != pivot"), "buckets")
    first = buckets.where(alike("n_words", "pivot_words", similarity)).select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    first = written(possible(first, bins, similarity), "pairs")
    words = words_of(docs, ends_of(first).join(reps, "key"))
    linked = written(near(first, words, similarity), "links")
    joined = components(linked)
    # second pass: what lies in one bucket but not in one component; the bucket's least document was compared with all
    rest = buckets.where("_n > 2").select("band", "key", "n_words").distinct().join(joined, "key", "left").select("band", "key", F.coalesce("root", "key").alias("comp"), "n_words")
    second = written(unjoined(rest, bins, similarity), "pairs")
    more = words_of(docs, ends_of(second).join(words.select("key"), "key", "left_anti").join(reps, "key"))
    links = linked.union(near(second, words.union(more), similarity))
    roots = components(links)
    flagged = named.join(roots.withColumnRenamed("key", "rep"), "rep", "left").withColumn("duplicate_of", F.coalesce("root", "rep"))
    # of the rows with the least key and the group's first text, one stays; of a text that was copied, the first is near and the others exact copies
    flagged = flagged.withColumn("_stays", ((F.col("key") == F.col("rep")) & (F.col("duplicate_of") == F.col("key"))).cast("int"))
    rows = flagged.where("copies > _stays").select("*", F.explode(F.sequence(F.lit(1).cast("long") + F.col("_stays"), F.col("copies"))).alias("_r"))
    kind = F.when((F.col("_r") > 1) | (F.col("key") != F.col("rep")), "exact").otherwise("near")
    return rows.select("key", "digest", "duplicate_of", kind.alias("kind"), "copies")


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group, that with the least doc_id; of a row given twice one stays."""
    gone = written(duplicates(docs, similarity), "duplicates")
    whole = gone.where("copies = 1 OR duplicate_of != key").select("key", "digest").distinct()
    if whole.count() <= BROADCAST_KEYS:
        whole = F.broadcast(whole)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key_of(), F.unhex(F.md5("text")).alias("digest"))
    left = marked.join(whole, ["key", "digest"], "left_anti")
    twins = gone.where("copies > 1 AND duplicate_of = key").select("key", "digest").distinct()
    if not twins.isEmpty():
        # rows given several times: only these are moved
        single = left.join(twins, ["key", "digest"], "left_anti")
        first = left.join(twins, ["key", "digest"], "left_semi").groupBy("key", "digest").agg(F.first("_row").alias("_row"))
        left = single.select("_row").union(first.select("_row"))
    return left.select("_row.*")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has an earlier copy or near copy, with the first of its group."""
    found = duplicates(load(spark, sf_dir, "documents"))
    name = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return found.select(name("key").alias("doc_id"), name("duplicate_of").alias("duplicate_of"), "kind")


QUERIES = {"op5_order_minhash": op5_order_minhash}
SQL: dict[str, str] = {}
