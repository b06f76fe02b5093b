"""Operator 9: benchmark decontamination through the CGK random-walk embedding.

Words are runs of letters and digits, lower-cased. A document is contaminated by an item of L words iff some window of min(L, its words) words lies within
``floor(edits * L)`` word edits of the item.

Windows of an item's size are taken wherever the document shares a gram of ``floor(L / (e + 1))`` words with the item, at the start that this alignment
gives and at those up to e words before and after it: e edits leave one of e + 1 equal parts of the item whole and move it by e words at most, so every window within e
edits is taken. Windows and items are embedded by ``WALKS`` random walks
(each step emits the current word and a random bit of that word and step says whether to move on); a window goes on to verification iff it falls into the item's
bucket in one of ``WALKS * TABLES`` tables, each keyed by ``SAMPLED`` sampled places of a walk. Verification is the exact edit distance.

Nulls, empty texts and texts without words are never contaminated; items without words or with null text match nothing. A null doc_id or item_id is carried. Repeated
rows give repeated findings under the same ids, reported once. Very long texts are searched whole. Empty tables give no findings. Columns other than
doc_id and text are carried by ``decontaminate`` and ignored by ``findings``. Items are broadcast in slices of at most ``ITEM_WORDS`` words: a larger
benchmark takes more passes.
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
from needlework.llm.scratch import load, written

EDITS = 0.2
WALKS = 8
TABLES = 4
SAMPLED = 3
#: steps of all walks that are held at once
CELLS = 1 << 22
ITEM_WORDS = 2_000_000
#: contaminated ids that are sent to all tasks at most; more are joined by a shuffle
BROADCAST_IDS = 500_000
_RNG = np.random.Generator(np.random.PCG64(4242))
_STEP = _RNG.integers(1, 2**63, (WALKS, 1 << 14), dtype=np.uint64) | np.uint64(1)
_PLACES = _RNG.random((WALKS, TABLES, SAMPLED))
_BITS = 22


def embed(words: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The sampled symbols (walk, table, sample, window) of windows words[start:start + size], walked for 3 * length steps, as many windows at a time as ``CELLS`` allows."""
    out = np.empty((WALKS, TABLES, SAMPLED, len(start)), np.uint32)
    by = np.argsort(length, kind="stable")
    at = len(by)
    while at:
        most = max(1, CELLS // (3 * WALKS * max(1, int(length[by[at - 1]]))))
        part = by[max(0, at - most) : at]
        out[..., part] = walked(words, start[part], size[part], length[part])
        at -= len(part)
    return out


def walked(words: np.ndarray, start: np.ndarray, size: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The same of windows that fit into memory together."""
    steps = int(3 * length.max(initial=0))
    place = np.zeros((WALKS, len(start)), np.int64)
    trail = np.zeros((steps, WALKS, len(start)), np.uint32)
    padded = np.concatenate([words, np.zeros(1, np.uint64)])
    for j in range(steps):
        ended = place >= size
        now = np.where(ended, np.uint64(0), padded[np.where(ended, 0, start + place)])
        trail[j] = (now >> np.uint64(32)).astype(np.uint32)
        place += ((now * _STEP[:, j % _STEP.shape[1], None]) >> np.uint64(63)).astype(np.int64)
    at = np.floor(_PLACES[:, :, :, None] * 3 * length).astype(np.int64)
    walk = np.arange(WALKS)[:, None, None, None]
    return trail[at, walk, np.arange(len(start))]


class Items:
    """Benchmark items ready for look-up."""

    def __init__(self, ids: list, texts: list[str], edits: float):
        words = tokens.words(pc.utf8_lower(pa.array(texts, pa.string())), tokens.NOT_ALNUM)
        self.ids, self.words, self.first = ids, words.hashes, words.first
        self.length = np.diff(words.first)
        self.most = np.floor(edits * self.length + 1e-9).astype(np.int64)
        gram = np.maximum(self.length // (self.most + 1), 1)
        self.sizes = sorted({int(g) for g, n in zip(gram, self.length, strict=True) if n})
        self.tables = {}
        for g in self.sizes:
            keys, item, offset = [], [], []
            for i in np.flatnonzero((gram == g) & (self.length > 0)):
                h = tokens.runs(self.words[self.first[i] : self.first[i + 1]], g)
                keys.append(h)
                item.append(np.full(len(h), i))
                offset.append(np.arange(len(h)))
            key = np.concatenate(keys)
            by = np.argsort(key, kind="stable")
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[key >> np.uint64(64 - _BITS)] = True
            self.tables[g] = (key[by], np.concatenate(item)[by], np.concatenate(offset)[by], bitmap)
        real = np.flatnonzero(self.length > 0)
        self.symbols = np.zeros((WALKS, TABLES, SAMPLED, len(ids)), np.uint32)
        for i in range(0, len(real), 1024):
            part = real[i : i + 1024]
            self.symbols[..., part] = embed(self.words, self.first[part], self.length[part], self.length[part])

    def candidates(self, words: tokens.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, start, size) of the windows to look at, each once."""
        found = []
        total = len(words.hashes) + 1
        for g, (key, item, offset, bitmap) in self.tables.items():
            h = tokens.runs(words.hashes, g)
            at = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(key, h[at], "left"), np.searchsorted(key, h[at], "right")
            n = hi - lo
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            place = np.repeat(at, n)
            row = np.searchsorted(words.first, place, "right") - 1
            inside = place + g <= words.first[row + 1]
            entry, place, row = entry[inside], place[inside], row[inside]
            i = item[entry]
            size = np.minimum(self.length[i], words.first[row + 1] - words.first[row])
            start = np.clip(place - offset[entry], words.first[row], words.first[row + 1] - size)
            # insertions and deletions before the gram move the window's start by as many words at most
            i, start = np.divmod(np.unique(i * total + start), total)
            row = np.searchsorted(words.first, start, "right") - 1
            size = np.minimum(self.length[i], words.first[row + 1] - words.first[row])
            many = 2 * self.most[i] + 1
            shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many + self.most[i], many)
            start = np.clip(np.repeat(start, many) + shift, np.repeat(words.first[row], many), np.repeat(words.first[row + 1] - size, many))
            found.append(np.unique(np.repeat(i, many) * total + start))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        item, start = np.divmod(np.unique(np.concatenate(found)), total)
        row = np.searchsorted(words.first, start, "right") - 1
        return item, start, np.minimum(self.length[item], words.first[row + 1] - start)

    def search(self, words: tokens.Words) -> Iterator[tuple[int, int, int, int]]:
        """(text row, item, start word, edits), the best window of each pair."""
        item, start, size = self.candidates(words)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for a in range(0, len(item), 2048):
            i, s, n = item[a : a + 2048], start[a : a + 2048], size[a : a + 2048]
            same = embed(words.hashes, s, n, self.length[i]) == self.symbols[..., i]
            hit = np.flatnonzero(same.all(axis=2).any(axis=(0, 1)))
            if not len(hit):
                continue
            i, s, n = i[hit], s[hit], n[hit]
            pairs = [(words.hashes[x : x + k], self.words[self.first[j] : self.first[j + 1]]) for x, k, j in zip(s.tolist(), n.tolist(), i.tolist(), strict=True)]
            for j, x, d in zip(i.tolist(), s.tolist(), distances(pairs, self.most[i]).tolist(), strict=True):
                if d >= 0:
                    row = int(np.searchsorted(words.first, x, "right")) - 1
                    new = (d, x - int(words.first[row]))
                    if (row, j) not in best or new < best[row, j]:
                        best[row, j] = new
        for (row, j), (d, x) in best.items():
            yield row, j, x, d


def findings(docs: DataFrame, items: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, start_word, n_edits: the closest window of each contaminated document and item."""
    if not 0 <= edits < 1:
        raise ValueError("edits is a share of the item's words")
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(total / 4 / ITEM_WORDS))
    schema = "doc_id long, item_id long, start_word long, n_edits long"
    out = None
    for part in range(slices):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == part).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["text"] for r in rows], edits))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for whole in batches:
                for batch in tokens.slices(whole, 1):
                    words = tokens.words(pc.utf8_lower(batch.column(1)), tokens.NOT_ALNUM)
                    got = list(bench.search(words))
                    rows, found, start, n = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [], [])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([bench.ids[j] for j in found], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())],
                        ["doc_id", "item_id", "start_word", "n_edits"],
                    )

        texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        found = texts.mapInArrow(find, schema)
        if slices > 1:
            # a slice at a time: its items are let go before the next ones are read
            found = written(found, "found")
            shared.destroy()
        out = found if out is None else out.union(found)
    best = F.min(F.struct("n_edits", "start_word"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start_word", "b.n_edits")


def decontaminate(docs: DataFrame, items: DataFrame, edits: float = EDITS) -> DataFrame:
    """docs without those that are contaminated by any item (by doc_id: rows that share a contaminated doc_id all go)."""
    bad = written(findings(docs, items, edits).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    if bad.count() <= BROADCAST_IDS:
        # the texts stay where they are
        bad = F.broadcast(bad)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return marked.join(bad, F.col("_id").eqNullSafe(F.col("_bad")), "left_anti").select("_row.*")


def op9_cgk_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, 20 % edits."""
    return findings(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES = {"op9_cgk_decontam": op9_cgk_decontam}
SQL: dict[str, str] = {}
