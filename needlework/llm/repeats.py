"""Repeated word runs over a whole corpus, the machinery of operator 6; operator 4 uses its parts within a host.

1. Each text's words are hashed; a window of W words is represented by its leftmost least k-word gram, so equal windows have equal anchors at equal
   offsets. Anchors (a fraction 2 / (W - k + 2) of the words) are counted over the corpus; only those that recur go on. No window that recurs is lost.
2. A recurring anchor's windows are cut out as one strip of words and go to the block of that anchor, so all equal windows meet in one block.
3. A block sorts the suffixes that start windows (difference cover, one bucket at a time) and reads runs of neighbours that share W words off the order.

Windows of one word over and over have no anchor and never count as passages. Words are compared by 31 bits of their hash, W of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.llm import tokens
from needlework.llm.cover_suffixes import suffix_order

MAX = np.uint64(2**64 - 1)
BLOCK_TOKENS = 1_500_000


def gram_length(window: int) -> int:
    """Words of a gram: two at least, so that a window of different words has a gram of different words."""
    return max(2, window * 2 // 5)


def anchors(words: tokens.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchors): the start of each whole window that has an anchor, and the place of that anchor; and the grams' hashes by place."""
    k = gram_length(window)
    h = words.hashes
    grams = tokens.runs(h, k)
    if not len(grams):
        none = np.zeros(0, np.int64)
        return none, none, grams
    count = np.diff(words.first)
    text = np.repeat(np.arange(len(count)), count)
    # grams of one word over and over come last
    same = np.zeros(len(h), np.int64)
    same[1:] = np.cumsum(h[1:] != h[:-1])
    flat = same[k - 1 :] == same[: len(grams)]
    grams = np.where(flat, MAX, np.minimum(grams, MAX - np.uint64(1)))
    best = tokens.leftmost_min(grams, window - k + 1)
    starts = np.arange(len(best))
    if not len(starts):
        return starts, best, grams
    fits = starts + window <= words.first[text[starts] + 1]
    fits &= grams[best] != MAX
    return starts[fits], best[fits], grams


def strips(words: tokens.Words, window: int, starts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(place of the anchor, row, first word in the row, words) of each stretch of chosen windows that start side by side and share an anchor."""
    cut = np.ones(len(best), bool)
    cut[1:] = (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)
    lo = np.flatnonzero(cut)
    hi = np.concatenate([lo[1:], [len(best)]]) if len(lo) else lo
    begin, many = starts[lo], hi - lo
    row = np.searchsorted(words.first, begin, "right") - 1
    small = ((words.hashes >> np.uint64(33)) | np.uint64(1 << 31)).astype(np.uint32)
    length = many + window - 1
    ends = np.concatenate([[0], np.cumsum(length)])
    take = np.arange(ends[-1]) - np.repeat(ends[:-1], length) + np.repeat(begin, length)
    data = small[take]
    binary = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(data)])
    return best[lo], row, begin - words.first[row], binary


def repeats(texts: DataFrame, window: int) -> DataFrame:
    """Covered words (key, tid, start, stop) of texts(key long, tid long, text): a window is covered iff the same window starts at a lesser (key, tid, place)."""
    columns = ["key", "tid", "text"]
    texts = texts.select(*columns)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, 2):
                words = tokens.words(batch.column(2))
                _, best, grams = anchors(words, window)
                at = best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best
                row = np.searchsorted(words.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), batch.column(0).take(pa.array(row)).cast(pa.int64()), pa.array((at - words.first[row]).astype(np.int32))],
                    ["anchor", "key", "place"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tokens.slices(whole, 2):
                yield cut_strips(batch)

    def cut_strips(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = tokens.words(batch.column(2))
        places = batch.column(batch.num_columns - 1)
        starts, best, grams = anchors(words, window)
        n = np.diff(np.asarray(places.offsets))
        wanted = places.flatten().to_numpy() + np.repeat(words.first[:-1], n)
        limit = np.repeat(words.first[1:], n)
        keep = np.zeros(len(words.hashes) + 1, bool)
        keep[wanted[wanted < limit]] = True
        chosen = keep[best]
        starts, best = starts[chosen], best[chosen]
        at, row, begin, binary = strips(words, window, starts, best)
        pick = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(grams[at].view(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(begin.astype(np.int32)), binary],
            ["anchor", "key", "tid", "start", "words"],
        )

    def sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by anchor; a block is made of whole anchors. Of equal strips of one anchor the first is kept: memory follows the different ones."""
        held: list[pa.RecordBatch] = []
        size, limit = 0, BLOCK_TOKENS
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(4).nbytes // 4
            if size > limit:
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table.column(0).to_numpy()
                last = int(np.searchsorted(anchor, anchor[-1]))
                if last:
                    yield from sort_block(table.slice(0, last))
                copies, table = collapse(table.slice(last).combine_chunks())
                yield copies
                held = table.combine_chunks().to_batches()
                size = sum(b.column(4).nbytes // 4 for b in held)
                limit = max(BLOCK_TOKENS, 2 * size)
        if held:
            yield from sort_block(pa.Table.from_batches(held))

    def sort_block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield covered(table, window, first_stays=True)

    found = texts.mapInArrow(find, "anchor long, key long, place int")
    again = found.withColumn("_n", F.count("*").over(Window.partitionBy("anchor"))).where("_n > 1")
    places = again.groupBy("key").agg(F.collect_list("place").alias("places"))
    stretches = texts.join(places, "key").select(*columns, "places").mapInArrow(cut, "anchor long, key long, tid long, start int, words binary")
    blocks = stretches.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort_blocks, "key long, tid long, start int, stop int")
    # overlapping and touching stretches of a text become one
    order = Window.partitionBy("key", "tid").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = blocks.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(order))
    return fresh.groupBy("key", "tid", "_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def by_text(table: pa.Table) -> tuple[np.ndarray, ...]:
    """key, tid, start, words and their offsets of a table of strips; its rows with equal strips side by side, the first by (key, tid, start) ahead; whether a row
    is such a copy of the one before. Of the same row given twice one is left."""
    table = table.combine_chunks()
    key, tid, start = (table.column(c).to_numpy() for c in ("key", "tid", "start"))
    column = table.column("words")
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint32)
    offsets = (offsets - offsets[0]) // 4
    h = strip_hashes(data, offsets)
    by = np.lexsort((start, tid, key, h))
    same_text = np.zeros(len(by), bool)
    same_text[1:] = h[by][1:] == h[by][:-1]
    twin = same_text.copy()
    for x in (key, tid, start):
        twin[1:] &= x[by][1:] == x[by][:-1]
    return key, tid, start, data, offsets, by[~twin], same_text[~twin]


def collapse(table: pa.Table) -> tuple[pa.RecordBatch, pa.Table]:
    """(covered stretches, rows left) of the strips of one anchor: every strip but the first of equal ones is covered whole."""
    key, tid, start, _, offsets, by, same = by_text(table)
    at = by[same]
    stop = start[at].astype(np.int64) + np.diff(offsets)[at]
    gone = pa.RecordBatch.from_arrays([pa.array(key[at], pa.int64()), pa.array(tid[at], pa.int64()), pa.array(start[at].astype(np.int32)), pa.array(stop.astype(np.int32))], ["key", "tid", "start", "stop"])
    return gone, table.take(pa.array(np.sort(by[~same])))


def covered(table: pa.Table, window: int, first_stays: bool) -> pa.RecordBatch:
    """Stretches (key, tid, start, stop) of the strips of one block that are covered by repeated windows.

    first_stays: a window is covered iff the same window starts at a lesser (key, tid, place); otherwise iff it occurs under two keys.
    """
    # equal strips are sorted once
    key, tid, start, data, offsets, by, same_text = by_text(table)
    length = np.diff(offsets)
    lead = np.flatnonzero(~same_text)
    rep = by[lead]
    group = np.cumsum(~same_text) - 1
    low, high = key[rep], np.maximum.reduceat(key[by], lead)
    # text of the block: each strip and a terminator of its own
    many = length[rep] - window + 1
    ends = np.cumsum(length[rep] + 1)
    begin = ends - length[rep] - 1
    text = np.empty(int(ends[-1]), np.uint32)
    take = np.arange(length[rep].sum()) - np.repeat(np.cumsum(length[rep]) - length[rep], length[rep])
    strip = np.repeat(np.arange(len(rep)), length[rep])
    text[begin[strip] + take] = data[offsets[rep][strip] + take]
    text[ends - 1] = np.arange(len(rep))
    owner = np.repeat(np.arange(len(rep)), many)
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    wanted = begin[owner] + inner
    order = suffix_order(text, wanted)
    # neighbours that share a whole window
    h_window = tokens.runs(text.astype(np.uint64), window)
    x = h_window[order]
    linked = x[1:] == x[:-1]
    run = np.cumsum(np.concatenate([[True], ~linked])) - 1
    place = np.empty(len(text), np.int64)
    place[wanted] = np.arange(len(wanted))
    item = place[order]
    o = owner[item]
    s = start[rep][o] + inner[item]
    flagged = np.zeros(len(wanted), bool)
    if first_stays:
        ranked = np.lexsort((s, tid[rep][o], key[rep][o], run))
        r = run[ranked]
        leads = np.concatenate([[True], r[1:] != r[:-1]])
        lead_at = np.flatnonzero(leads)[r]
        k, t, p = key[rep][o][ranked], tid[rep][o][ranked], s[ranked]
        other = ~leads & ~((k == k[lead_at]) & (t == t[lead_at]) & (p == p[lead_at]))
        flagged[item[ranked[other]]] = True
    else:
        heads = np.flatnonzero(np.concatenate([[True], ~linked]))
        several = np.minimum.reduceat(low[o], heads) != np.maximum.reduceat(high[o], heads)
        flagged[item[several[run]]] = True
    out = [pack_stretches(flagged, owner, inner, key[rep], tid[rep], start[rep], window)]
    # the other copies of a strip
    copies = by[same_text]
    if first_stays:
        stretch = (key[copies], tid[copies], start[copies], start[copies] + length[copies])
        out.append(stretch)
    else:
        # a copied strip is flagged as its representative is, window by window
        g = group[same_text]
        reps = np.bincount(g, minlength=len(rep))
        if reps.any():
            base = np.cumsum(many) - many
            n = many[g]
            src = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            idx = np.repeat(base[g], n) + src
            own = np.repeat(np.arange(len(g)), n)
            out.append(pack_stretches(flagged[idx], own, src, key[copies], tid[copies], start[copies], window))
    parts = [np.concatenate([p[i] for p in out]) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(parts[0].astype(np.int64)), pa.array(parts[1].astype(np.int64)), pa.array(parts[2].astype(np.int32)), pa.array(parts[3].astype(np.int32))], ["key", "tid", "start", "stop"])


def pack_stretches(flagged: np.ndarray, owner: np.ndarray, inner: np.ndarray, key: np.ndarray, tid: np.ndarray, start: np.ndarray, window: int) -> tuple:
    """Consecutive flagged windows of a strip as one stretch of words."""
    at = np.flatnonzero(flagged)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    lo = np.flatnonzero(cut)
    hi = np.concatenate([lo[1:], [len(at)]]) - 1
    o = owner[at[lo]]
    begin = start[o].astype(np.int64) + inner[at[lo]]
    return key[o], tid[o], begin, start[o].astype(np.int64) + inner[at[hi]] + window


def strip_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each strip."""
    out = np.empty(len(offsets) - 1, np.uint64)
    wide = data.astype(np.uint64)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + tokens._BLOCK, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        up, down = tokens.powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(wide[lo:hi] * up[: hi - lo], out=sums[1:])
        i = offsets[at:to] - lo
        out[at:to] = (sums[offsets[at + 1 : to + 1] - lo] - sums[i]) * down[i]
        at = to
    return tokens.mix(out) ^ np.diff(offsets).astype(np.uint64)
