"""Operator 3: packing documents into training windows by Karmarkar-Karp multiway differencing.

Documents become pieces of at most ``capacity`` subword tokens, cut at spaces (inside a word only where one word alone is too long); an end mark, which takes one of the tokens,
stands after each piece. The pieces are spread over groups of about ``group_bytes`` of text by a hash (a group that equal rows make larger is packed in parts of four times that); within a group k windows are filled at once: every piece starts as a partial partition
(n, 0, ..., 0), of which only what isn't 0 is kept, and the two partial partitions with the largest imbalance are merged, largest sum onto smallest, until one is left. Its k sums are
nearly equal. k starts at the least count that could hold the tokens and rises while any window exceeds the capacity.

Result: a row per window: window_id (group-number), n_tokens, n_pieces, doc_ids, piece_nos, piece_tokens (end mark included), piece_chars and text (the pieces in (doc_id,
piece_no) order; piece_chars says where each ends, and a document's pieces join to the document again).

Nulls and empty texts hold no tokens and are in no window. A null doc_id is packed as a document without id. Repeated rows are packed as often as
they occur. Very long texts give several pieces. An empty table gives no windows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.llm.scratch import load
from needlework.llm.subwords import DEFAULT_VOCABULARY, Subwords
from needlework.llm.tokens import slices

CAPACITY = 8192
GROUP_BYTES = 8 << 20
PIECES = "doc_id long, piece_no int, n_tokens int, text string"
WINDOWS = "window_id string, n_tokens long, n_pieces int, doc_ids array<long>, piece_nos array<int>, piece_tokens array<int>, piece_chars array<int>, text string"


def cut(text: str, capacity: int, words: Subwords) -> list[tuple[int, str]]:
    """(tokens and end mark, piece): consecutive pieces of at most capacity tokens that join to the text."""
    return [(n + 1, piece) for n, piece in unmarked(text, capacity - 1, words)]


def unmarked(text: str, capacity: int, words: Subwords) -> list[tuple[int, str]]:
    """The pieces and their tokens, without end marks."""
    parts = words.pieces(text)
    if parts is None:
        n = len(words.encode_whole(text))
        if n <= capacity:
            return [(n, text)]
        first, *rest = text.split(" ")
        parts = [first, *[" " + x for x in rest]]
    out, run, n = [], [], 0
    for p in parts:
        k = words.count(p)
        if k > capacity:
            # one over-long word: a character never takes more tokens than it has bytes
            if run:
                out.append((n, "".join(run)))
                run, n = [], 0
            step = max(1, capacity // 4)
            for i in range(0, len(p), step):
                x = p[i : i + step]
                out.append((len(words.encode_whole(x)), x))
            continue
        if n + k > capacity:
            out.append((n, "".join(run)))
            run, n = [], 0
        run.append(p)
        n += k
    if run:
        out.append((n, "".join(run)))
    return out


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Karmarkar-Karp: sums of k partitions, largest first, and the members of each."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    if k == 1:
        return np.array([sizes.sum()]), [np.arange(n)]
    # a slot is a node; nodes below n are pieces, n stands for "nothing", others join two nodes; a tuple holds its sums above 0, at most k, the largest first
    left, right = [], []
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = [(-int(sizes[i]), at, sizes[i : i + 1].astype(np.int64), np.array([i])) for at, i in enumerate(order)]
    heapq.heapify(heap)
    at = n
    while len(heap) > 1:
        _, _, a, sa = heapq.heappop(heap)
        _, _, b, sb = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            sums, slots = np.concatenate([a, b[::-1]]), np.concatenate([sa, sb[::-1]])
        else:
            # the smallest of one side meet the smallest of the other
            both = slice(len(a) - over, len(a))
            sums, slots = np.concatenate([a, b[::-1][over:]]), np.concatenate([sa, sb[::-1][over:]])
            sums[both] += b[::-1][:over]
            joined = n + 1 + len(left) + np.arange(over)
            left.extend(sa[both].tolist())
            right.extend(sb[::-1][:over].tolist())
            slots[both] = joined
        by = np.argsort(-sums, kind="stable")
        sums, slots = sums[by], slots[by]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), at, sums, slots))
        at += 1
    _, _, sums, slots = heap[0]
    sums, slots = np.concatenate([sums, np.zeros(k - len(sums), np.int64)]), np.concatenate([slots, np.full(k - len(slots), n)])
    members = []
    for node in slots.tolist():
        found, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                found.append(x)
            elif x > n:
                todo += (left[x - n - 1], right[x - n - 1])
        members.append(np.array(sorted(found), np.int64))
    return sums, members


def windows(sizes: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Members of near-equal windows of at most capacity tokens; no piece may exceed the capacity."""
    if not len(sizes):
        return []
    k = max(math.ceil(int(sizes.sum()) / capacity), int((2 * sizes > capacity).sum()), 1)
    while True:
        sums, members = difference(sizes, k)
        over = np.maximum(sums - capacity, 0).sum()
        if over == 0:
            return [m for m in members if len(m)]
        k += max(1, int(over) // capacity)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Windows of docs(doc_id, text)."""
    if capacity < 8 or group_bytes < 1:
        raise ValueError("capacity must be 8 tokens at least and group_bytes positive")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND text != ''")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / group_bytes))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Subwords(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = ([], [], [], [])
                part = batch.slice(at, 512)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for no, (n, piece) in enumerate(cut(text, capacity, words)):
                        for column, x in zip(rows, (doc_id, no, n, piece), strict=True):
                            column.append(x)
                types = (pa.int64(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["doc_id", "piece_no", "n_tokens", "text"])

    def fill(group: int, table: pa.Table, first: int) -> pa.RecordBatch:
        table = table.sort_by([("doc_id", "ascending"), ("piece_no", "ascending"), ("n_tokens", "ascending"), ("text", "ascending")])
        sizes = table.column("n_tokens").to_numpy().astype(np.int64)
        ids, nos, texts = (table.column(c).to_pylist() for c in ("doc_id", "piece_no", "text"))
        out: list[dict] = []
        for no, members in enumerate(windows(sizes, capacity), first):
            out.append(
                {
                    "window_id": f"{group:08d}-{no:05d}",
                    "n_tokens": int(sizes[members].sum()),
                    "n_pieces": len(members),
                    "doc_ids": [ids[i] for i in members],
                    "piece_nos": [nos[i] for i in members],
                    "piece_tokens": sizes[members].tolist(),
                    "piece_chars": [len(texts[i]) for i in members],
                    "text": "".join(texts[i] for i in members),
                }
            )
        whole, many = pa.list_(pa.int32()), pa.list_(pa.int64())
        schema = pa.schema([("window_id", pa.string()), ("n_tokens", pa.int64()), ("n_pieces", pa.int32()), ("doc_ids", many), ("piece_nos", whole), ("piece_tokens", whole), ("piece_chars", whole), ("text", pa.string())])
        return pa.RecordBatch.from_pylist(out, schema)

    def fill_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by group; a group is packed when it ends or has four times its size."""
        held: list[pa.RecordBatch] = []
        now, size, first = None, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, first
            if held:
                done = fill(now, pa.Table.from_batches(held).drop_columns(["_group"]), first)
                held, size, first = [], 0, first + done.num_rows
                yield done

        for batch in batches:
            group = batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if group[a] != now:
                    yield from flush()
                    now, first = int(group[a]), 0
                for part in slices(batch.slice(a, b - a), 3, group_bytes):
                    held.append(part)
                    size += part.column(3).nbytes
                    if size > 4 * group_bytes:
                        yield from flush()
        yield from flush()

    pieces = texts.mapInArrow(cuts, PIECES)
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece_no", F.md5("text")), F.lit(groups)).cast("int"))
    return grouped.repartition("_group").sortWithinPartitions("_group").mapInArrow(fill_all, WINDOWS)


def op3_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 8192 tokens."""
    return pack(load(spark, sf_dir, "documents"))


QUERIES = {"op3_kk_packing": op3_kk_packing}
SQL: dict[str, str] = {}
