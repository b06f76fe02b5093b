"""Suffix order of each shard, kept as a table: row, position, and the byte before it. From it come intervals, ranks and steps from row to row.

A shard is sorted by one task (prefix doubling in numpy, of what isn't told apart yet), so shards are kept small (a few MB); shards are independent. The end mark is symbol 0 in text mode; in
binary mode bytes are one higher, so that zero bytes differ from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from needlework.functions.bytes import BINARY, TEXT, pattern_bytes

SUFFIXES = "shard_id int, row long, sa long, bwt int"


def symbols(text: bytes, mode: str = TEXT) -> np.ndarray:
    """Symbols of the text and its end mark."""
    x = np.frombuffer(text, np.uint8).astype(np.int64) + (mode == BINARY)
    return np.append(x, 0)


def heads(ordered: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.concatenate([[True], ordered[1:] != ordered[:-1]])


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of x (which ends in a unique least symbol) in order.

    As many symbols as 64 bits hold decide first (8 or more of a text's), then prefixes double; only suffixes that share theirs with others are sorted again, within the rows that they have together.
    """
    n = len(x)
    seen = np.zeros(int(x.max()) + 1, bool)
    seen[x] = True
    dense = (np.cumsum(seen) - 1)[x].astype(np.uint64)
    bits = max(1, int(dense.max()).bit_length())
    step = min(64 // bits, n)
    key = dense.copy()
    for i in range(1, step):
        key <<= np.uint64(bits)
        key[: n - i] |= dense[i:]
    order = np.argsort(key)
    head = heads(key[order])
    at = np.arange(n)
    # the rank of suffixes that are alike so far is the first of their rows
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    while True:
        at = at[~(head & np.append(head[1:], True))]
        if not len(at):
            return order
        # none of these reaches the end within step symbols, since the end mark is unique
        starts = order[at]
        key = rank[starts] * n + rank[starts + step]
        by = np.argsort(key)
        starts, head = starts[by], heads(key[by])
        order[at] = starts
        rank[starts] = np.maximum.accumulate(np.where(head, at, 0))
        step *= 2


def suffixes(segments: DataFrame, mode: str = TEXT) -> DataFrame:
    """The suffix table of every shard."""

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        text = b"".join(bytes(c) for c in pdf.sort_values("shard_offset", kind="stable")["content"])
        x = symbols(text, mode)
        sa = suffix_array(x)
        return pd.DataFrame({"shard_id": np.int32(pdf["shard_id"].iloc[0]), "row": np.arange(len(sa)), "sa": sa, "bwt": x[sa - 1].astype(np.int32)})

    return segments.select("shard_id", "shard_offset", "content").groupBy("shard_id").applyInPandas(sort, SUFFIXES)


def by_shard(segments: DataFrame, columns: Callable[[bytes, np.ndarray, np.ndarray], dict[str, np.ndarray | pa.Array]], schema: str, mode: str = TEXT) -> DataFrame:
    """shard_id and ``columns(text, symbols, suffix array)`` of every shard, all in the task that sorts it: only the content is shuffled, not its suffix table."""

    def run(table: pa.Table) -> pa.Table:
        text = b"".join(table.sort_by("shard_offset").column("content").to_pylist())
        x = symbols(text, mode)
        made = columns(text, x, suffix_array(x))
        n = len(next(iter(made.values())))
        shard = np.full(n, table.column("shard_id")[0].as_py(), np.int32)
        return pa.table({"shard_id": shard} | made)

    return segments.select("shard_id", "shard_offset", "content").groupBy("shard_id").applyInArrow(run, f"shard_id int, {schema}")


def lists(values: np.ndarray, starts: Iterable[int]) -> pa.Array:
    """Values cut into one list from each start. Lists of 32 bits leave the task; their rows, where a value's place is a column too, are made of them in generated code."""
    return pa.ListArray.from_arrays(pa.array([*starts, len(values)], pa.int32()), pa.array(values.astype(np.int32)))


def listed(df: DataFrame, keys: list[str], values: str, place: str, value: str) -> DataFrame:
    """keys, and each element of ``values`` and its place as rows."""
    rows = df.select(*keys, F.posexplode(values).alias(place, value))
    return rows.select(*keys, F.col(place).cast("long").alias(place), F.col(value).cast("long").alias(value))


def positions_by_shard(segments: DataFrame, mode: str = TEXT) -> DataFrame:
    """shard_id, row and sa of the table that ``suffixes`` gives."""
    return listed(by_shard(segments, lambda _, x, sa: {"all": lists(sa, [0])}, "all array<int>", mode), ["shard_id"], "all", "row", "sa")


def bwt_by_shard(segments: DataFrame, mode: str = TEXT) -> DataFrame:
    """shard_id, row and bwt of the same."""
    return listed(by_shard(segments, lambda _, x, sa: {"all": lists(x[sa - 1], [0])}, "all array<int>", mode), ["shard_id"], "all", "row", "bwt")


def by_symbol(bwt: np.ndarray) -> np.ndarray:
    """Rows by their symbol, then as they stand; 16 bits are sorted by digits."""
    return np.argsort(bwt.astype(np.uint16), kind="stable")


def lf_by_shard(segments: DataFrame, mode: str = TEXT) -> DataFrame:
    """The same table as ``lf_steps`` gives."""

    def steps(_: bytes, x: np.ndarray, sa: np.ndarray) -> dict[str, pa.Array]:
        lf = np.empty(len(sa), np.int64)
        lf[by_symbol(x[sa - 1])] = np.arange(len(sa))
        return {"all": lists(lf, [0])}

    return listed(by_shard(segments, steps, "all array<int>", mode), ["shard_id"], "all", "row", "lf")


def ranks_by_shard(segments: DataFrame, mode: str = TEXT) -> DataFrame:
    """(shard_id, symbol, row, n): ranks of every symbol at every row, listed where they grow: symbol occurs n times in the first ``row`` rows' bwt, and as often up to its next row listed (0 before its first)."""

    def grown(_: bytes, x: np.ndarray, sa: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
        counts = np.bincount(x)
        symbol = np.flatnonzero(counts)
        return {"symbol": symbol, "all": lists(by_symbol(x[sa - 1]) + 1, np.cumsum(counts[symbol]) - counts[symbol])}

    # the n-th row of a symbol's list is where it has occurred n times
    rows = listed(by_shard(segments, grown, "symbol long, all array<int>", mode), ["shard_id", "symbol"], "all", "n", "row")
    return rows.select("shard_id", "symbol", "row", (F.col("n") + 1).alias("n"))


def resolved_by_shard(segments: DataFrame, mode: str = TEXT) -> DataFrame:
    """(shard_id, kind, asked, found): the position of every row (sa) and the row of every position (isa)."""

    def both(_: bytes, x: np.ndarray, sa: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
        n = len(sa)
        inverse = np.empty(n, np.int64)
        inverse[sa] = np.arange(n)
        return {"kind": np.array(["sa", "isa"], object), "all": lists(np.concatenate([sa, inverse]), [0, n])}

    return listed(by_shard(segments, both, "kind string, all array<int>", mode), ["shard_id", "kind"], "all", "asked", "found")


def c_tables(table: DataFrame) -> DataFrame:
    """(shard_id, symbol, cnt, c_start) of the suffix table; the end mark counts."""
    counts = table.groupBy("shard_id", F.col("bwt").alias("symbol")).agg(F.count("*").alias("cnt"))
    below = Window.partitionBy("shard_id").orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("c_start", F.coalesce(F.sum("cnt").over(below), F.lit(0)).cast("long"))


def lf_steps(table: DataFrame) -> DataFrame:
    """(shard_id, row, lf): the row of the suffix one place before."""
    nth = F.row_number().over(Window.partitionBy("shard_id", "bwt").orderBy("row"))
    steps = table.select("shard_id", "row", "bwt", nth.alias("nth"))
    return steps.join(c_tables(table).withColumnRenamed("symbol", "bwt"), ["shard_id", "bwt"]).select("shard_id", "row", (F.col("c_start") + F.col("nth") - 1).cast("long").alias("lf"))


def ranks(table: DataFrame, symbol: int, row: int) -> DataFrame:
    """(shard_id, n): occurrences of symbol in the first ``row`` rows' bwt; a row beyond the end counts all."""
    return table.groupBy("shard_id").agg(F.count_if((F.col("bwt") == symbol) & (F.col("row") < row)).alias("n"))


def access(table: DataFrame, row: int) -> DataFrame:
    """(shard_id, bwt) at a row."""
    return table.where(F.col("row") == row).select("shard_id", "bwt")


def resolve(table: DataFrame, rows: Iterable[int]) -> DataFrame:
    """(shard_id, row, sa) of rows."""
    return table.where(F.col("row").isin(list(rows))).select("shard_id", "row", "sa")


def inverse(table: DataFrame, places: Iterable[int]) -> DataFrame:
    """(shard_id, sa, row) of positions."""
    return table.where(F.col("sa").isin(list(places))).select("shard_id", "sa", "row")


def interval(text: bytes, sa: np.ndarray, raw: bytes) -> tuple[int, int]:
    """(sp, ep) of a pattern by binary search; (1, 0) where there is none, all rows for the empty pattern."""
    m = len(raw)

    def bound(after: bool) -> int:
        lo, hi = 0, len(sa)
        while lo < hi:
            mid = (lo + hi) // 2
            head = text[sa[mid] : sa[mid] + m]
            if head < raw or (after and head == raw):
                lo = mid + 1
            else:
                hi = mid
        return lo

    sp, ep = (0, len(sa) - 1) if not m else (bound(False), bound(True) - 1)
    return (sp, ep) if sp <= ep else (1, 0)


def intervals(segments: DataFrame, table: DataFrame, patterns: dict[str, bytes | str], mode: str = TEXT) -> DataFrame:
    """(shard_id, pattern, sp, ep) of each pattern in each shard by binary search over its suffixes; (1, 0) where there is none, all rows for the empty pattern."""
    raws = {name: pattern_bytes(p, mode) for name, p in patterns.items()}

    def search(texts: pd.DataFrame, sorted_: pd.DataFrame) -> pd.DataFrame:
        text = b"".join(bytes(c) for c in texts.sort_values("shard_offset", kind="stable")["content"])
        sa = sorted_.sort_values("row")["sa"].to_numpy()
        shard = int(texts["shard_id"].iloc[0])
        out = [(shard, name, *interval(text, sa, raw)) for name, raw in raws.items()]
        return pd.DataFrame(out, columns=["shard_id", "pattern", "sp", "ep"])

    texts = segments.select("shard_id", "shard_offset", "content").groupBy("shard_id")
    return texts.cogroup(table.groupBy("shard_id")).applyInPandas(search, "shard_id int, pattern string, sp long, ep long")


def intervals_by_shard(segments: DataFrame, patterns: dict[str, bytes | str], mode: str = TEXT) -> DataFrame:
    """The same table as ``intervals``, where no suffix table is kept."""
    raws = {name: pattern_bytes(p, mode) for name, p in patterns.items()}

    def search(text: bytes, _: np.ndarray, sa: np.ndarray) -> dict[str, np.ndarray]:
        sp, ep = np.array([interval(text, sa, raw) for raw in raws.values()], np.int64).reshape(-1, 2).T
        return {"pattern": np.array(list(raws), object), "sp": sp, "ep": ep}

    return by_shard(segments, search, "pattern string, sp long, ep long", mode)


def located_by_shard(segments: DataFrame, pattern: bytes | str, mode: str = TEXT) -> DataFrame:
    """(shard_id, shard_pos) of every hit in each shard's text, read off its suffix order; the empty pattern is everywhere, at the end mark too."""
    raw = pattern_bytes(pattern, mode)

    def search(text: bytes, _: np.ndarray, sa: np.ndarray) -> dict[str, np.ndarray]:
        sp, ep = interval(text, sa, raw)
        return {"shard_pos": np.sort(sa[sp : ep + 1])}

    return by_shard(segments, search, "shard_pos long", mode)


def located(segments: DataFrame, table: DataFrame, pattern: bytes | str, mode: str = TEXT) -> DataFrame:
    """The same from a suffix table that was kept: the rows between the pattern's first and last one, which are all that is read of it."""
    found = intervals(segments, table, {"": pattern}, mode).select("shard_id", "sp", "ep")
    return table.join(found, "shard_id").where(F.col("row").between(F.col("sp"), F.col("ep"))).select("shard_id", F.col("sa").alias("shard_pos"))


def suffix_array_joins(docs: DataFrame) -> DataFrame:
    """(doc_id, row, sa) of each document's suffixes by prefix doubling in DataFrames, for texts beyond one task; each round is checkpointed."""
    hexed = docs.select("doc_id", F.hex("content").alias("h"))
    x = hexed.select("doc_id", F.posexplode(F.expr("transform(sequence(0, length(h) div 2), i -> cast(conv(substring(h, 2 * i + 1, 2), 16, 10) as long) + 1)")).alias("i", "s"))
    x = x.select("doc_id", F.col("i").cast("long").alias("i"), F.coalesce("s", F.lit(0)).alias("r"))
    step = 1
    while True:
        ahead = x.select("doc_id", (F.col("i") - step).alias("i"), F.col("r").alias("r2"))
        w = Window.partitionBy("doc_id").orderBy("r", "r2")
        x = x.join(ahead, ["doc_id", "i"], "left").withColumn("r2", F.coalesce("r2", F.lit(-1))).select("doc_id", "i", F.dense_rank().over(w).cast("long").alias("r")).checkpoint()
        left = x.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("r").alias("k")).where("k < n")
        if left.isEmpty():
            return x.select("doc_id", (F.col("r") - 1).alias("row"), F.col("i").alias("sa"))
        step *= 2
