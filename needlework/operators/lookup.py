"""Many long patterns at once: an inverted index from the patterns' first bytes finds the places to compare."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUILD_BYTES = 32 << 20


def find_all(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, item_id, pos) of every occurrence of patterns(item_id, pattern) within docs(doc_id, content), overlaps included; empty patterns are nowhere.

    Patterns are an automaton that every task holds, in slices of at most BUILD_BYTES of patterns: more patterns take more passes.
    """
    spark = docs.sparkSession
    patterns = patterns.where("pattern IS NOT NULL AND octet_length(pattern) > 0")
    size = patterns.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    slices = max(1, -(-size // BUILD_BYTES))
    out = None
    for part in range(slices):
        rows = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == part).orderBy("item_id").collect()
        by: dict[str, list[int]] = {}
        for r in rows:
            by.setdefault(bytes(r["pattern"]).decode("latin-1"), []).append(r["item_id"])
        shared = spark.sparkContext.broadcast(by)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for word, ids in shared.value.items():
                machine.add_word(word, (len(word), ids))
            if shared.value:
                machine.make_automaton()
            for batch in batches:
                found: tuple[list, list, list] = ([], [], [])
                if shared.value:
                    for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        for end, (n, ids) in machine.iter((content or b"").decode("latin-1")):
                            for i in ids:
                                for column, x in zip(found, (doc_id, i, end - n + 1), strict=True):
                                    column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["doc_id", "item_id", "pos"])

        hits = docs.select("doc_id", "content").mapInArrow(find, "doc_id long, item_id long, pos long")
        out = hits if out is None else out.union(hits)
    return out
