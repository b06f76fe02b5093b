"""The index queries over shards of documents against brute force."""

from __future__ import annotations

import pytest

import __spark_entry__
from needlework.plans import document_index, queries

TEXTS = ["banana bandana", "", "the other thing on the table", "x" * 90, "the other thing on the table", "é ü zz", "on the one hand " * 9, None, "e"]
CHUNK = 48


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Table folder, and the shards' texts by id: some hold several documents, some a part of one."""
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    texts: dict = {}
    several = set()
    for r in queries.parts(spark, folder, CHUNK).orderBy("ord").collect():
        if r["shard_id"] in texts:
            several.add(r["shard_id"])
        texts[r["shard_id"]] = texts.get(r["shard_id"], b"") + bytes(r["content"])
    assert several and len(texts) > 6
    return folder, texts


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(document_index, "parts", lambda spark, sf_dir: queries.parts(spark, sf_dir, CHUNK))


def order(text):
    return sorted(range(len(text) + 1), key=lambda i: text[i:])


def before(text, i):
    return text[i - 1] if i else 0


def rows(name, spark, folder):
    found = [tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_suffixes_of_documents(spark, made, small_shards):
    folder, texts = made
    assert rows("suffix_array_documents", spark, folder) == {(s, row, i) for s, t in texts.items() for row, i in enumerate(order(t))}
    assert rows("bwt_documents", spark, folder) == {(s, row, before(t, i)) for s, t in texts.items() for row, i in enumerate(order(t))}
    want = set()
    for s, t in texts.items():
        sa = order(t)
        want |= {(s, row, sa.index(i - 1 if i else len(t))) for row, i in enumerate(sa)}
    assert rows("lf_documents", spark, folder) == want


def test_intervals_of_documents(spark, made, small_shards):
    folder, texts = made
    want = set()
    for s, t in texts.items():
        for name, p in document_index.PATTERNS.items():
            hits = [row for row, i in enumerate(order(t)) if t[i:].startswith(p)]
            want.add((s, name, hits[0], hits[-1]) if hits else (s, name, 1, 0))
    assert rows("interval_documents", spark, folder) == want


def test_ranks_and_places_of_documents(spark, made, small_shards):
    """Every symbol at every row, and every row and position."""
    folder, texts = made
    grown: dict = {}
    for s, symbol, row, n in rows("rank_documents", spark, folder):
        grown.setdefault((s, symbol), []).append((row, n))
    want = set()
    for s, t in texts.items():
        sa = order(t)
        bwt = [before(t, i) for i in sa]
        for symbol in range(256):
            for row in range(len(bwt) + 1):
                assert max((n for at, n in grown.get((s, symbol), []) if at <= row), default=0) == bwt[:row].count(symbol)
        want |= {(s, "sa", row, i) for row, i in enumerate(sa)} | {(s, "isa", i, row) for row, i in enumerate(sa)}
    assert rows("resolve_documents", spark, folder) == want


def test_whole_table(spark, sf):
    """Every shard of 64 kB of the table, each suffix in order after the one before."""
    texts: dict = {}
    for r in queries.parts(spark, sf).orderBy("ord").collect():
        texts[r["shard_id"]] = texts.get(r["shard_id"], b"") + bytes(r["content"])
    found: dict = {s: [] for s in texts}
    for r in __spark_entry__.queries()["suffix_array_documents"](spark, sf).orderBy("shard_id", "row").collect():
        found[r["shard_id"]].append(r["sa"])
    assert max(map(len, texts.values())) > 60_000
    for s, sa in found.items():
        t = texts[s]
        assert sorted(sa) == list(range(len(t) + 1))
        assert all(t[a : a + 64] < t[b : b + 64] or t[a:] < t[b:] for a, b in zip(sa, sa[1:]))
