"""Search in memory: known cases, then random bytes against a plain scan."""

from __future__ import annotations

import random

import pytest

from needlework.functions.bytes import BINARY, InvalidInput
from needlework.operators import access, search, shard, suffix
from needlework.sources import corpus


def naive(text: bytes, p: bytes) -> list[int]:
    return [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p]


def index(spark, documents, chunk=None, mode=BINARY):
    return shard.segments(corpus.from_memory(spark, documents, mode), chunk)


def spots(df, column="shard_pos"):
    return sorted(r[column] for r in df.collect())


def test_known_words(spark):
    word = index(spark, [b"mississippi"])
    for p, want in ((b"issi", [1, 4]), (b"i", [1, 4, 7, 10]), (b"ss", [2, 5]), (b"z", []), (b"mississippi", [0]), (b"mississippis", [])):
        assert spots(search.locate(word, p)) == want
    five = index(spark, [b"aaaaa"])
    assert spots(search.locate(five, b"aaaa")) == [0, 1]
    assert spots(search.locate(five, b"a")) == [0, 1, 2, 3, 4]
    assert spots(search.locate(index(spark, [b"banana"]), b"ana")) == [1, 3]


def test_across_documents(spark):
    two = index(spark, [b"abc", b"def"])
    got = search.locate(two, b"cde").collect()
    assert [(r["shard_pos"], r["doc_id"], r["doc_offset"]) for r in got] == [(2, 0, 2)]
    assert search.locate_safe(two, b"cde").count() == 0
    three = index(spark, [b"ab", b"", b"c", b"de"])
    assert spots(search.locate(three, b"bcd")) == [1]
    assert spots(search.locate(three, b"abcde")) == [0]


def test_empty_pattern(spark):
    two = index(spark, [b"abc", b"de"])
    assert spots(search.locate(two, b"")) == [0, 1, 2, 3, 4, 5]
    assert search.locate_safe(two, b"").count() == 0
    assert search.locate_merged(two, b"", doc_safe=True).count() == 0
    assert search.locate_doc_safe(corpus.from_memory(spark, [b"x"]), b"").count() == 0


def test_seams(spark):
    parts = index(spark, [b"abcdefghij"], 8)
    assert [(r["len"], r["shard_id"]) for r in parts.orderBy("ord").collect()] == [(7, 0), (3, 1)]
    assert search.locate(parts, b"fgh").count() == 0
    assert [tuple(r) for r in search.locate_merged(parts, b"fgh").collect()] == [(0, 5)]
    assert [tuple(r) for r in search.locate_merged(parts, b"fgh", doc_safe=True).collect()] == [(0, 5)]
    # over three parts
    assert spots(search.locate_merged(index(spark, [b"abcdefghij"], 3), b"bcdefg"), "pos") == [1]


def test_shard_rule(spark):
    made = shard.plan(corpus.from_memory(spark, [b"x" * 400]), 150).orderBy("ord").collect()
    assert [(r["shard_id"], r["part_index"], r["is_first"], r["is_last"], r["doc_offset"], r["len"]) for r in made] == [(0, 0, True, False, 0, 149), (1, 1, False, False, 149, 149), (2, 2, False, True, 298, 102)]
    three = shard.plan(corpus.from_memory(spark, [b"a" * 100, b"b" * 100, b"c" * 100]), 150)
    assert three.select("shard_id").distinct().count() == 3
    with pytest.raises(InvalidInput):
        shard.plan(corpus.from_memory(spark, [b"a"]), 1)


def replay(lengths, chunk):
    """The rule byte by byte."""
    cap, out, shard_no, used = chunk - 1, [], 0, 0
    for i, n in enumerate(lengths):
        if n == 0:
            continue
        part = at = 0
        while at < n:
            if used == cap or (part == 0 and n - at > cap - used and used):
                shard_no, used = shard_no + 1, 0
            take = min(cap - used, n - at)
            out.append((shard_no, i, part, at, take, used))
            used += take
            at += take
            part += 1
    return out


def test_shard_rule_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(shard, "RANGE_ROWS", 7)
    rng = random.Random(5)
    asked = []
    entered = shard.entered
    monkeypatch.setattr(shard, "entered", lambda *args: asked.append(args) or entered(*args))
    for chunk, table in ((2, 1024), (3, 1024), (9, 1024), (40, 1024), (130, 1024), (10**6, 1024), (40, 1), (130, 0)):
        monkeypatch.setattr(shard, "TABLE", table)
        del asked[:]
        lengths = [rng.choice([0, 1, 2, 5, 8, 13, 50]) for _ in range(60)]
        docs = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, len long")
        got = [(r["shard_id"], r["doc_id"], r["part_index"], r["doc_offset"], r["len"], r["shard_offset"]) for r in shard.plan(docs, chunk).orderBy("ord").collect()]
        assert got == replay(lengths, chunk)
        # where tables are small enough, no range is asked again
        assert bool(asked) == (table < 2)
    monkeypatch.setattr(shard, "TABLE", 1024)
    one = shard.plan(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, len long"), None).orderBy("ord").collect()
    assert [(r["shard_id"], r["doc_id"], r["shard_offset"]) for r in one] == [(0, i, sum(lengths[:i])) for i, n in enumerate(lengths) if n]
    for ids in ([1, 2, 2], [1, None, 2]):
        with pytest.raises(InvalidInput):
            shard.plan(spark.createDataFrame([(i, 3) for i in ids], "doc_id long, len long"), 9)


def test_repeated_and_missing_ids(spark):
    """Places are those within each row."""
    rows = [(1, b"abc ab"), (1, b"xxab"), (None, b"abc ab"), (None, b"xxab"), (2, None)]
    docs = spark.createDataFrame([(i, None if t is None else bytearray(t)) for i, t in rows], "doc_id long, content binary")
    got = sorted((str(r["doc_id"]), r["pos"]) for r in search.locate_doc_safe(docs, b"ab").collect())
    assert got == sorted((i, p) for i in ("1", "None") for p in (0, 4, 2))


@pytest.mark.parametrize("seed", range(3))
def test_random_bytes(spark, seed):
    rng = random.Random(seed)
    alphabet = bytes([0, 10, 92, 69, 0xE9, 0xFF])
    documents = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(12)]
    docs = corpus.from_memory(spark, documents, BINARY)
    whole, parts = shard.segments(docs, None).cache(), shard.segments(docs, 7).cache()
    text = b"".join(documents)
    for m in (1, 2, 3, 5):
        p = bytes(rng.choice(alphabet) for _ in range(m)) if m < 5 else text[8 : 8 + m]
        assert spots(search.locate(whole, p, BINARY)) == naive(text, p)
        safe = sorted((i, x) for i, d in enumerate(documents) for x in naive(d, p))
        assert sorted(tuple(r) for r in search.locate_doc_safe(docs, p, BINARY).collect()) == safe
        assert sorted(tuple(r) for r in search.locate_merged(parts, p, BINARY, doc_safe=True).collect()) == safe
        counts = {r["doc_id"]: r["n"] for r in search.count_per_document(docs, p, BINARY).collect()}
        assert counts == {i: len(naive(d, p)) for i, d in enumerate(documents) if naive(d, p)}


def test_text_mode_refuses_zero_bytes(spark):
    with pytest.raises(InvalidInput):
        search.locate(index(spark, [b"a"]), b"a\0")
    with pytest.raises(InvalidInput):
        corpus.from_memory(spark, [b"a\0b"])
    assert spots(search.locate(index(spark, [bytes([9, 0, 0, 200, 9, 0, 31])]), bytes([9, 0]), BINARY)) == [0, 4]


def test_documents_and_slices(spark):
    texts = [b"Hello World", b"Spark is fast", b"substring search", b""]
    parts = index(spark, texts, 9)
    for i, t in enumerate(texts[:3]):
        assert access.get_document(parts, i) == t
    with pytest.raises(KeyError):
        access.get_document(parts, 3)
    one = index(spark, [b"abcd"])
    assert access.extract(one, 4, 1) == b"\0"
    assert access.extract(one, 3, 2) == b"d\0"
    assert access.extract(one, 0, 5) == b"abcd\0"
    assert access.extract(one, 9, 0) == b""
    with pytest.raises(InvalidInput):
        access.extract(one, 0, 6)
    with pytest.raises(InvalidInput):
        access.extract(one, 4, 1, mode=BINARY)
    assert access.doc_count(parts) == 3
    assert access.shard_count(parts) > 3


def test_places(spark):
    docs = corpus.from_memory(spark, [b"abc", b"", b"de"])
    bounds = access.offsets(docs)
    assert sorted(tuple(r) for r in bounds.collect()) == [(0, 0, 3), (1, 3, 3), (2, 3, 5)]
    asked = spark.createDataFrame([(i,) for i in range(8)], "pos long")
    got = sorted(tuple(r) for r in access.documents_at(bounds, asked, 6).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 2, 0), (4, 2, 1), (5, 2, 2)]


def test_concatenated(spark):
    docs = corpus.from_concatenated(spark, b"abcdef", [0, 3, 3])
    assert [bytes(r["content"]) for r in docs.orderBy("doc_id").collect()] == [b"abc", b"", b"def"]
    for bad in ([], [1], [0, 4, 3], [0, 7]):
        with pytest.raises(InvalidInput):
            corpus.validate_offsets(bad, 6)
    rows = spark.createDataFrame([(bytearray(b"abcdef"), [0, 2])], "content binary, offsets array<long>")
    assert [bytes(r["content"]) for r in corpus.split_column(rows).orderBy("doc_ordinal").collect()] == [b"ab", b"cdef"]


@pytest.mark.parametrize("word", [b"a", b"banana", b"mississippi", b"abracadabra", b"\x00\xff\x00\xff"])
def test_suffixes(spark, word, tmp_path):
    parts = index(spark, [word])
    table = suffix.suffixes(parts, BINARY).cache()
    marked = suffix.symbols(word, BINARY).tolist()
    want = sorted(range(len(marked)), key=lambda i: marked[i:])
    rows = table.orderBy("row").collect()
    assert [r["sa"] for r in rows] == want
    # following lf from the row of the whole text spells it backwards
    lf = {r["row"]: r["lf"] for r in suffix.lf_steps(table).collect()}
    row, spelt = next(r["row"] for r in rows if r["sa"] == len(word)), []
    for _ in word:
        spelt.append(rows[row]["bwt"] - 1)
        row = lf[row]
    assert bytes(spelt[::-1]) == word
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    joined = {r["row"]: r["sa"] for r in suffix.suffix_array_joins(corpus.from_memory(spark, [word], BINARY)).collect()} if len(word) < 8 else None
    assert joined is None or [joined[i] for i in range(len(want))] == want


def test_intervals(spark):
    parts = index(spark, [b"mississippi"])
    table = suffix.suffixes(parts)
    assert spots(suffix.located(parts, table, b"ss")) == spots(suffix.located_by_shard(parts, b"ss")) == [2, 5]
    assert spots(suffix.located(parts, table, b"x")) == [] and spots(suffix.located_by_shard(parts, b"")) == list(range(12))
    got = {r["pattern"]: (r["sp"], r["ep"]) for r in suffix.intervals(parts, table, {"issi": b"issi", "z": b"z", "": b"", "ss": b"ss"}).collect()}
    assert got == {"issi": (3, 4), "z": (1, 0), "": (0, 11), "ss": (10, 11)}
    assert [suffix.ranks(table, ord(c), 12).first()["n"] for c in "ism"] == [4, 4, 1]
    assert suffix.access(table, 0).first()["bwt"] == ord("i")
