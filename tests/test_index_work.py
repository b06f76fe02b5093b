"""What the index queries cost beyond their input: elements sorted, and tasks over which shards are spread."""

from __future__ import annotations

import numpy as np
import pytest

import __spark_entry__
from needlework.operators import suffix
from needlework.plans import queries

QUERIES = ["resolve_documents", "bwt_documents", "rank_documents", "lf_documents", "interval_documents", "suffix_array_documents", "count_indexed", "locate_indexed"]


def test_elements_sorted(monkeypatch):
    """Only suffixes that aren't told apart yet are sorted again."""
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(2, 9, 400)]
    text = b" ".join(words[i] for i in rng.integers(0, 400, 4000))
    text += text[500:700]
    x = suffix.symbols(text)
    sizes, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, **kw: sizes.append(len(a)) or argsort(a, **kw))
    sa = suffix.suffix_array(x).tolist()
    assert sum(sizes) < 3 * len(x)
    assert sa == sorted(range(len(x)), key=lambda i: text[i:])


@pytest.mark.parametrize("mode", ["text", "binary"])
def test_repetitive_texts(mode):
    rng = np.random.default_rng(1)
    texts = [b"", b"a", b"x" * 300, b"ab" * 150, b"\xff" * 40 + b"\xfe", bytes(range(1, 256)) * 2]
    texts += [bytes(rng.integers(mode == "text", top, n).astype(np.uint8)) for top in (2, 3, 256) for n in range(0, 70, 3)]
    for text in texts:
        assert suffix.suffix_array(suffix.symbols(text, mode)).tolist() == sorted(range(len(text) + 1), key=lambda i: text[i:])


@pytest.mark.parametrize("name", QUERIES)
def test_tasks(spark, sf, name):
    """Adaptive execution doesn't put the shards together by their bytes."""
    shards = queries.parts(spark, sf).select("shard_id").distinct().count()
    assert __spark_entry__.queries()[name](spark, sf).rdd.getNumPartitions() == min(64, shards) > 4
