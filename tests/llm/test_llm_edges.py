"""Each operator on nulls, empty and very long texts, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import json
import os

import duckdb
import pytest

import corpus_pipeline
from needlework.llm import attention_lm, cgk_decontam, host_suffixes, kk_packing, order_minhash, quality_ledger, ring_shards, suffix_dedup, url_rules, warc_writer

LONG = " ".join(f"w{i}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, key string, tid int, n_words int, _row string, n_chars long, keep boolean, ids binary"
ROWS = [
    (1, "a plain text of a few words", "en"),
    (1, "a plain text of a few words", "en"),
    (1, "another text under the same id", None),
    (2, None, None),
    (2, None, "en"),
    (None, "a text without an id", "en"),
    (None, None, None),
    (3, "", "en"),
    (4, "", "en"),
    (5, " \n\t ", "en"),
    (6, LONG, "en"),
    (7, LONG + " end", "en"),
    (8, "x" * 200_000, "en"),
    (9, "same same same same same same same same " * 20, "en"),
    (10, "é́ \U0001f600 \x00 \x7f", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, "k", 1, 2, "r", len(t) if t else None, None, None) for i, t, lang in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


PAGES = "page_id long, url string, html string, key string, text string, bucket long"
PAGE_ROWS = [
    (1, "https://a.example/x/1", "<p>hello there</p>"),
    (1, "https://a.example/x/1", "<p>hello there</p>"),
    (2, None, "<p>no url</p>"),
    (3, "https://a.example/", None),
    (None, "not an url", ""),
    (None, None, None),
    (4, "http://B.example:80/long", "<div>" + LONG + "</div><!-- open"),
    (5, "https://a.example/2?b=1&c=&d#f", "<script>var x='<p>'</script><b>tag &amp; text &lt;p&gt;</b>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "k", "t", 5) for r in PAGE_ROWS], PAGES)


def test_rings(spark, docs, none):
    out = ring_shards.assign(docs, "doc_id", 3, 8, 0.1).collect()
    assert len(out) == len(ROWS)
    assert ring_shards.assign(none, "doc_id").count() == 0


def test_packing(spark, docs, none):
    out = kk_packing.pack(docs, capacity=512, group_bytes=1 << 16).collect()
    assert all(0 < r["n_tokens"] <= 512 for r in out)
    whole: dict = {}
    for r in out:
        at = 0
        for i, no in zip(r["doc_ids"], r["piece_nos"]):
            whole.setdefault(i, []).append(no)
    assert sorted(set(whole), key=str) == sorted({i for i, t, _ in ROWS if t}, key=str)
    assert sum(len(r["text"]) for r in out) == sum(len(t) for _, t, _ in ROWS if t)
    assert kk_packing.pack(none).count() == 0


def test_ledger(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 1), (2, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    lexicon = quality_ledger.lexicon(labels, docs)
    out = quality_ledger.ledger(docs, lexicon).collect()
    assert len(out) == len(ROWS)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[3]["fail_bits"] == quality_ledger.BIT["empty"] and by_id[2]["n_words"] == 0
    assert not by_id[9]["keep"] and by_id[6]["keep"] and not by_id[8]["keep"]
    kept = quality_ledger.kept(docs, lexicon)
    assert kept.columns == docs.columns
    assert quality_ledger.ledger(none, []).count() == 0
    assert quality_ledger.lexicon(labels.where("false"), none) == []
    assert quality_ledger.ablation(quality_ledger.ledger(none, [])).count() == 0


def test_near_duplicates(spark, docs, none):
    got = {(r["key"], r["duplicate_of"], r["kind"]) for r in order_minhash.duplicates(docs).collect()}
    assert (7, 6, "near") in got and (4, 3, "exact") in got
    left = order_minhash.dedup(docs)
    assert left.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert rows.count((1, ROWS[0][1])) == 1 and (6, LONG) in rows and (7, LONG + " end") not in rows
    assert sum(t is None for _, t in rows) == 3 and (3, "") in rows and (4, "") not in rows
    assert order_minhash.duplicates(none).count() == 0 and order_minhash.dedup(none).count() == 0


def test_passages(spark, docs, none):
    left = suffix_dedup.dedup(docs)
    assert left.columns == docs.columns
    rows = [(r["doc_id"], r["text"], r["n_chars"]) for r in left.collect()]
    assert (6, LONG, len(LONG)) in rows and (7, "end", 3) in rows
    # given twice, a row covers nothing of itself
    assert [t for i, t, _ in rows].count(ROWS[0][1]) == 2
    # one word over and over is no passage
    assert (9, ROWS[13][1], len(ROWS[13][1])) in rows
    assert sum(t is None for _, t, _ in rows) == 3
    assert suffix_dedup.dedup(none).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_decontamination(spark, docs, none, monkeypatch, most):
    monkeypatch.setattr(cgk_decontam, "BROADCAST_IDS", most)
    items = spark.createDataFrame([(1, "plain TEXT of a few, words!", "x"), (2, None, "x"), (3, "", "x"), (4, "!!!", "x"), (None, "w20 w21 w22 w23 w24", "x"), (1, "plain TEXT of a few, words!", "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"], r["n_edits"]) for r in cgk_decontam.findings(docs, items).collect()}
    assert got == {(1, 1, 0), (6, None, 0), (7, None, 0)}
    left = cgk_decontam.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _, _ in ROWS if i not in (1, 6, 7))
    assert cgk_decontam.findings(docs, items.where("false")).count() == 0
    assert cgk_decontam.decontaminate(none, items).count() == 0


def test_scores(spark, docs, none):
    coded = attention_lm.encoded(docs).cache()
    classes = attention_lm.Classes(attention_lm.counted(coded))
    model = attention_lm.fit(coded, classes)
    out = attention_lm.scored(coded, model, classes).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert (r["mean_nll"] is None) == (r["n_tokens"] == 0) and r["nll"] >= 0
    empty = attention_lm.encoded(none)
    classes = attention_lm.Classes(attention_lm.counted(empty))
    assert attention_lm.scored(empty, attention_lm.fit(empty, classes), classes).count() == 0


def test_warc(spark, pages, tmp_path):
    manifest = warc_writer.write(pages, f"file://{tmp_path}/w", bucket_bytes=100_000, file_bytes=20_000)
    assert manifest.count() == len(PAGE_ROWS)
    listed = [json.loads(x) for x in (tmp_path / "w/manifest.jsonl").read_text().splitlines()]
    assert sorted(x["file"] for x in listed) == sorted(f for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    nothing = warc_writer.write(pages.where("false"), f"file://{tmp_path}/n")
    assert nothing.count() == 0 and (tmp_path / "n/manifest.jsonl").read_text() == ""


def test_html(spark, pages):
    out = host_suffixes.extract(pages).collect()
    assert len(out) == len(PAGE_ROWS)
    by = {(r["page_id"], r["host"]): r for r in out}
    assert by[5, "a.example"]["text"] == "tag & text <p>" and by[3, "a.example"]["text"] == "" and by[1, "a.example"]["text"] == "hello there"
    assert by[4, "b.example"]["text"] == LONG and (2, "") in by
    assert host_suffixes.extract(pages.where("false")).count() == 0


def test_urls(spark, pages):
    labels = spark.createDataFrame([(1, 0, 0, "x"), (None, 0, 1, "x"), (2, None, None, "x")], "doc_id long, quality int, toxic int, url string")
    rules = url_rules.mine(pages, labels, support=1, confidence=0.5, lift=0.5)
    out = url_rules.apply(pages, rules).collect()
    assert len(out) == len(PAGE_ROWS) - 1
    assert {r["page_id"]: r["blocked"] for r in out}[1] is True
    assert sum(r["n_rows"] for r in out) == len(PAGE_ROWS)
    assert url_rules.apply(pages, url_rules.mine(pages, labels.where("false"))).where("blocked").count() == 0
    assert url_rules.apply(pages.where("false"), rules).count() == 0


def test_pipeline_on_awkward_rows(spark, docs, none, tmp_path):
    columns = ["doc_id", "text", "lang", "key", "tid", "n_words", "_row", "n_chars", "keep"]
    for name, table in (("some", docs), ("none", none)):
        sf = tmp_path / name
        table.select(*columns).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "an item of five words")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, str(sf)).collect()
        assert bool(out) == (name == "some")


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    from needlework.llm import registry

    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf)
        columns = sorted(df.columns)
        got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
        assert got == want, name
