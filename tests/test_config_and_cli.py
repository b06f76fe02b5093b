from __future__ import annotations

import json

import pytest

from needlework import cli
from needlework.functions.bytes import InvalidInput, format_bytes
from needlework.operators import suffix
from needlework.sources import config, corpus


def test_sizes():
    for text, n in (("64MiB", 67108864), ("1GiB", 1 << 30), ("500MB", 500_000_000), ("64k", 65536), ("7", 7), ("12b", 12), (9, 9), ("2kb", 2000), (" 3 m ", 3 << 20)):
        assert config.parse_size(text) == n
    for bad in ("", "x", "1.5M", "-1", "1QB", "99999999999999TiB"):
        with pytest.raises(InvalidInput):
            config.parse_size(bad)


def test_precedence(tmp_path):
    (tmp_path / "c.toml").write_text('chunk_size = "64MiB"\nread_buffer = 1048576\ninputs = ["a/*"]\nwavelet_mode = "auto"\n')
    got = config.merged(config.load(str(tmp_path / "c.toml")), {"read_buffer": "2k", "output": "out", "workers": None})
    assert (got.chunk_size, got.read_buffer, got.inputs, got.output, got.workers) == (67108864, 2048, ("a/*",), "out", 4)
    assert got.extra == {"wavelet_mode": "auto"}
    with pytest.raises(InvalidInput):
        config.load(str(tmp_path / "c.ini"))
    with pytest.raises(InvalidInput):
        config.merged({}, {"chunk_size": 1})


def test_shown_sizes(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 20,), (3 << 30,)], "n long")
    assert [r[0] for r in rows.orderBy("n").select(format_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.50 KiB", "5.00 MiB", "3.00 GiB"]


def test_files(spark, tmp_path):
    for name, text in (("b.txt", b"bb"), ("a.txt", b"abc"), ("empty.txt", b""), ("sub/c d.txt", b"x")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(text)
    paths = corpus.collect_paths([f"{tmp_path}/**/*.txt", f"{tmp_path}/*.txt"])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.txt", "b.txt", "empty.txt", "c d.txt"]
    docs = corpus.read_files(spark, paths).orderBy("doc_id").collect()
    assert [bytes(r["content"]) for r in docs] == [b"abc", b"bb", b"", b"x"]
    folder = corpus.read_folder(spark, str(tmp_path), "*.txt").orderBy("doc_id").collect()
    assert [r["len"] for r in folder] == [3, 2, 0, 1]
    with pytest.raises(FileNotFoundError):
        corpus.read_files(spark, [str(tmp_path / "none")])
    with pytest.raises(InvalidInput):
        corpus.read_files(spark, [])


def test_verbs(spark, tmp_path, capsys):
    (tmp_path / "one.txt").write_bytes(b"abcdefghij fast")
    (tmp_path / "two.txt").write_bytes(b"fast and fast")
    run = lambda *args: (cli.main([str(a) for a in args], spark), capsys.readouterr().out)[1]
    run("build", tmp_path / "one.txt", "--output", tmp_path / "single")
    assert json.loads(run("query", tmp_path / "single", "fast"))["count"] == 1
    assert run("extract", tmp_path / "single", 3, 4).strip() == "defg"
    run("build-multi", tmp_path / "two.txt", tmp_path / "one.txt", "--output", tmp_path / "multi", "--suffixes")
    made = cli.open_index(spark, str(tmp_path / "multi"))
    interval = suffix.intervals(made.segments, made.suffixes, {"fast": b"fast"}).first()
    assert interval["ep"] - interval["sp"] == 2 and made.suffixes.count() == 29
    assert cli.open_index(spark, str(tmp_path / "single")).suffixes is None
    got = json.loads(run("query", tmp_path / "multi", "fast"))
    assert got["count"] == 3 and got["preview"][0] == [0, 0]
    assert json.loads(run("query", tmp_path / "multi", "tab"))["count"] == 1
    assert json.loads(run("query", tmp_path / "multi", "tab", "--doc-safe"))["count"] == 0
    report = json.loads(run("ingest", "--input", tmp_path / "*.txt", "--output", tmp_path / "index", "--chunk-size", 8))
    assert (report["n_docs"], report["n_shards"], report["total_bytes"]) == (2, 5, 28)
    assert json.loads(run("query", tmp_path / "index", "fgh"))["count"] == 1
    assert run("doc", tmp_path / "index", 0).strip() == "abcdefghij fast"
    assert len(json.loads(run("stats", tmp_path / "index"))) == 5
    with pytest.raises(InvalidInput):
        cli.open_index(spark, str(tmp_path / "nothing"))


def test_stream(spark, tmp_path):
    from needlework.operators import access, search
    from needlework.streaming import ingest

    source, index = tmp_path / "in", tmp_path / "index"
    source.mkdir()
    (source / "a.txt").write_bytes(b"needle in hay")
    ingest.run_available(spark, str(source), str(index), str(tmp_path / "marks"), chunk_size=8)
    (source / "b.txt").write_bytes(b"another needle")
    ingest.run_available(spark, str(source), str(index), str(tmp_path / "marks"), chunk_size=8)
    segments = cli.open_index(spark, str(index)).segments
    assert sorted(tuple(r) for r in search.locate_merged(segments, b"needle").collect()) == [(0, 0), (1, 8)]
    assert access.get_document(segments, 1) == b"another needle"


def test_two_streams(spark, tmp_path):
    """Streams with marks of their own fill one index, which may have been built before; nothing is lost and nothing taken twice."""
    from needlework.streaming import ingest

    index = str(tmp_path / "index")
    (tmp_path / "first.txt").write_bytes(b"first")
    cli.build(corpus.read_files(spark, [str(tmp_path / "first.txt")]), index)
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt").write_bytes(f"text of {name}".encode())
    for name in ("a", "b", "a"):
        ingest.run_available(spark, str(tmp_path / name), index, str(tmp_path / f"marks-{name}"))
    made = cli.open_index(spark, index).segments.orderBy("doc_id").collect()
    assert [(r["doc_id"], bytes(r["content"])) for r in made] == [(0, b"first"), (1, b"text of a"), (2, b"text of b")]
