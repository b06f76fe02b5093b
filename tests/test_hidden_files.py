"""Files whose names begin with _ or . are documents as others are."""

from __future__ import annotations

import os

from needlework.sources import corpus


def test_hidden_files(spark, tmp_path):
    texts = {"_b.txt": b"under", ".c.txt": b"dot", "a.txt": b"plain", "_empty": b"", "sub/_d.txt": b"deep", "_sub/e.txt": b"below"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    paths = corpus.collect_paths([f"{tmp_path}/**"])
    assert len(paths) == len(texts)
    for docs in (corpus.read_files(spark, paths), corpus.read_folder(spark, f"file://{tmp_path}")):
        got = {os.path.relpath(r["source_path"], tmp_path): (bytes(r["content"]), r["len"]) for r in docs.collect()}
        assert got == {name: (text, len(text)) for name, text in texts.items()}
    only = corpus.read_files(spark, [str(tmp_path / "_b.txt")]).collect()
    assert [bytes(r["content"]) for r in only] == [b"under"]
