"""Ingest options: defaults, file, flags, in rising order of precedence."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field, fields, replace

from needlework.functions.bytes import MODES, TEXT, InvalidInput

UNITS = {"": 1, "b": 1} | {u + s: 1024**i if s in ("", "ib") else 1000**i for i, u in enumerate("kmgt", 1) for s in ("", "b", "ib")}


def parse_size(text: str | int) -> int:
    """Bytes of 1GiB, 500MB, 64k or a bare number; single letters and -iB are powers of 1024, -B of 1000."""
    if isinstance(text, bool):
        raise InvalidInput("a size is a number or a text")
    if isinstance(text, int):
        if text < 0:
            raise InvalidInput("a size isn't negative")
        return text
    got = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", text)
    if not got or got[2].lower() not in UNITS:
        raise InvalidInput(f"not a size: {text!r}")
    n = int(got[1]) * UNITS[got[2].lower()]
    if n >= 1 << 64:
        raise InvalidInput(f"too large a size: {text!r}")
    return n


@dataclass(frozen=True)
class IngestConfig:
    inputs: tuple[str, ...] = ()
    output: str | None = None
    chunk_size: int = 1 << 30
    read_buffer: int = 8 << 20
    workers: int = 4
    sample_rate: int = 32
    encoding: str = TEXT
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.chunk_size < 2:
            raise InvalidInput("chunk_size is 2 at least")
        if self.sample_rate < 1 or self.workers < 1 or self.read_buffer < 1:
            raise InvalidInput("sample_rate, workers and read_buffer are positive")
        if self.encoding not in MODES:
            raise InvalidInput(f"unknown encoding {self.encoding!r}")


SIZES = ("chunk_size", "read_buffer")


def load(path: str) -> dict:
    """Options of a .json, .toml or .tml file; sizes as texts or numbers."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("json", "toml", "tml"):
        raise InvalidInput(f"config files are json or toml, not {path!r}")
    with open(path, "rb") as f:
        got = json.load(f) if kind == "json" else tomllib.load(f)
    return {k: parse_size(v) if k in SIZES else v for k, v in got.items()}


def merged(file: dict | None = None, flags: dict | None = None) -> IngestConfig:
    """Flags over file over defaults; None means not given. Storage options without meaning here are kept in ``extra``."""
    names = {f.name for f in fields(IngestConfig)} - {"extra"}
    out, extra = IngestConfig(), {}
    for layer in (file or {}, flags or {}):
        for k, v in layer.items():
            if v is None:
                continue
            if k in names:
                v = parse_size(v) if k in SIZES else tuple(v) if k == "inputs" else v
                out = replace(out, **{k: v})
            else:
                extra[k] = v
    return replace(out, extra=extra)
