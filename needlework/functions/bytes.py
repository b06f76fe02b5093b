"""Bytes as Spark sees them: every byte is one character of an ISO-8859-1 string, so positions and lengths are those of bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT, BINARY = "text", "binary"
MODES = (TEXT, BINARY)


class InvalidInput(ValueError):
    """A pattern, document or option that the engine doesn't take."""


def pattern_bytes(pattern: bytes | str, mode: str = TEXT) -> bytes:
    """The pattern's bytes; in text mode a zero byte is refused."""
    if mode not in MODES:
        raise InvalidInput(f"unknown mode {mode!r}")
    raw = pattern.encode() if isinstance(pattern, str) else bytes(pattern)
    if mode == TEXT and 0 in raw:
        raise InvalidInput("a text pattern holds no zero byte")
    return raw


def one_char_per_byte(content: Column) -> Column:
    """The lossless byte string of a binary column."""
    return F.decode(content, "ISO-8859-1")


def latin(raw: bytes) -> Column:
    return F.lit(raw.decode("latin-1"))


def overlapping(raw: bytes) -> Column:
    """A regular expression that matches, without width, wherever raw begins."""
    return F.lit("(?=" + "".join(f"\\x{b:02x}" for b in raw) + ")")


def hits_in(s: Column, raw: bytes) -> Column:
    """Number of places at which raw begins in s, overlaps included."""
    return F.when(F.contains(s, latin(raw)), F.regexp_count(s, overlapping(raw))).otherwise(F.lit(0)).cast("long")


def piece_lengths(s: Column, raw: bytes) -> Column:
    """Lengths of the pieces of s cut before each occurrence: their running sums are the occurrences' places (and 0)."""
    return F.transform(F.split(s, overlapping(raw), -1), lambda x: F.length(x).cast("long"))


def places(s: Column, raw: bytes) -> Column:
    """Where raw begins in s, in order. Only the lengths of the pieces leave the JVM, for their running sums."""

    def running(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: x.cumsum())

    # without the last piece, which no occurrence ends
    pieces = piece_lengths(s, raw)
    ends = F.pandas_udf(running, "array<long>")(F.slice(pieces, 1, F.size(pieces) - 1))
    head = F.when(F.startswith(s, latin(raw)), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.concat(head, ends)


def checked(content: Column, mode: str = TEXT) -> Column:
    """The content; in text mode a zero byte in it is an error when the row is read."""
    if mode != TEXT:
        return content
    return F.when(F.contains(one_char_per_byte(content), F.lit("\0")), F.raise_error(F.lit("zero byte in a text document"))).otherwise(content)


def format_bytes(n: Column) -> Column:
    """1.50 KiB and the like; whole bytes below a KiB."""
    size = n.cast("double")
    out = F.format_string("%d B", n.cast("long"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        out = F.when(size >= 1024**power, F.format_string(f"%.2f {unit}", size / 1024**power)).otherwise(out)
    return out


def lossy(raw: bytes) -> str:
    """Text for display: what isn't UTF-8 is replaced."""
    return raw.decode(errors="replace")
