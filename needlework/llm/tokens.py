"""Words of whole Arrow batches as 64-bit hashes, and hashes of runs of words, in numpy without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: bytes at or below 0x20 part words
BLANK = np.arange(256) <= 0x20
#: ASCII that is neither letter nor digit parts words
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_rng = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64, n at least."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), _BLOCK + 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit (in a new array)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words(NamedTuple):
    hashes: np.ndarray
    #: words of row i are first[i]:first[i + 1]
    first: np.ndarray


def words(texts: pa.Array, blank: np.ndarray = BLANK) -> Words:
    """Hashes of the words of each text; a null has none."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or ends[0] == ends[-1]:
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    buffer = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~blank[buffer]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = ends[1:-1]
    cuts = cuts[cuts < len(buffer)]
    starts[cuts] = inside[cuts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    stops[before] = inside[before]
    a = np.flatnonzero(starts)
    b = np.flatnonzero(stops) + 1
    out = np.empty(len(a), np.uint64)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(b, a[at] + _BLOCK, "right")))
        lo, hi = int(a[at]), int(b[to - 1])
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        x = _TABLE[buffer[lo:hi]]
        x *= up[: hi - lo]
        np.cumsum(x, out=sums[1:])
        i, j = a[at:to] - lo, b[at:to] - lo
        out[at:to] = (sums[j] - sums[i]) * down[i]
        at = to
    return Words(mix(out), np.searchsorted(a, ends).astype(np.int64))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (over row ends too: mask them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _BLOCK):
        to = min(n, at + _BLOCK)
        m = to - at + k - 1
        up, down = powers(m + 1)
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(hashes[at : at + m] * up[:m], out=sums[1:])
        out[at:to] = (sums[k : k + to - at] - sums[: to - at]) * down[: to - at]
    return mix(out)


def leftmost_min(values: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least value of each window of w values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, width = values, np.arange(len(values)), 1
    while width < w:
        step = min(width, w - width)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        at = np.where(take, at[step:], at[: len(at) - step])
        best = np.where(take, right, left)
        width += step
    return at


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each; a longer text is a part of its own."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(column)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
