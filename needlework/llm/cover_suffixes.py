"""Suffix sorting in blocks with a difference cover.

The residues of a difference cover modulo v are such that for any two positions some shift below v brings both onto covered residues. Suffixes at
covered positions are ranked first; then the wanted suffixes are sorted one bucket (by leading bits) at a time, on their first v tokens only, and ties
that last v tokens are settled by the ranks at the common covered shift. Working memory beyond the ranks is that of the largest bucket.
"""

from __future__ import annotations

import functools

import numpy as np

V = 31
COVER = (1, 5, 11, 24, 25, 27)
BUCKETS = 16


def _shifts() -> np.ndarray:
    """shift[a, b]: the least d < V with a + d and b + d both covered."""
    covered = np.zeros(V, bool)
    covered[list(COVER)] = True
    out = np.full((V, V), -1, np.int64)
    for d in range(V - 1, -1, -1):
        hit = np.roll(covered, -d)
        out[np.ix_(hit, hit)] = d
    assert (out >= 0).all()
    return out


SHIFT = _shifts()


def _groups(changed: np.ndarray) -> np.ndarray:
    return np.cumsum(changed) - 1


def _refine(order: np.ndarray, pairs: np.ndarray, ahead: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort positions on their first ``depth`` tokens; the order and a group number for positions that agree on all of them.

    pairs: two tokens at each position as one number; ahead: hash of tokens 2 to V - 1 from each position.
    """
    key = pairs[order]
    by = np.argsort(key)
    order, key = order[by], key[by]
    changed = np.ones(len(order), bool)
    changed[1:] = key[1:] != key[:-1]
    group = _groups(changed)
    # only groups that aren't equal throughout go on
    d = 2
    open_ = _open(order, group, ahead)
    while d < depth and open_.any():
        at = np.flatnonzero(open_)
        key = pairs[order[at] + d]
        if d + 1 >= depth:
            key = key >> np.uint64(32)
        by = np.lexsort((key, group[at]))
        order[at] = order[at[by]]
        key = key[by]
        fresh = np.zeros(len(order), bool)
        fresh[at[1:]] = key[1:] != key[:-1]
        starts = np.ones(len(order), bool)
        starts[1:] = group[1:] != group[:-1]
        group = _groups(starts | fresh)
        d += 2
        open_ = open_ & _open(order, group, ahead)
    return order, group


def _open(order: np.ndarray, group: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Members of groups in which the tokens ahead differ."""
    if not len(order):
        return np.zeros(0, bool)
    n = group[-1] + 1
    starts = np.searchsorted(group, np.arange(n))
    h = ahead[order]
    differs = np.zeros(n, bool)
    apart = np.zeros(len(order), bool)
    apart[1:] = (h[1:] != h[:-1]) & (group[1:] == group[:-1])
    np.logical_or.at(differs, group[apart], True)
    del starts
    return differs[group]


def suffix_order(tokens: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted positions of ``tokens`` in suffix order.

    tokens: uint32; no two suffixes may be equal up to the end (end each string with a token of its own).
    """
    n = len(tokens)
    if not len(wanted):
        return wanted
    padded = np.concatenate([tokens, np.zeros(2 * V + 2, np.uint32)])
    pairs = (padded[:-1].astype(np.uint64) << np.uint64(32)) | padded[1:]
    from needlework.llm.tokens import runs

    ahead = np.zeros(len(padded), np.uint64)
    h = runs(padded.astype(np.uint64) + np.uint64(1), V - 2)
    ahead[: len(h) - 2] = h[2:]
    # ranks of the covered positions: by V tokens, then doubling over steps of V
    positions = np.arange(n)
    covered = np.isin(positions % V, COVER)
    sample = positions[covered]
    order, group = _refine(sample.copy(), pairs, ahead, V)
    rank = np.zeros(n + 2 * V + 2, np.int64)
    rank[order] = group + 1
    step = V
    while len(order) and group[-1] + 1 < len(order):
        size = np.bincount(group)
        at = np.flatnonzero(size[group] > 1)
        beyond = np.minimum(order[at] + step, n)
        key = rank[beyond]
        by = np.lexsort((key, group[at]))
        order[at] = order[at[by]]
        key = key[by]
        fresh = np.zeros(len(order), bool)
        fresh[at[1:]] = key[1:] != key[:-1]
        starts = np.ones(len(order), bool)
        starts[1:] = group[1:] != group[:-1]
        group = _groups(starts | fresh)
        rank[order] = group + 1
        step *= 2
    # one bucket at a time
    lead = tokens[wanted] >> np.uint32(28)
    out = []
    for bucket in range(BUCKETS):
        part = wanted[lead == bucket]
        if len(part):
            order, group = _refine(part.copy(), pairs, ahead, V)
            out.append(_settle(order, group, rank))
    return np.concatenate(out)


def _settle(order: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Put positions that agree on V tokens in order by the ranks at their common covered shift."""
    size = np.bincount(group)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    for g in range(2, 25):
        at = start[size == g]
        if not len(at):
            continue
        rows = order[at[:, None] + np.arange(g)]
        residue = rows % V
        place = np.zeros(rows.shape, np.int64)
        for a in range(g):
            for b in range(a + 1, g):
                d = SHIFT[residue[:, a], residue[:, b]]
                later = rank[rows[:, a] + d] > rank[rows[:, b] + d]
                place[:, a] += later
                place[:, b] += ~later
        order[(at[:, None] + place).ravel()] = rows.ravel()
    ranks = None
    for at, g in zip(start[size > 24].tolist(), size[size > 24].tolist(), strict=True):
        if ranks is None:
            ranks, shift = rank.tolist(), SHIFT.tolist()

        def compare(a: int, b: int) -> int:
            d = shift[a % V][b % V]
            return ranks[a + d] - ranks[b + d]

        order[at : at + g] = sorted(order[at : at + g].tolist(), key=functools.cmp_to_key(compare))
    return order
