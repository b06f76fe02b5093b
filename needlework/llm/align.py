"""Edit distance of many pairs of word sequences at once, in bands that widen until the distance is known or the limit is passed."""

from __future__ import annotations

import numpy as np

FIRST_BAND = 16
CELLS = 1 << 16


def bag_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: words of one that the other lacks, counted with multiplicity."""
    both, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    d = np.bincount(inverse[: len(a)], minlength=len(both)) - np.bincount(inverse[len(a) :], minlength=len(both))
    return int(max(d[d > 0].sum(), -d[d < 0].sum()))


def band_distances(pairs: list[tuple[np.ndarray, np.ndarray]], t: int, limits: np.ndarray) -> np.ndarray:
    """The distance of each pair where it is at most t, else something above t or above the pair's limit."""
    n = np.array([len(a) for a, _ in pairs])
    m = np.array([len(b) for _, b in pairs])
    rows, width = int(n.max(initial=0)), 2 * t + 1
    big = np.int32(1 << 29)
    a = np.zeros((len(pairs), rows), np.int64)
    b = np.full((len(pairs), rows + width), -1, np.int64)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        y = y[: rows + t + 1]
        b[i, t : t + len(y)] = y
    steps = np.arange(width, dtype=np.int32)
    now = np.where(steps >= t, steps - t, big).astype(np.int32) + np.zeros((len(pairs), 1), np.int32)
    result = np.full(len(pairs), big, np.int64)
    live = np.arange(len(pairs))
    end = m - n + t
    done = n == 0
    inside = (end >= 0) & (end < width)
    result[done & inside] = now[np.flatnonzero(done & inside), end[done & inside]]
    for i in range(rows):
        # cell d is column j = i + 1 + d - t
        new = now + (a[:, i, None] != b[:, i : i + width])
        new[:, :-1] = np.minimum(new[:, :-1], now[:, 1:] + 1)
        if i + 1 <= t:
            new[:, t - i - 1] = i + 1
            new[:, : t - i - 1] = big
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)
        new += steps
        now = new
        at = np.flatnonzero(n[live] == i + 1)
        if len(at):
            who = live[at]
            ok = inside[who]
            result[who[ok]] = now[at[ok], end[who[ok]]]
        if i % 32 == 31:
            going = (n[live] > i + 1) & (now.min(axis=1) <= np.minimum(limits[live], t))
            if not going.all():
                live, now, a, b = live[going], now[going], a[going], b[going]
                if not len(live):
                    break
    return result


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """The edit distance of each pair where it is within the pair's limit, else -1."""
    out = np.full(len(pairs), -1, np.int64)
    cut = []
    for i, (a, b) in enumerate(pairs):
        # what both begin or end with takes no part
        k = min(len(a), len(b))
        apart = np.flatnonzero(a[:k] != b[:k])
        p = int(apart[0]) if len(apart) else k
        a, b = a[p:], b[p:]
        k = min(len(a), len(b))
        apart = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
        s = int(apart[0]) if len(apart) else k
        a, b = a[: len(a) - s], b[: len(b) - s]
        if abs(len(a) - len(b)) > limits[i]:
            cut.append(None)
        elif not len(a) or not len(b):
            out[i] = max(len(a), len(b))
            cut.append(None)
        else:
            cut.append((a, b))
    todo = [i for i, c in enumerate(cut) if c is not None]
    t = FIRST_BAND
    while todo:
        if t > FIRST_BAND:
            todo = [i for i in todo if bag_distance(*cut[i]) <= limits[i]] if t == 4 * FIRST_BAND else todo
        todo.sort(key=lambda i: len(cut[i][0]))
        again = []
        at = 0
        while at < len(todo):
            step = max(1, CELLS // (2 * t + 1))
            part = todo[at : at + step]
            found = band_distances([cut[i] for i in part], t, limits[part])
            for i, d in zip(part, found.tolist(), strict=True):
                if d <= min(t, limits[i]):
                    out[i] = d
                elif t < limits[i]:
                    again.append(i)
            at += step
        todo, t = again, 4 * t
    return out
