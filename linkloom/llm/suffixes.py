"""Two-stage suffix sorting of a block of bytes, and repeats from adjacent common prefixes.

Stage one sorts only the suffixes that are smaller than their successors, by their first ``DEPTH``
bytes.  Stage two scans the buckets of first bytes from left to right and places each remaining
suffix when its successor is met.  Suffixes that share their first DEPTH bytes then stand together,
so a common prefix of DEPTH bytes shows between neighbours.
"""

from __future__ import annotations

import numpy as np

DEPTH = 200
#: Stands between texts; no UTF-8 text holds it.
SEPARATOR = 0xFF
#: Unresolved suffixes that are sorted by their bytes at once.
FEW = 150_000


def words_at(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as an integer that sorts as they do."""
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return np.ascontiguousarray(view[at]).view(">u8").ravel().astype(np.uint64)


def smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one is not."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    following = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]  # the end of each run of equal bytes
    after = np.append(text, 0)[following + 1].astype(np.int16)
    after[following == n - 1] = -1
    return text < after


def sort_directly(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` ordered by DEPTH bytes: eight at a time, while some are equal so far."""
    key = words_at(padded, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.append(True, key[1:] != key[:-1])
    for depth in range(8, DEPTH, 8):
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        if len(open_) <= FEW:
            raw = padded.tobytes()
            places = at[open_].tolist()
            at[open_] = sorted(places, key=lambda i: raw[i : i + DEPTH])
            break
        group = np.cumsum(new)[open_]
        key = words_at(padded, at[open_] + depth)
        order = np.lexsort((key, group))
        at[open_] = at[open_][order]
        key, group = key[order], group[order]
        new[open_[1:]] |= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    return at


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes ordered by their first DEPTH bytes at least (equal ones in any order)."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((text, np.zeros(DEPTH + 8, np.uint8)))
    less = smaller(text)
    direct = sort_directly(padded, np.flatnonzero(less))
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))  # the empty suffix precedes all others
    out: list[np.ndarray] = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        bucket: list[np.ndarray] = []
        step = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(step):  # equal first bytes: the predecessor joins the same bucket, behind
            bucket.append(step)
            step = step[step > 0] - 1
            step = step[text[step] == c]
        bucket.append(direct[bounds[c] : bounds[c + 1]])
        seen = np.concatenate(bucket)
        out.append(seen)
        before = seen[seen > 0] - 1
        before = before[text[before] > c]
        head = text[before]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        cuts = np.flatnonzero(np.append(True, head[1:] != head[:-1])) if len(head) else []
        for a, b in zip(cuts, [*cuts[1:], len(head)]):
            waiting[head[a]].append(before[a:b])
    return np.concatenate(out)


def common(padded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of places, do they share DEPTH bytes?"""
    alive = np.arange(len(a))
    for depth in range(0, DEPTH, 8):
        alive = alive[words_at(padded, a[alive] + depth) == words_at(padded, b[alive] + depth)]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def repeated_starts(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the places from which DEPTH bytes also start somewhere else in ``texts``."""
    sizes = np.array([len(t) for t in texts], np.int64)
    block = np.frombuffer(bytes([SEPARATOR]).join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes[:-1] + 1))) if len(texts) else np.zeros(0, np.int64)
    usable = np.zeros(len(block) + 1, np.int32)
    long = sizes >= DEPTH
    np.add.at(usable, starts[long], 1)
    np.add.at(usable, (starts + sizes - DEPTH + 1)[long], -1)
    usable = np.cumsum(usable)[:-1] > 0
    order = suffix_array(block)
    order = order[usable[order]]
    marked = np.zeros(len(block), bool)
    if len(order) > 1:
        padded = np.concatenate((block, np.zeros(DEPTH + 8, np.uint8)))
        same = common(padded, order[:-1], order[1:])
        marked[order[:-1][same]] = True
        marked[order[1:][same]] = True
    return [np.flatnonzero(marked[s : s + n]) for s, n in zip(starts.tolist(), sizes.tolist())]
