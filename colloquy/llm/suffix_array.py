"""Suffix arrays by induced sorting, in numpy passes over whole buckets.

The two inductions work bucket by bucket: all suffixes that a bucket part induces are placed
at once, in rounds only where a letter repeats. The reduced string of named substrings has an
alphabet too large for that and is ordered by doubling the ranks of its suffixes.
"""

from __future__ import annotations

import numpy as np


def smaller_type(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the text ends with a unique 0."""
    step = np.diff(text)
    n = len(step)
    change = np.minimum.accumulate(np.where(step != 0, np.arange(n), n)[::-1])[::-1]
    return np.append(step[change] > 0, True) if n else np.ones(1, dtype=bool)


def _grouped(letters: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by letter, the rank inside each letter's group, and the group sizes."""
    order = np.argsort(letters, kind="stable")
    counts = np.bincount(letters, minlength=size)
    rank = np.arange(len(letters)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order, rank, counts


def induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the order of ``seeds`` (leftmost smaller) induces."""
    size = int(text.max()) + 1
    ends = np.cumsum(np.bincount(text, minlength=size))
    starts = ends - np.bincount(text, minlength=size)
    larger = np.bincount(text[~smaller], minlength=size)
    out = np.full(len(text), -1, dtype=np.int64)
    order, rank, seeded = _grouped(text[seeds], size)
    sorted_seeds = seeds[order]
    out[(ends - seeded)[text[sorted_seeds]] + rank] = sorted_seeds

    head = starts.copy()
    used = np.flatnonzero(ends > starts)

    def forward(block: np.ndarray) -> None:
        before = block[block > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            order, rank, counts = _grouped(text[before], size)
            placed = before[order]
            out[head[text[placed]] + rank] = placed
            head[:] += counts

    for c in used:
        at = starts[c]
        while at < head[c]:
            stop = head[c]
            forward(out[at:stop])
            at = stop
        forward(out[ends[c] - seeded[c]:ends[c]])

    tail = ends.copy()

    def backward(block: np.ndarray) -> None:
        before = block[::-1]
        before = before[before > 0] - 1
        before = before[smaller[before]]
        if len(before):
            order, rank, counts = _grouped(text[before], size)
            placed = before[order]
            out[tail[text[placed]] - 1 - rank] = placed
            tail[:] -= counts

    for c in used[::-1]:
        if c == 0:  # the end of the text induces nothing smaller than itself
            break
        at = ends[c]
        while tail[c] < at:
            stop = tail[c]
            backward(out[stop:at])
            at = stop
        backward(out[starts[c]:starts[c] + larger[c]])
    return out


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """For the substrings between leftmost smaller positions: equal ones get one name."""
    number = np.empty(len(text), dtype=np.int64)
    number[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms), 0) + 1
    a, b = ordered[:-1], ordered[1:]
    la = length[number[a]]
    alike = np.flatnonzero(la == length[number[b]])
    same = np.zeros(len(a), dtype=bool)
    if len(alike):
        sizes = la[alike]
        edge = np.cumsum(sizes) - sizes
        k = np.arange(int(sizes.sum())) - np.repeat(edge, sizes)
        equal = text[np.repeat(a[alike], sizes) + k] == text[np.repeat(b[alike], sizes) + k]
        same[alike] = np.logical_and.reduceat(equal, edge)
    names = np.empty(len(lms), dtype=np.int64)
    names[number[ordered]] = np.concatenate([[0], np.cumsum(~same)])
    return names


def _order_by_doubling(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string of names in order; its last name is the smallest and unique."""
    rank, width, n = names, 1, len(names)
    while int(rank.max()) + 1 < n:
        after = np.zeros(n, dtype=np.int64)
        after[:n - width] = rank[width:] + 1
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        width *= 2
    return np.argsort(rank, kind="stable")


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The suffixes of a byte string in order."""
    text = np.zeros(len(data) + 1, dtype=np.int64)
    text[:-1] = data.astype(np.int64) + 1
    smaller = smaller_type(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(len(text), dtype=bool)
        is_lms[lms] = True
        rough = induce(text, smaller, lms)
        names = _names(text, lms, rough[is_lms[rough]])
        lms = lms[_order_by_doubling(names)]
    return induce(text, smaller, lms)[1:]


def common_prefixes(data: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: the suffix before it in order (-1 for the first) and the length of
    their common prefix.

    In text order a length is one less than the one before where the preceding letters agree;
    only the other positions are compared, eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    padded = np.zeros(n + 8, dtype=np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)  # the end differs from every letter
    place = np.arange(n)
    lead = np.ones(n, dtype=bool)
    inner = np.flatnonzero((place > 0) & (before > 0))
    lead[inner] = data[inner - 1] != data[before[inner] - 1]
    p = np.flatnonzero(lead & (before >= 0))
    length = np.zeros(n, dtype=np.int64)
    q, done = before[p], np.zeros(len(p), dtype=np.int64)
    active = np.arange(len(p))
    while len(active):
        x, y = p[active] + done[active], q[active] + done[active]
        alive = np.ones(len(active), dtype=bool)
        for k in range(8):
            alive &= (np.maximum(x, y) + k < n) & (padded[np.minimum(x + k, n)] == padded[np.minimum(y + k, n)])
            done[active] += alive
            if not alive.any():
                break
        active = active[alive]
    length[p] = done
    start = np.maximum.accumulate(np.where(lead, place, 0))
    reduced = length[start] - (place - start)
    return before, np.where(before >= 0, np.maximum(reduced, 0), 0)
