"""Polynomial hashes of spans and winnowed anchors over numpy arrays.

A span's hash is (P[end] - P[start]) / R^start for the running sums P of value * R^position modulo 2^64; R is odd, so
it has an inverse, and the same span has the same hash wherever it stands.
"""

from __future__ import annotations

import numpy as np

R = np.uint64(0x9E3779B97F4A7C15)
R_INVERSE = np.uint64(pow(int(R), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bits of an anchor's sort key that hold its place; the rest hold its hash.
PLACE = 28

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R and its inverse to the powers 0 to n - 1 at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))

        def grown(base: np.uint64) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        _powers = grown(R), grown(R_INVERSE)
    return _powers


def sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start])


def grams(p: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values."""
    n = len(p) - 1
    if n < k:
        return np.zeros(0, np.uint64)
    _, down = powers(len(p))
    return mix((p[k:] - p[:-k]) * down[: n - k + 1])


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of words before each text (len + 1 of them)."""
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans(sums(BYTE_VALUES[data]), starts, ends)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    b = 1
    while 2 * b <= w:
        x = np.minimum(x[:-b], x[b:])
        b *= 2
    return np.minimum(x[: len(x) - (w - b)], x[w - b :]) if w > b else x


def anchored(p: np.ndarray, offsets: np.ndarray, k: int, length: int):
    """Winnowing: every window of `length` values has the least k-gram in it as its anchor, the leftmost of equals.

    Neighbouring windows with one anchor make a run. Returns, a row for each run: first and last window start, the
    anchor's place, the anchor's hash, and the hash of all that the run covers. Equal windows have equal anchors, so
    two windows can only be equal if their runs' anchors are.
    """
    n = len(p) - 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = grams(p, k)
    key = (gram >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(gram), dtype=np.uint64)
    place = (sliding_min(key, length - k + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    windows = len(place)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:windows]
    valid = np.arange(length, windows + length) <= ends
    other = np.ones(windows + 1, bool)
    other[1:-1] = place[1:] != place[:-1]
    off = np.ones(windows + 2, bool)
    off[1:-1] = ~valid
    first = np.flatnonzero(valid & (other[:-1] | off[:-2]))
    last = np.flatnonzero(valid & (other[1:] | off[2:]))
    at = place[first]
    return first, last, at, gram[at], spans(p, first, last + length) ^ mix((last - first).astype(np.uint64))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 to c - 1 for every c in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones in order; touching ones join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """A mask of n values: those inside an interval."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(start, n), 1)
    np.add.at(step, np.minimum(end, n), -1)
    return np.cumsum(step[:-1]) > 0
