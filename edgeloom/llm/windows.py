"""Bucket identifiers of windows of a text's bytes or words, and the windows that speak for their surroundings."""

from __future__ import annotations

import numpy as np

#: Pseudo-random 64-bit code of each byte value, and odd multipliers; all from one rule (splitmix64).


def _splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_CODES = _splitmix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = int(_splitmix(np.array([1000], np.uint64))[0]) | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An identifier of two identifiers."""
    x = a * np.uint64(0xD6E8FEB86659FD93) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    return x


def _sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of codes by powers of the base, from 0 on, and what undoes the power of each place."""
    up, down = _powers(len(codes))
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * up, out=sums[1:])
    return sums, down


def q_buckets(data: np.ndarray, q: int) -> np.ndarray:
    """The initial bucket of each position: an identifier of the q bytes there, or of the q words, given by their codes."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    sums, down = _sums(data if data.dtype == np.uint64 else _CODES[data])
    grams = sums[q:] - sums[:-q]
    grams *= down[: len(grams)]
    return pair(grams, np.uint64(q))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of a text's bytes, which ASCII white space parts."""
    inside = np.zeros(len(data) + 2, np.int8)
    np.logical_not(_SPACE[data], out=inside[1:-1], casting="unsafe")
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_codes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit code of each word; looks at about ``step`` bytes at a time, or a longer word."""
    codes, at = np.empty(len(begins), np.uint64), 0
    while at < len(begins):
        stop = max(at + 1, int(np.searchsorted(ends, begins[at] + step, "right")))
        sums, down = _sums(_CODES[data[begins[at] : ends[stop - 1]]])
        a, b = begins[at:stop] - begins[at], ends[at:stop] - begins[at]
        codes[at:stop] = pair((sums[b] - sums[a]) * down[a], (b - a).astype(np.uint64))
        at = stop
    return codes


def refined(buckets: np.ndarray, offset: int) -> np.ndarray:
    """Buckets refined by the bucket at a later offset."""
    return pair(buckets[:-offset], buckets[offset:]) if len(buckets) > offset else np.zeros(0, np.uint64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours (prefix and suffix minima of blocks)."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(grid, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def runs(buckets: np.ndarray, width: int, begins: np.ndarray | tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray]:
    """Cut the windows of ``width`` positions into runs with the same leftmost smallest bucket; a run begins at each of ``begins``.

    Returns each run's first window and the position of that bucket. The position depends on the window's
    content alone, so equal windows anywhere have it at the same distance.
    """
    if len(buckets) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding_least(buckets, width)
    n = len(least)
    left = np.empty(n, bool)  # the old smallest has just left
    np.equal(buckets[: n - 1], least[:-1], out=left[1:])
    left[list(begins)] = True
    came = np.zeros(n, bool)  # a smaller one has just come
    np.less(buckets[width : width + n - 1], least[:-1], out=came[1:])
    came[list(begins)] = False
    first = np.flatnonzero(left | came)
    at = first + width - 1
    seek = np.flatnonzero(~came[first])
    views = np.lib.stride_tricks.sliding_window_view(buckets, width)
    for i in range(0, len(seek), 4096):
        some = seek[i : i + 4096]
        at[some] = first[some] + views[first[some]].argmin(axis=1)
    return first, at
