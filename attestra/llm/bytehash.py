"""Vectorised hashes of words and of byte windows over the buffer of many texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


@lru_cache(maxsize=4)
def _codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = max(n + 1, 1 << 16)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        got = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[base] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    up, _ = powers(len(values), base)
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def ranges(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of values[start:end], the same wherever it stands."""
    _, down = powers(len(pre), base)
    return mix((pre[end] - pre[start]) * down[start])


def fixed(pre: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hashes of all windows of a width."""
    n = len(pre) - width
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, down = powers(len(pre), base)
    return mix((pre[width:] - pre[:n]) * down[:n])


def coded(data: np.ndarray, seed: int = 7) -> np.ndarray:
    return _codes(seed)[data]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width], by doubling."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run without ASCII white space."""
    if not len(data):
        z = np.zeros(0, dtype=np.int64)
        return z, z
    gap = SPACE[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = not gap[0]
    edge[-1] = not gap[-1]
    np.not_equal(gap[1:], gap[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 7, at_once: int = 100_000) -> np.ndarray:
    """Hash of each word, by slices: the byte-long arrays stay small however long the data is."""
    out = np.empty(len(starts), dtype=np.uint64)
    for k in range(0, len(starts), at_once):
        s, e = starts[k : k + at_once], ends[k : k + at_once]
        out[k : k + at_once] = ranges(prefix(coded(data[s[0] : e[-1]], seed)), s - s[0], e - s[0])
    return out
