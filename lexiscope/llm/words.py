"""Words of byte texts and their 64-bit hashes, in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_64_intdigest

from lexiscope.llm.common import SLICE_BYTES

#: words beyond this many bytes are hashed one by one
LONG_WORD = 256
_ODD = 0x9E3779B97F4A7C15
_WORD = np.array([xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _groups(starts: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive words that lie within ``limit`` bytes (or one word)."""
    a, n = 0, len(starts)
    while a < n:
        z = max(a + 1, int(np.searchsorted(ends, starts[a] + limit, side="right")))
        yield a, z
        a = z


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word ``data[start:end]`` (words in order, not overlapping): its bytes' polynomial, mixed."""
    out = np.zeros(len(starts), np.uint64)
    size = SLICE_BYTES // 4
    up, down = _powers(_ODD, size + 1), _powers(pow(_ODD, -1, 1 << 64), size + 1)
    for a, z in _groups(starts, ends, size):
        base, stop = int(starts[a]), int(ends[z - 1])
        if stop - base > size:  # one long word
            continue
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum(_WORD[data[base:stop]] * up[:stop - base], out=sums[1:])
        s, e = starts[a:z] - base, ends[a:z] - base
        out[a:z] = (sums[e] - sums[s]) * down[s]
    out = mix(out + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = xxh3_64_intdigest(data[starts[k]:ends[k]].tobytes())
    return out


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words."""
    out = hashes[:max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(_ODD) + hashes[k:k + len(out)])
    return out
