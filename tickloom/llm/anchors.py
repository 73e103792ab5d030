"""Hashes of substrings, and the places where repeated windows are looked for.

A window of ``window`` symbols (bytes, or hashes of words) holds
``window - seed + 1`` seeds, substrings of ``seed`` symbols. Its *anchor* is
the seed with the least hash, the leftmost of equals. Equal windows have equal
anchors at equal places, so a repeated window shows as a repeated anchor, and
only one seed in about ``(window - seed) / 2`` has to be shuffled. Consecutive
windows with one anchor form a *block*.

All arrays here belong to a few texts laid end to end; nothing crosses texts.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

U64 = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Symbols handled at once; it bounds the memory of a task.
PIECE = 1 << 18
_ORDER_BITS = 20


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(n, base, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    """A random 64-bit number for each byte value."""
    return mix(np.arange(1, 257, dtype=U64))


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of ``h`` moves every bit of the result."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Rolling:
    """Hash of any substring of ``codes``, at most 2 * PIECE symbols."""

    def __init__(self, codes: np.ndarray):
        size = max(2 * PIECE, 1 << int(len(codes) + 1).bit_length())
        self._up, self._down = _powers(size)
        self._sums = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * self._up[: len(codes)], out=self._sums[1:])

    def __len__(self) -> int:
        return len(self._sums) - 1

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]

    def all(self, length: int) -> np.ndarray:
        """Hashes of all substrings of one length."""
        n = len(self) - length + 1
        if n <= 0:
            return np.zeros(0, U64)
        return (self._sums[length:] - self._sums[:n]) * self._down[:n]


class Blocks(NamedTuple):
    """Runs of windows with a common anchor."""

    anchor: np.ndarray  # place of the anchor
    first: np.ndarray   # place of the first window
    count: np.ndarray   # number of windows
    seed: np.ndarray    # hash of the anchor, as int64
    body: np.ndarray    # hash of all symbols of the block and the anchor's place in it, int64


def blocks(codes: np.ndarray, bounds: np.ndarray, window: int, seed: int) -> Blocks:
    """Blocks of texts ``codes[bounds[i]:bounds[i + 1]]``, in order of place."""
    rolling = Rolling(codes)
    hashes = mix(rolling.all(seed))
    width = window - seed + 1
    n = len(codes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Blocks(none, none, none, none, none)
    low = U64((1 << _ORDER_BITS) - 1)
    if len(codes) > int(low):
        raise ValueError("too many symbols for one call")
    least = (hashes & ~low) | np.arange(len(hashes), dtype=U64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        rest = width - span
        least = np.minimum(least[:-rest], least[rest:])
    least = least[:n]
    # The last window of a text starts ``window`` before its end.
    starts = bounds[:-1]
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    live = counts > 0
    edge = np.zeros(n + 1, np.int8)
    edge[starts[live]] += 1
    edge[(starts + counts)[live]] -= 1
    inside = np.cumsum(edge[:-1]).astype(bool)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(least[1:], least[:-1], out=change[1:])
    change[starts[live]] = True
    stop = np.zeros(n + 1, bool)
    stop[(starts + counts)[live]] = True
    first = np.flatnonzero(change & inside)
    cut = np.flatnonzero((change & inside) | stop[:n])
    cut = np.append(cut, n)
    count = cut[np.searchsorted(cut, first, side="right")] - first
    anchor = (least[first] & low).astype(np.int64)
    body = rolling.of(first, first + count + (window - 1))
    body = mix(body + (anchor - first).astype(U64) * U64(BASE) + count.astype(U64))
    return Blocks(anchor, first, count, hashes[anchor].view(np.int64), body.view(np.int64))
