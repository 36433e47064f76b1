"""Word spans and 64-bit word hashes of whole texts, vectorised over blocks.

A word is a maximal run of bytes other than space and 0x09-0x0D. UTF-8
continuation bytes are never white space, so working on bytes gives the same
words as working on code points. The hash of a word is a polynomial in a fixed
odd 64-bit base over a fixed random byte table, mixed at the end; two different
words of a corpus share one with a chance of about n^2 / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES[_SPACE] = 0
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_powers = powers(64)


def _base_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = powers(max(n, 2 * len(_powers)))
        if n > 1 << 16:
            return grown[:n]
        _powers = grown
    return _powers


def spans(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of ``data``."""
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    width = np.diff(np.append(starts, len(buf)))
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, width)
    # white space adds 0, so its place may be clipped to the longest word
    longest = int((ends - starts).max())
    np.minimum(place, longest - 1, out=place)
    terms = (_LOWER if lower else _BYTES)[buf[starts[0] :]] * _base_powers(longest)[place]
    sums = np.add.reduceat(terms, starts - starts[0])
    return starts, ends, mix(sums + (ends - starts).astype(np.uint64))


def blocks(texts: list[bytes | None], lower: bool = False) -> Iterator[tuple]:
    """Yield (first index, data, starts, ends, hashes, bounds) for runs of whole
    texts of about BLOCK_BYTES: text ``first + i`` has the words
    ``bounds[i]:bounds[i + 1]``, whose spans point into ``data``.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") <= BLOCK_BYTES):
            size += len(texts[j] or b"")
            j += 1
        part = [t or b"" for t in texts[i:j]]
        data = b"\n".join(part)
        starts, ends, hashes = spans(data, lower)
        offsets = np.cumsum([0] + [len(t) + 1 for t in part])
        yield i, data, starts, ends, hashes, np.searchsorted(starts, offsets)
        i = j


def rolling(hashes: np.ndarray, width: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """Hash of every ``width`` consecutive items (none if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(width, np.uint64(base))):
        total += hashes[j : j + n] * p
    return mix(total)
