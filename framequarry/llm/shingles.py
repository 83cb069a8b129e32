"""Word shingles of whole texts as sorted 64-bit hash arrays, computed over bytes with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_CHUNK, _BASE = 1 << 18, 0x9E3779B97F4A7C15
_BYTES = np.arange(256)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + U(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n - 1, base, dtype=np.uint64))))


_UP, _DOWN = _powers(_BASE, _CHUNK), _powers(pow(_BASE, -1, 1 << 64), _CHUNK)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _hashes(data: bytes) -> np.ndarray:
    """Word hashes as differences of one running polynomial sum, shifted back to the word's start by the base's inverse."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1])
    if not len(edges):
        return np.empty(0, dtype=np.uint64)
    up, down = (_UP, _DOWN) if len(raw) <= _CHUNK else (_powers(_BASE, len(raw)), _powers(pow(_BASE, -1, 1 << 64), len(raw)))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[raw] * up[: len(raw)], out=sums[1:])
    starts, ends = edges[::2], edges[1::2]
    return scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))


def word_hashes(text: str | None) -> np.ndarray:
    """One hash for each word [^\\x20\\x09-\\x0D]+, with A-Z lower-cased, in order."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if len(data) <= _CHUNK:
        return _hashes(data)
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + _CHUNK)
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        parts.append(_hashes(data[at:to]))
        at = to
    return np.concatenate(parts)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all ``width``-word shingles; of fewer words the whole sequence; of none nothing."""
    w = word_hashes(text)
    if not len(w):
        return w
    take = min(width, len(w))
    n = len(w) - take + 1
    mixed = w[:n] + U(take)
    for j in range(1, take):
        mixed = mixed * U(0x9FB21C651E98DF25) + w[j : n + j]
    mixed = scramble(mixed)
    mixed.sort()
    new = np.ones(n, dtype=bool)
    np.not_equal(mixed[1:], mixed[:-1], out=new[1:])
    return mixed[new]


def digest(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a shingle set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)
