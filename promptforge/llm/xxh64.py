"""XXH64 of many byte ranges at once (the published algorithm, in numpy)."""

from __future__ import annotations

import numpy as np
import xxhash

from promptforge.llm.common import Words

# fixed values of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(words: Words, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned hashes of ``words.buf[start[i]:end[i]]``.  Ranges under 32
    bytes (nearly all shingles) are hashed together; longer ones one by one."""
    size = (end - start).astype(np.int64)
    h = np.uint64(seed) + _P5 + size.astype(np.uint64)
    at, left = start.astype(np.int64).copy(), size.copy()
    for _ in range(3):  # lanes of 8 bytes
        on = np.flatnonzero((left >= 8) & (size < 32))
        if not len(on):
            break
        k = _rotl(words.load8(at[on]) * _P2, 31) * _P1
        h[on] = _rotl(h[on] ^ k, 27) * _P1 + _P4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero((left >= 4) & (size < 32))
    k = (words.load8(at[on]) & np.uint64(0xFFFFFFFF)) * _P1
    h[on] = _rotl(h[on] ^ k, 23) * _P2 + _P3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):  # single bytes
        on = np.flatnonzero((left >= 1) & (size < 32))
        h[on] = _rotl(h[on] ^ (words.buf[at[on]].astype(np.uint64) * _P5), 11) * _P1
        at[on] += 1
        left[on] -= 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    buf = words.buf.data
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(buf[start[i]:end[i]], seed)
    return h
