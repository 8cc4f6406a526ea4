"""Names of windows of ids, by prefix doubling inside a batch."""

from __future__ import annotations

import numpy as np


def _pair(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    """A name for each pair of names (multiply, add and shift, modulo 2**64)."""
    h = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_names(ids: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """Names of ids[start:end], by prefix doubling: level k names all 2**k-line windows."""
    size = end - start
    level = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    out = np.zeros(len(start), dtype=np.uint64)
    names = ids
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            if len(names) <= half:
                break
            names = _pair(names[:-half], names[half:], salt)
        here = level == k
        first, last = names[start[here]], names[end[here] - (1 << k)]
        out[here] = _pair(first, last, salt ^ 0x5851F42D4C957F2D) + size[here].astype(np.uint64)
    return out
