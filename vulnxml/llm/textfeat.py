"""Numpy text features used inside tasks. Words are runs of bytes other than
space and \\t \\n \\v \\f \\r; all hashes are fixed, so every worker agrees."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_C3 = np.uint32(2654435761)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class WordHasher:
    """64-bit polynomial hashes of all words of a text, from one prefix sum."""

    def __init__(self) -> None:
        self.size = 0

    def __call__(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of every word of the UTF-8 bytes ``b``."""
        n = len(b)
        if n >= self.size:
            self.size = max(2 * n, 1 << 14)
            self.pow, self.inv = _powers(_R, self.size + 1), _powers(_R_INV, self.size + 1)
        space = np.ones(n + 2, bool)
        space[1:-1] = _SPACE[b]
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.pow[:n], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * self.inv[starts]
        h ^= h >> np.uint64(29)
        h *= _MIX
        return h ^ (h >> np.uint64(32)), starts, ends


def trigram_buckets(b: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of every byte trigram (one per start; fewer than 3 bytes: none)."""
    if len(b) < 3:
        return np.zeros(0, np.int64)
    w = b.astype(np.uint32)
    g = (w[:-2] << np.uint32(16)) | (w[1:-1] << np.uint32(8)) | w[2:]
    return ((g * _C3) >> np.uint32(32 - bits)).astype(np.int64)


def word_buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
