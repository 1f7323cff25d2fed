"""MinHash signatures of sets laid end to end, by random affine permutations of the 32-bit ring, in vectorised numpy."""

from __future__ import annotations

import numpy as np


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd, so that each map is a permutation) and offsets."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    """uint32 values, their bits well spread."""
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x7FEB352D)
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def signatures(elements: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(sets, permutations) minima; set i is elements[offsets[i]:offsets[i + 1]], none empty. Repeats do not matter."""
    out = np.empty((len(a), len(offsets)), np.uint32)
    buffer = np.empty_like(elements)
    for k in range(len(a)):
        np.multiply(elements, a[k], out=buffer)
        np.add(buffer, b[k], out=buffer)
        np.minimum.reduceat(buffer, offsets, out=out[k])
    return np.ascontiguousarray(out.T)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) signed 64-bit keys of the bands of so many rows; the band's number is part of its key."""
    sets, n = signature.shape
    bands = signature.reshape(sets, n // rows, rows)
    h = np.broadcast_to(np.arange(1, n // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (sets, n // rows)).copy()
    for j in range(rows):
        h ^= bands[:, :, j]
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)
