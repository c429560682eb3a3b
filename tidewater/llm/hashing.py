"""Hashes of many substrings at once, from one running sum of the bytes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20)
#: A random odd number for each byte.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(1 << (n - 1).bit_length(), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes times the powers of the base."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data) + 1)[0][:-1], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xCA5A826395121157)
    h ^= h >> np.uint64(32)
    return h


def prefix_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each substring; equal substrings have equal hashes wherever they stand."""
    sums = prefix_sums(data)
    return mix((sums[end] - sums[first]) * powers(len(data) + 1)[1][first])
