"""Hashes of stretches of bytes in numpy; few imports, as every Python worker has them."""

from __future__ import annotations

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    out[1:] = PRIME
    return np.multiply.accumulate(out)


def prefix_hashes(raw: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte values times powers, and the powers: hashes of any stretch by subtraction."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 3))[raw]
    power = powers(len(raw))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:-1])]), power


def span_hash(sums: np.ndarray, inverse: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes begin to end wherever they stand."""
    return mixed((sums[end] - sums[begin]) * inverse[begin])


_inverse = np.uint64(pow(int(PRIME), -1, 2**64))


def inverse_powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _inverse, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)
