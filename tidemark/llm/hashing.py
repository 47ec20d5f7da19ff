"""Polynomial prefix hashes of byte arrays, modulo 2^64, as numpy operations."""
from __future__ import annotations

import functools

import numpy as np

#: An odd base, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); tables come in sizes of powers of two, so a worker keeps few of them."""
    return _powers(base, 1 << max(16, int(n - 1).bit_length()))[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S[i] = sum of (byte + 1) * BASE^j over j < i."""
    out = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(BASE, len(data)) if len(data) else np.uint64(1)
    np.cumsum(terms, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of data[start:stop] for arrays of bounds: equal bytes give equal hashes wherever they stand."""
    out = prefix[stop] - prefix[start]
    out *= powers(INVERSE, len(prefix))[start]
    return out


def gram_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` bytes, by start."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = prefix[width:] - prefix[:n]
    out *= powers(INVERSE, n)
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread a polynomial hash over all bits (in place)."""
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h
