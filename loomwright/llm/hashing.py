"""64-bit hashes of many spans of a text at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of text[begin:end] for each pair: differences of prefix sums of a polynomial modulo 2^64."""
    base = int(begin[0])
    part = text[base : int(end[-1])]
    power = np.full(len(part) + 1, MULTIPLIER, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    prefix = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_byte_values()[part] * power[:-1], out=prefix[1:])
    # times the inverse power of where it begins, so that equal spans have equal hashes wherever they stand
    power[1:] = INVERSE
    np.cumprod(power, out=power)
    return mixed((prefix[end - base] - prefix[begin - base]) * power[begin - base] + (end - begin).astype(np.uint64) * MULTIPLIER)
