"""Polynomial hashes of spans of bytes, modulo 2 ** 64, from prefix sums."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64)]
_INVERSE = [np.ones(1, np.uint64)]


def _powers(kept: list[np.ndarray], base: int, n: int) -> np.ndarray:
    while len(kept[0]) < n:
        kept[0] = np.concatenate([kept[0], kept[0] * np.uint64(pow(base, len(kept[0]), 1 << 64))])
    return kept[0][:n]


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Sums of ``(byte + 1) * base ** place`` before each place, and at the end."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_POWERS, _BASE, len(b)))])


def span_sums(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each span, whose bytes alone it depends on."""
    return (sums[end] - sums[first]) * _powers(_INVERSE, pow(_BASE, -1, 1 << 64), len(sums))[first]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
