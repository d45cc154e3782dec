"""Hashes of words and of runs of words, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """Seeded odd 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U, count=len(words))


def runs(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the ``k`` words from each position; the last ``k - 1`` positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out = np.zeros(n, _U)
    for j, c in enumerate(numbers(k, seed)):
        out += h[j : j + n] * c
    return mixed(out)
