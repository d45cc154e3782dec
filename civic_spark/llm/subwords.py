"""Hashed character n-grams of words, whole blocks of words at a time."""

from __future__ import annotations

import string

import numpy as np

#: Multiplier of the rolling hash and of its last mix (odd 64-bit constants).
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def different_words(text: str | None) -> set[str]:
    """The different words of a whole text: lower case, cut at white space, ASCII signs at their ends taken off. NULL has none."""
    found = {w.strip(string.punctuation) for w in set(text.lower().split())} if text else set()
    found.discard("")
    return found


def _mixed(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return ((h ^ (h >> np.uint64(29))) % np.uint64(buckets)).astype(np.int32)


def grams(words: list[str], buckets: int, sizes: tuple[int, int] = (3, 6)) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each word, and the number of them a word: ``(all buckets in word order, counts)``.

    A word stands between two marks, so its start and end count; it has its n-grams of ``sizes`` characters and itself as a
    whole. Every word has at least itself, so no count is zero.
    """
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    signs = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    home = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(starts + lengths, lengths) - np.arange(len(signs))
    found, owner = [], []
    h = np.zeros(len(signs), np.uint64)
    for n in range(1, sizes[1] + 1):
        # hash of the n signs from each place on; places too near the end of their word are left out
        h = h[: len(signs) - n + 1] * _BASE + signs[n - 1 :] + np.uint64(1)
        if n >= sizes[0]:
            fits = np.flatnonzero(room[: len(h)] >= n)
            found.append(_mixed(h[fits] + np.uint64(n), buckets))
            owner.append(home[fits])
    # the whole word: sum of its signs by place, apart from the n-grams by another start
    place = np.arange(len(signs)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    whole = np.add.reduceat(signs * powers[place], starts)
    found.append(_mixed(whole + np.uint64(1 << 40), buckets))
    owner.append(np.arange(len(words)))
    owner_, found_ = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner_, kind="stable")
    return found_[order], np.bincount(owner_, minlength=len(words)).astype(np.int64)
