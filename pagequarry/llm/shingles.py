"""Sets of word shingles as sorted arrays of 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

from pagequarry.llm.arrow import steps

WORDS = 5
#: Words are runs of bytes other than these; UTF-8 never has them inside a character.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20_260_101)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]


def _powers(n: int) -> np.ndarray:
    while len(_POWERS[0]) < n:
        p = _POWERS[0]
        _POWERS[0] = np.concatenate([p, p * (p[-1:] * _BASE)])
    return _POWERS[0]


def scrambled(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order; another one for each seed."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text)."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    is_word = ~_IS_SPACE[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = is_word[edges]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    owner = np.cumsum(begins, dtype=np.int32) - 1
    place = np.arange(len(data), dtype=np.int64) - start[np.maximum(owner, 0)]
    place[~is_word] = 0
    part = _BYTE[_LOWER[data]] * _powers(int(place.max()) + 1)[place]
    part[~is_word] = 0
    return scrambled(np.add.reduceat(part, start)), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text with a word."""
    for first, last in steps(offsets):
        at = offsets[first : last + 1]
        words, before = word_hashes(data[at[0] : at[-1]], at - at[0])
        if not len(words):
            continue
        padded = np.concatenate([words, np.zeros(WORDS - 1, np.uint64)])
        whole = sum(padded[k : k + len(words)] * _PLACE[k] for k in range(WORDS))
        whole = scrambled(whole, 1)
        bounds = before.tolist()
        for row in range(last - first):
            a, b = bounds[row], bounds[row + 1]
            if b - a >= WORDS:
                found = np.sort(whole[a : b - WORDS + 1])
                if len(found) > 1:
                    found = found[np.append(True, found[1:] != found[:-1])]
                yield first + row, found
            elif b > a:
                short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)
                yield first + row, scrambled(np.array([short]), 2 + b - a)


def set_key(shingles: np.ndarray) -> int:
    """A 63-bit name of a set: equal sets have equal names."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little") >> 1
