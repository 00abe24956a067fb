"""Word shingles of texts as sets of 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
C1, C2, C3 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, sizes: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) of texts laid end to end.

    A word's hash is the sum of its bytes, each times a random number of its place in the word.
    """
    solid = ~SPACES[data]
    offsets = np.cumsum(sizes) - sizes
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    first = offsets[(sizes > 0)]
    opens[first] = solid[first]
    at = np.flatnonzero(solid)
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    rank = np.cumsum(opens)[at] - 1
    place = at - starts[rank]
    numbers = scrambled(np.arange(1, place.max() + 2, dtype=np.uint64) * C1)
    values = data[at]
    if lower:
        values = np.where((values >= 65) & (values <= 90), values + 32, values)
    sums = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * numbers[place], np.flatnonzero(place == 0))
    before = np.searchsorted(starts, np.append(offsets, len(data)))
    return scrambled(sums), np.diff(before)


def shingle_sets(data: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes text by text, number of them of each text).

    Shingles are `width` words; a text with fewer words has all of them as one; without words, none.
    """
    hashes, counts = word_hashes(data, sizes)
    offsets = np.cumsum(counts) - counts
    short = (counts > 0) & (counts < width)
    numbers = np.where(counts >= width, counts - width + 1, short.astype(np.int64))
    owner = np.repeat(np.arange(len(sizes)), numbers)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(numbers) - numbers, numbers)
    at = offsets[owner] + within
    value = np.full(len(owner), np.uint64(width), np.uint64)
    for k in range(width):
        inside = k < counts[owner] - within
        step = scrambled(value * C1 + hashes[np.minimum(at + k, max(len(hashes) - 1, 0))])
        value = np.where(inside, step, value + C1)
    for a, b in zip((np.cumsum(numbers) - numbers).tolist(), np.cumsum(numbers).tolist(), strict=True):
        value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=len(sizes))
