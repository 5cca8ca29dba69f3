"""Hashed word shingles, their sets, and MinHash symbols, on bytes of many texts at once."""

from __future__ import annotations

import functools

import numpy as np

from tessella.llm.words import INVERSE, powers

WORDS = 5
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@functools.cache
def random_bytes() -> np.ndarray:
    """A fixed random number for each byte, upper-case ASCII as lower-case, 0 for white space."""
    out = np.random.default_rng(20240201).integers(1, 1 << 64, 256, np.uint64)
    out[65:91] = out[97:123]
    out[BLANK] = 0
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is faster than np.unique's hash table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def size_class(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the texts' offsets among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = BLANK[data]
    begins = ~blank
    first = offsets[:-1][offsets[:-1] < len(data)]
    inner = begins[1:] & ~blank[:-1]
    begins[1:] &= ~inner
    begins[first] |= ~blank[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    n = size_class(len(data))
    sums = np.add.reduceat(random_bytes()[data] * powers(n)[: len(data)], starts)
    return mixed(sums * powers(n, INVERSE)[starts]), np.searchsorted(starts, offsets)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text with fewer words has one, of all of them; without words, none."""
    hashes, ends = word_hashes(offsets, data)
    weights = powers(65_536, 0xD6E8FEB86659FD93)[1 : words + 1]
    n = len(hashes) - words + 1
    if n > 0:
        sums = hashes[:n] * weights[0]
        for j in range(1, words):
            sums += hashes[j : n + j] * weights[j]
        sums = mixed(sums)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(distinct(sums[a : b - words + 1]))
        elif b > a:
            out.append(mixed(np.array([(hashes[a:b] * weights[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@functools.cache
def families(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240301)
    return rng.integers(0, 1 << 64, k, np.uint64)[:, None], (rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def minhash(shingles: np.ndarray, k: int) -> np.ndarray:
    """k symbols of 32 bits of a set that isn't empty."""
    add, times = families(k)
    low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1 << 14):
        part = shingles[None, i : i + (1 << 14)] ^ add
        part *= times
        np.minimum(low, part.min(1), out=low)
    return (mixed(low) >> np.uint64(32)).astype(np.uint32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 x the common shingles are at least percent x those of either, of two sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)
