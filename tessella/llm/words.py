"""Byte-level BPE over the distinct words of a chunk of texts.

A text splits into words by the usual byte-level pattern (letters, digits, other marks, each with one space before;
contractions; white space). Ids depend on the word alone, so each distinct word is encoded once and its ids are
gathered for every occurrence. Splitting works on arrays of code points, not on one match at a time.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd

from tessella.llm.common import codes_of

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Unicode White_Space.
WHITE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
MULT = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULT, -1, 1 << 64)


@functools.cache
def classes() -> np.ndarray:
    kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = LETTER
        elif k == "N":
            kind[c] = NUMBER
    kind[list(WHITE)] = SPACE
    return kind


@functools.cache
def random_codes() -> np.ndarray:
    """A fixed random 64-bit number for each code point."""
    return np.random.default_rng(20240117).integers(0, 1 << 64, sys.maxunicode + 1, np.uint64)


@functools.lru_cache(4)
def powers(n: int, base: int = MULT) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def power_table(n: int) -> np.ndarray:
    return powers(1 << max(16, int(n).bit_length()))[:n]


def word_starts(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions where words begin, for texts that begin at offsets[:-1]."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first[n] = True
    begins = np.empty(n, bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= first[:n]
    last_space = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    begins[last_space] = True
    begins[last_space[codes[last_space] == 32] + 1] = False
    quote = np.flatnonzero((codes == 39) & begins)
    if len(quote):
        padded = np.concatenate([codes, np.zeros(3, np.uint32)])
        ends = np.concatenate([first, np.ones(3, bool)])
        a, b = padded[quote + 1], padded[quote + 2]
        inside = ~ends[quote + 1]
        one = inside & np.isin(a, [ord(x) for x in "stmd"])
        two = inside & ~ends[quote + 2] & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        begins[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        begins[after[after < n]] = True
    return np.flatnonzero(begins)


def word_hashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits of each word: a polynomial of random numbers for its code points."""
    weighted = random_codes()[codes] * power_table(len(codes))
    sums = np.add.reduceat(weighted, starts)
    back = powers(1 << max(16, int(len(codes)).bit_length()), INVERSE)[starts]
    h = sums * back
    return h ^ (h >> np.uint64(29))


class Encoder:
    """Ids of whole texts by way of a cache of distinct words.

    encode_words gets new distinct words as strings and gives their ids as one flat list with the counts. The cache
    holds at most `most_words` words and starts afresh beyond that, so memory is bounded; results don't depend on it.
    Two words share a hash with a chance of about 2**-64 a pair.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most_words: int = 1_500_000):
        self.encode_words, self.most_words = encode_words, most_words
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """keys: sorted and new."""
        if len(self.keys) + len(keys) > self.most_words:
            self.clear()
        flat, count = self.encode_words(words)
        begin = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.count = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (uint32) of all texts and the texts' offsets among them."""
        codes, ends = codes_of(offsets, data)
        starts = word_starts(codes, ends)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        slot, seen = pd.factorize(word_hashes(codes, starts))
        first = np.empty(len(seen), np.int64)
        first[slot[::-1]] = np.arange(len(slot) - 1, -1, -1)
        order = np.argsort(seen)
        keys = seen[order]
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if len(self.keys) + int((~known).sum()) > self.most_words:
            self.clear()
            known[:] = False
        if not known.all():
            new = first[order[~known]]
            stops = np.append(starts, len(codes))
            self.learn(keys[~known], [codes[starts[i] : stops[i + 1]].tobytes().decode("utf-32-le", "surrogatepass") for i in new])
        at = np.searchsorted(self.keys, keys)
        begin, count = np.empty(len(seen), np.int64), np.empty(len(seen), np.int64)
        begin[order], count[order] = self.begin[at], self.count[at]
        begin, count = begin[slot], count[slot]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, ends)]


@functools.cache
def unassigned() -> np.ndarray:
    """Code points without a category here: the library may know newer ones and split words there in another way."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


class WholeTexts(Encoder):
    """An encoder that gives texts to the library whole where words alone don't decide their ids.

    These are texts that hold an added token of the tokenizer or an unassigned code point; encode_texts gives their ids.
    """

    def __init__(self, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_texts: Callable[[list[str]], list[list[int]]], added: list[bytes]):
        super().__init__(encode_words)
        self.encode_texts, self.added = encode_texts, added

    def whole(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Which texts go to the library whole."""
        found, raw = np.zeros(len(offsets) - 1, bool), data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                found[k] |= at + len(token) <= offsets[k + 1]
                at = raw.find(token, at + 1)
        codes, ends = codes_of(offsets, data)
        if len(codes) > 0 and codes.max() > 0x377:  # the first unassigned one is 0x378
            found[np.searchsorted(ends, np.flatnonzero(unassigned()[codes]), "right") - 1] = True
        return found

    def __call__(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.whole(offsets, data)
        if not found.any():
            return super().__call__(offsets, data)
        sizes, raw = np.diff(offsets), data.tobytes()
        texts = [raw[offsets[k] : offsets[k + 1]].decode("utf-8", "surrogatepass") for k in np.flatnonzero(found)]
        ids, ends = super().__call__(np.concatenate([[0], np.cumsum(np.where(found, 0, sizes))]), data[~np.repeat(found, sizes)])
        got, count = self.encode_texts(texts), np.diff(ends)
        count[found] = [len(x) for x in got]
        here = np.repeat(found, count)
        out = np.empty(len(here), np.uint32)
        out[~here] = ids
        out[here] = np.concatenate([np.array(x, np.uint32) for x in got])
        return out, np.concatenate([[0], np.cumsum(count)])


@functools.cache
def library_encoder(path: str, added_tokens: bool = False) -> Encoder:
    """An encoder that asks the tokenizers library for each distinct word.

    With added_tokens the ids are those of the library's default call, in which the file's added tokens stand for
    themselves; else these are split like other text.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added_tokens

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        count = np.empty(len(words), np.int64)
        for i in range(0, len(words), 4096):
            got = [x.ids for x in tokenizer.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
            count[i : i + len(got)] = [len(x) for x in got]
            for x in got:
                flat += x
        return np.array(flat, np.uint32), count

    if not added_tokens:
        return Encoder(encode)
    added = [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()]
    return WholeTexts(encode, lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], added)
