"""A full-text index over the words of many documents: Burrows-Wheeler order, wavelet ranks, sampled positions.

The documents lie in a row, each followed by an end mark.  Words are numbered
in order of their hashes (1, 2, ...; 0 is the end mark).  Suffixes are sorted
by words, end marks by their place, so no comparison runs past a document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SAMPLE_EVERY = 8  # words between sampled positions of a document; its first word is always sampled


def suffix_order(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of ``codes`` in the order of the suffixes that start there; ``ends`` are the places of end marks (code 0).

    Sorts by as many words as fit into one number, then doubles the compared length for those still tied.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    rank = codes.astype(np.int64) + (len(ends) - 1)
    rank[ends] = np.arange(len(ends))
    bits = max(1, int(rank.max()).bit_length())
    length = max(1, 63 // bits)
    key = rank.copy()
    for j in range(1, length):
        key <<= bits
        key[: n - j] |= rank[j:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    spot = np.arange(n)
    while True:
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(fresh)
        rank[order[spot]] = spot[heads][np.cumsum(fresh) - 1]
        sizes = np.diff(np.append(heads, len(key)))
        spot = spot[np.repeat(sizes > 1, sizes)]
        if not len(spot):
            return order
        at = order[spot]
        key = rank[at] * n + rank[np.minimum(at + length, n - 1)]
        by = np.argsort(key, kind="stable")
        order[spot], key = at[by], key[by]
        length *= 2


def _bits(flags: np.ndarray) -> np.ndarray:
    """Flags as 64-bit numbers, with room for a rank at the very end."""
    raw = np.zeros((len(flags) // 64 + 1) * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    raw[: len(packed)] = packed
    return raw.view("<u8")


@dataclass
class RankedBits:
    words: np.ndarray
    before: np.ndarray = field(init=False)

    def __post_init__(self):
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place ``i``."""
        w, inside = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << inside) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of any symbol at any place of a sequence, one bit vector per bit of the symbols, highest first."""

    def __init__(self, levels: list[np.ndarray], zeros: np.ndarray):
        self.levels, self.zeros = [RankedBits(x) for x in levels], zeros

    @classmethod
    def of(cls, seq: np.ndarray, width: int) -> WaveletMatrix:
        levels, zeros = [], []
        for shift in range(width - 1, -1, -1):
            flags = ((seq >> shift) & 1).astype(bool)
            levels.append(_bits(flags))
            zeros.append(len(flags) - int(np.count_nonzero(flags)))
            seq = np.concatenate([seq[~flags], seq[flags]])
        return cls(levels, np.array(zeros, np.int64))

    def sink(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` lands on the lowest level for symbol ``codes``: the symbol's first place there plus its rank."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.rank(at)
            at = np.where((codes >> (len(self.levels) - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``at``, and where they land on the lowest level."""
        codes = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            one, ones = level.get(at), level.rank(at)
            codes = codes << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return codes, at


class FmIndex:
    """Counts and places of any phrase of the indexed words."""

    def __init__(self, keys: np.ndarray, below: np.ndarray, matrix: WaveletMatrix, marks: np.ndarray, samples: np.ndarray):
        self.keys, self.below, self.matrix, self.samples = keys, below, matrix, samples
        self.marks = RankedBits(marks)
        codes = np.arange(len(below) - 1)
        flipped = np.zeros_like(codes)
        for k in range(len(matrix.levels)):
            flipped |= ((codes >> k) & 1) << (len(matrix.levels) - 1 - k)
        by = np.argsort(flipped, kind="stable")
        sizes = np.diff(below)[by]
        self.lowest = np.empty(len(codes), np.int64)  # each symbol's first place on the lowest level
        self.lowest[by] = np.cumsum(sizes) - sizes

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray) -> FmIndex:
        """Index of documents that hold ``counts`` words each, whose hashes lie in a row."""
        keys, code = np.unique(hashes, return_inverse=True)
        n, first = len(hashes) + len(counts), np.cumsum(counts + 1) - (counts + 1)
        ends = first + counts
        text = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[ends] = False
        text[body] = code + 1
        order = suffix_order(text, ends)
        offset = np.arange(n) - np.repeat(first, counts + 1)
        sampled = (offset % SAMPLE_EVERY == 0)[order]
        below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(keys) + 1))])
        matrix = WaveletMatrix.of(text[order - 1].astype(np.int32), max(1, len(keys).bit_length()))
        return cls(keys, below, matrix, _bits(sampled), order[sampled])

    def dump(self) -> list[bytes]:
        levels = np.concatenate([x.words for x in self.matrix.levels])
        parts = [(self.keys, "<u8"), (self.below, "<i8"), (levels, "<u8"), (self.matrix.zeros, "<i8"), (self.marks.words, "<u8"), (self.samples, "<i4")]
        return [x.astype(kind).tobytes() for x, kind in parts]

    @classmethod
    def load(cls, parts: list) -> FmIndex:
        keys, below, levels, zeros, marks, samples = (
            np.frombuffer(x, kind) for x, kind in zip(parts, ("<u8", "<i8", "<u8", "<i8", "<u8", "<i4")))
        return cls(keys, below, WaveletMatrix(list(levels.reshape(len(zeros), -1)), zeros), marks, samples.astype(np.int64))

    def _back(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.below[codes] + self.matrix.sink(codes, at) - self.lowest[codes]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, from, to): rows of the suffix order that start with a phrase, for phrases that occur.

        ``phrases`` holds word hashes, one phrase a line; the last ``lengths`` entries of a line count.
        """
        width = phrases.shape[1]
        used = np.arange(width) >= (width - lengths)[:, None]
        spot = np.searchsorted(self.keys, phrases)
        known = np.zeros(phrases.shape, bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == phrases[inside]
        alive = np.flatnonzero((known | ~used).all(axis=1) & (lengths > 0))
        codes = spot[alive] + 1
        low, high = self.below[codes[:, -1]], self.below[codes[:, -1] + 1]
        for j in range(width - 2, -1, -1):
            step = np.flatnonzero(used[alive, j])
            if not len(step):
                break
            c = codes[step, j]
            both = self._back(np.concatenate([c, c]), np.concatenate([low[step], high[step]]))
            low[step], high[step] = both[: len(step)], both[len(step):]
            stay = low < high
            alive, codes, low, high = alive[stay], codes[stay], low[stay], high[stay]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix order: back, word by word, to the next sampled one."""
        places, open_, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(open_):
            at = self.marks.get(rows)
            places[open_[at]] = self.samples[self.marks.rank(rows[at])] + steps
            open_, rows = open_[~at], rows[~at]
            codes, low = self.matrix.read(rows)
            rows, steps = self.below[codes] + low - self.lowest[codes], steps + 1
        return places
