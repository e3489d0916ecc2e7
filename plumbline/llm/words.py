"""Words of many texts at once, by array arithmetic over the bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D.  Words get 64-bit
hashes from running sums over the bytes, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept for the next call in the same task."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _POWERS[int(base)] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


@dataclass
class Words:
    """``starts``/``ends``: bytes of each word in ``data``; text i has the words first[i] to first[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    text_at: np.ndarray  # byte at which each text begins

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, *prefixes: int) -> list[np.ndarray]:
        """Hash of every word, then of its first k bytes for each of ``prefixes``."""
        n = len(self.data)
        terms = _OF_BYTE[self.data]
        terms *= _powers(_P, n)
        upto = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(terms, out=upto[1:])
        back = _powers(_P_INVERSE, n + 1)[self.starts]
        base = upto[self.starts]
        ends = [self.ends, *(np.minimum(self.starts + k, self.ends) for k in prefixes)]
        return [mix((upto[e] - base) * back + np.uint64(i)) for i, e in enumerate(ends)]


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) pieces of a string column of about ``most`` bytes; null becomes empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = np.cumsum(np.asarray(pc.binary_length(texts), dtype=np.int64))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


# ends a word for readers that want bare words: every ASCII byte that is no letter or digit
BARE = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def tokenise(texts: pa.Array, lower: bool = False, breaks: np.ndarray = _SPACE) -> Words:
    """Words of a large_string column without nulls (see ``byte_slices``), cut at the bytes marked in ``breaks``."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[begin:end] if raw is not None else np.zeros(0, dtype=np.uint8)
    at = offsets - begin
    inside = ~breaks[data]
    fresh = np.ones(len(data), dtype=bool)  # the byte before belongs to no word of the same text
    fresh[1:] = ~inside[:-1]
    fresh[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(inside & fresh)
    last = np.ones(len(data), dtype=bool)
    last[:-1] = fresh[1:] | ~inside[1:]
    ends = np.flatnonzero(inside & last) + 1
    return Words(_LOWER[data] if lower else data, starts, ends, np.searchsorted(starts, at), at)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i..i+k-1 for every i, across text borders (callers mask those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    upto = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _powers(_P, len(words)), out=upto[1:])
    return mix((upto[k:] - upto[:-k]) * _powers(_P_INVERSE, n) + np.uint64(k))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Indices of the words at which a window of k words of one text starts."""
    n = int(first[-1])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return np.flatnonzero(room >= k)
