"""Ids of distinct words, kept flat, and their expansion for words in a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

REMEMBERED = 2_000_000  # distinct words a task keeps before it starts afresh (a matter of speed alone)


class IdStore:
    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.keys, self.code = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def expand(self, hashes: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row and where each word's begin (and the end).

        ``learn`` gets the places of words not seen yet and returns their ids in a row and how many each has.
        """
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.__init__(self.most)
        spot = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == distinct[inside]
        if not known.all():
            flat, size = learn(at[~known])
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.flat = np.concatenate([self.flat, flat])
            # both are sorted: the new keys go where the search found their places
            self.code = np.insert(self.code, spot[~known], len(self.size) + np.arange(len(size)))
            self.keys = np.insert(self.keys, spot[~known], distinct[~known])
            self.size = np.concatenate([self.size, size])
        if not len(hashes):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        code = self.code[np.searchsorted(self.keys, distinct)][back]
        return spread(self.flat, self.begin[code], self.size[code])


def spread(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices flat[begin : begin + size] in a row, and where each begins (and the end)."""
    upto = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], size)], upto
