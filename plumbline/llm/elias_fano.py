"""Elias-Fano sequences and an n-gram trie over them, in flat arrays that can be memory-mapped.

A sequence of n increasing numbers below u keeps the low bits of each number
packed, and the high bits as a unary bit string: about 2 + log2(u / n) bits per number.
The trie has one sequence of words per level and one of pointers into the next
level.  The words below one node are made increasing over the whole level by
adding the last value of the node before, so a word is found by a search for
its successor relative to that value, inside the node's range.  Values are one
byte each, an index into a codebook of 256 means.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_AT_ONCE = 1 << 17  # questions answered at a time, to bound memory


class Sequence:
    """Increasing uint64 numbers; ``arrays`` is all there is to store."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.zeros = arrays["low"], arrays["high"], arrays["zeros"]
        self.n, self.bits = (int(x) for x in arrays["head"])
        self.arrays = arrays

    @classmethod
    def build(cls, values: np.ndarray) -> Sequence:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(bits)).astype(np.int64)
        length = (n + (top >> bits) + 2 + 63) // 64 * 64
        unary = np.zeros(length, np.uint8)
        unary[high + np.arange(n)] = 1
        words = np.packbits(unary, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))]).astype(np.uint32)
        return cls({"head": np.array([n, bits], np.int64), "low": _pack(values, bits), "high": words, "zeros": zeros})

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        rest = self.low[word + 1] << (np.uint64(63) - shift) << _ONE
        return ((self.low[word] >> shift) | rest) & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero of the unary string."""
        if ones:
            before = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        else:
            before = self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        left = (k - before[word]).astype(np.int64)
        bits = self.high[word] if ones else ~self.high[word]
        at = word * 64
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
            over = left >= count
            left -= np.where(over, count, 0)
            bits = np.where(over, bits >> np.uint64(width), bits)
            at += over * width
        return at

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._lows(i)

    def find(self, target: np.ndarray) -> np.ndarray:
        """Index of each target, or -1: its successor by high bits, then by bisection of the low bits."""
        out = np.full(len(target), -1, np.int64)
        if not self.n:
            return out
        target = target.astype(np.uint64)
        high = target >> np.uint64(self.bits)
        most = np.uint64(len(self.high) * 64 - self.n - 1)  # zeros there are
        ask = np.flatnonzero(high <= most)
        high = high[ask].astype(np.int64)
        low_part = target[ask] & np.uint64((1 << self.bits) - 1)
        hi = self._select(high, False) - high
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        end = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < low_part[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        inside = np.flatnonzero(lo < end)
        hit = inside[self._lows(lo[inside]) == low_part[inside]]
        out[ask[hit]] = lo[hit]
        return out


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    n = len(values)
    out = np.zeros(n * bits // 64 + 2, np.uint64)
    if bits and n:
        low = values & np.uint64((1 << bits) - 1)
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[heads]] = np.bitwise_or.reduceat(low << shift, heads)
        over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))  # at most one number spills out of a word
        out[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
    return out


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte per value and the codebook: means of 256 bins of equal width."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256)
    low, high = float(values.min()), float(values.max())
    code = np.minimum(((values - low) * (256 / max(high - low, 1e-12))).astype(np.int64), 255)
    total = np.bincount(code, values, 256)
    n = np.bincount(code, minlength=256)
    return code.astype(np.uint8), total / np.maximum(n, 1)


class Trie:
    """Levels of (word, value codes); a node's children lie between its pointers in the next level."""

    def __init__(self, arrays: dict[str, np.ndarray], depth: int):
        self.arrays, self.depth = arrays, depth
        part = lambda p: Sequence({k[len(p):]: v for k, v in arrays.items() if k.startswith(p)})
        self.words = [part(f"w{k}.") for k in range(depth)]
        self.pointers = [part(f"p{k}.") for k in range(depth - 1)]

    @classmethod
    def build(cls, levels: list[tuple[np.ndarray, np.ndarray]], values: list[dict[str, np.ndarray]]) -> Trie:
        """``levels[k]``: the parent index in level k - 1 and the word of each node, sorted by both; level 0 has no parents."""
        arrays = {}
        for k, (parent, word) in enumerate(levels):
            word = word.astype(np.uint64)
            if k:
                above = len(levels[k - 1][1])
                ends = np.cumsum(np.bincount(parent, minlength=above))
                arrays |= {f"p{k - 1}.{n}": a for n, a in Sequence.build(np.concatenate([[0], ends])).arrays.items()}
                last = np.zeros(above, np.uint64)
                full = np.flatnonzero(np.diff(ends, prepend=0))
                last[full] = word[ends[full] - 1] + _ONE
                base = np.concatenate([[np.uint64(0)], np.cumsum(last, dtype=np.uint64)[:-1]])
                word = word + base[parent]
            arrays |= {f"w{k}.{n}": a for n, a in Sequence.build(word).arrays.items()}
            for name, v in values[k].items():
                arrays[f"v{k}.{name}"], arrays[f"b{k}.{name}"] = quantise(v)
        return cls(arrays, len(levels))

    def child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index in ``level`` of ``word`` below node ``parent`` of the level above; -1 when there is none."""
        out = np.empty(len(word), np.int64)
        for a in range(0, len(word), _AT_ONCE):
            some = slice(a, a + _AT_ONCE)
            out[some] = self.words[0].find(word[some]) if level == 0 else self._child(level, parent[some], word[some])
        return out

    def _child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(parent), -1, np.int64)
        ask = np.flatnonzero(parent >= 0)
        if not len(ask):
            return out
        p = parent[ask]
        begin, end = (self.pointers[level - 1].access(p + d).astype(np.int64) for d in (0, 1))
        base = np.zeros(len(ask), np.uint64)
        later = np.flatnonzero(begin > 0)
        base[later] = self.words[level].access(begin[later] - 1) + _ONE
        at = self.words[level].find(base + word[ask].astype(np.uint64))
        out[ask] = np.where((at >= begin) & (at < end), at, -1)
        return out

    def value(self, level: int, name: str, at: np.ndarray) -> np.ndarray:
        return self.arrays[f"b{level}.{name}"][self.arrays[f"v{level}.{name}"][at]]

    def to_bytes(self) -> bytes:
        """All arrays in one buffer, each at a multiple of 64 bytes, after a directory."""
        names, parts, at = [], [], 0
        for name, a in self.arrays.items():
            raw = np.ascontiguousarray(a).tobytes()
            names.append(f"{name} {a.dtype.str} {len(a)} {at}")
            parts.append(raw + b"\0" * (-len(raw) % 64))
            at += len(parts[-1])
        directory = (f"{self.depth}\n" + "\n".join(names) + "\n").encode()
        directory += b" " * (-(len(directory) + 8) % 64)
        return len(directory).to_bytes(8, "little") + directory + b"".join(parts)

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        """Over bytes, an mmap or a np.memmap; nothing is copied."""
        raw = np.frombuffer(buffer, np.uint8)
        size = int.from_bytes(raw[:8].tobytes(), "little")
        lines = raw[8: 8 + size].tobytes().decode().split("\n")
        arrays = {}
        for line in lines[1:]:
            if line.strip():
                name, kind, n, at = line.split()
                arrays[name] = np.frombuffer(raw, np.dtype(kind), int(n), 8 + size + int(at))
        return cls(arrays, int(lines[0]))
