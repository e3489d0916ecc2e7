"""Scores texts with a smoothed trigram model that is kept as Elias-Fano tries, one per shard of the vocabulary.

The model: counts c of the training documents; P(w) takes a discount from every
known word and gives it to the one class of unknown words; given the two words u v before,

    P(w | u v) = (A c(u v w) + c(v w) + M(v) P(w)) / (A c(u v) + c(v) + M(v)),   M(v) = SCALE (1 + c'(v)) ** POWER

which sums to one over the known words and the unknown class.  c'(v) is v's own
count, rounded to a level of one byte.  Frequent words' counts are known to
every task; those of all others are summed over the corpus and sent to just the
shards in which the word is a context.  The numerator depends on counts of n-grams that end in w, the
denominator on those that end in v, the word before: every occurrence (u, v, w)
goes to the shard of its last word, which adds w's numerator and the
denominator that w is the context of, and texts sum what the shards say.

In a shard the trie runs from the last word to the words before it.  Its
levels hold the logarithms above as one-byte codes; an occurrence walks down
as far as the trie knows it.  A word with a large share of all tokens is
split over shards by the word before it.

Defined results: a null or empty text has the end token alone; rows are scored
one by one, repeated rows alike; a null doc_id is not held out; with no training
document every word is unknown.  Extra columns are ignored.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.elias_fano import Trie
from plumbline.llm.sizing import pieces, text_size
from plumbline.llm.words import byte_slices, mix, tokenise

A, SCALE, POWER = 4.0, 1.0, 0.75
_OFTEN = 256  # words with more than one in _OFTEN tokens of a shard are known to every task
_SHARD_BYTES = 10 << 20
_UNIT_BYTES = 14 << 20  # texts that are coded together in a task
# words are told apart by the upper 56 bits of their hashes, contexts within a shard by the upper 40: that is what travels
_MASK = np.uint64(0xFFFFFFFFFFFFFF00)
_SHORT = np.uint64(0xFFFFFFFFFF000000)
_END, _START = (np.uint64(x) for x in (0x51ED270B7A1C9E00, 0x2545F4914F6CDD00))
_LOG_STEP = 8.0  # levels of a count per factor of e
_BASE_BITS, _SCORE_BITS = 32, 24  # binary places of a shard's sums for a text


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with the end token after each text, and where each text begins (and the end)."""
    hashes, counts = [], []
    for _, piece in byte_slices(texts):
        w = tokenise(piece, lower=True)
        hashes.append(w.hashes()[0] & _MASK)
        counts.append(w.counts())
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(int(first[-1]), _END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    return out, first


def _slice_of(words: np.ndarray, slices: int) -> np.ndarray:
    """Slice of the vocabulary that counts each word; it grows with the hash."""
    return ((words >> np.uint64(42)).astype(np.int64) * slices) >> 22


def _level(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(np.log1p(count) * _LOG_STEP), 255).astype(np.uint8)


def _vocabulary_counts(shards: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = _tokens(batch.column("text"))
            keys, n = np.unique(words, return_counts=True)
            bounds = np.searchsorted(_slice_of(keys, shards), np.arange(shards + 1))
            used = np.flatnonzero(np.diff(bounds))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(used, pa.int32()), "docs": pa.array([batch.num_rows if i == 0 else 0 for i in range(len(used))], pa.int64()),
                "body": pa.array([_squeeze(_hash_bytes(keys[bounds[s]: bounds[s + 1]], 5) + _planes(n[bounds[s]: bounds[s + 1]].astype("<u4")))
                                  for s in used], pa.binary())})

    return step


def _vocabulary_slice(top: int):
    """Totals of a slice of the vocabulary and its most frequent words."""

    def step(key: tuple, rows: pa.Table) -> pa.Table:
        keys, counts = [], []
        for body in rows.column("body"):
            raw = _unpack(body.as_py())
            k = len(raw) // 11
            keys.append(_hashes(raw[: 7 * k], 5))
            counts.append(_from_planes(raw[7 * k:], np.dtype("<u4")))
        words, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        often = np.argsort(-count, kind="stable")[:top]
        return pa.table({"types": pa.array([len(words)], pa.int64()), "tokens": pa.array([int(count.sum())], pa.int64()),
                         "single": pa.array([int((count == 1).sum())], pa.int64()),
                         "docs": pa.array([sum(rows.column("docs").to_pylist())], pa.int64()),
                         "often": pa.array([words[often].tobytes() + count[often].tobytes()], pa.binary())})

    return step


class Facts:
    """What every task knows: totals, the frequent words and the hot ones among them, with their counts."""

    def __init__(self, types: int, tokens: int, single: int, docs: int, often: np.ndarray, often_count: np.ndarray, hot: np.ndarray, hot_count: np.ndarray):
        self.types, self.tokens, self.single, self.docs = types, tokens, single, docs
        self.often, self.often_count, self.hot, self.hot_count = often, often_count, hot, hot_count

    def parts(self) -> tuple:
        return self.types, self.tokens, self.single, self.docs, self.often, self.often_count, self.hot, self.hot_count

    def spread(self, level: np.ndarray) -> np.ndarray:
        """M(v) by the level of v's count."""
        return SCALE * (1 + np.expm1(level / _LOG_STEP)) ** POWER

    def spread_at_start(self) -> float:
        return SCALE * (1 + self.docs) ** POWER

    def chance(self, count: np.ndarray) -> np.ndarray:
        """P(w) by the word's count; 0 is the unknown class."""
        if not self.tokens:
            return np.ones(len(count))
        discount = min(max(self.single / self.types, 1e-3), 0.999)
        return np.where(count > 0, (count - discount) / self.tokens, discount * self.types / self.tokens)

    def hot_counts(self, words: np.ndarray) -> np.ndarray:
        """Count of each word that is hot, else 0."""
        return _looked_up(self.hot, self.hot_count, words)

    def often_counts(self, words: np.ndarray) -> np.ndarray:
        """Count of each word that is frequent, else 0."""
        return _looked_up(self.often, self.often_count, words)


def _looked_up(keys: np.ndarray, values: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(words), values.dtype)
    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
    return np.where(keys[at] == words, values[at], 0)


def gather_facts(train: DataFrame, shards: int) -> Facts:
    """One pass over the training texts: word counts meet in shards; a row per shard comes back."""
    top = 4 * _OFTEN
    rows = (train.select("text").mapInArrow(_vocabulary_counts(shards), "shard int, docs long, body binary").groupBy("shard")
            .applyInArrow(_vocabulary_slice(top), "types long, tokens long, single long, docs long, often binary")
            .collect())
    words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in rows:
        k = len(r.often) // 16
        words.append(np.frombuffer(r.often[: 8 * k], np.uint64))
        counts.append(np.frombuffer(r.often[8 * k:], np.int64))
    tokens = sum(r.tokens for r in rows)
    words, counts = np.concatenate(words), np.concatenate(counts)
    often = np.flatnonzero(counts * _OFTEN * shards > tokens)  # fewer than _OFTEN * shards words
    often = often[np.argsort(words[often])]
    words, counts = words[often], counts[often]
    hot = counts * 4 * shards > tokens  # fewer than 4 * shards words
    return Facts(sum(r.types for r in rows), tokens, sum(r.single for r in rows), sum(r.docs for r in rows), words, counts, words[hot], counts[hot])


def _coded(facts: Facts, texts: pa.Array, shards: int):
    """Distinct words of a unit (the start among them), codes of each word and the two before, its shard, and where each text begins."""
    words, first = _tokens(texts)
    code, distinct = pd.factorize(np.append(words, _START))
    code = code.astype(np.int32)
    start, code = code[-1], code[:-1]
    del words
    before = np.roll(code, 1)
    before[first[:-1]] = start
    two = np.roll(before, 1)
    two[first[:-1]] = start
    second = first[:-1] + 1
    two[second[second < first[1:]]] = start
    home = (mix(distinct) % np.uint64(shards)).astype(np.int32)[code]
    split = np.flatnonzero((facts.hot_counts(distinct) > 0)[code])
    home[split] = (mix(distinct[code[split]] + mix(distinct[before[split]])) % np.uint64(shards)).astype(np.int32)
    return distinct, code, before, two, home, first


def _context_counts(sent, shards: int, slices: int):
    """Each unit's contexts that are not frequent, to the slices of the vocabulary: the word, its count in training texts, the shards that ask for it.

    Every occurrence of a word but the end token is the context of the next word, so these counts are the word counts.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = Facts(*sent.value)
        for batch in (b.slice(at, len(piece)) for b in batches for at, piece in byte_slices(b.column("text"), _UNIT_BYTES)):
            distinct, _, before, _, home, first = _coded(facts, batch.column("text"), shards)
            rare = ((facts.often_counts(distinct) == 0) & (distinct != _START))[before]
            train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            by_hash = np.argsort(distinct)
            place = np.empty(len(distinct), np.int64)
            place[by_hash] = np.arange(len(distinct))
            distinct = distinct[by_hash]
            count = np.bincount(place[before[rare & train]], minlength=len(distinct)).astype("<u4")
            pairs = np.sort(pd.unique(place[before[rare]] * shards + home[rare]))
            word, shard = pairs // shards, (pairs % shards).astype(_width(shards))
            used, asks = np.unique(word, return_counts=True)
            begin = np.cumsum(asks) - asks
            of = _slice_of(distinct[used], slices)
            for s in np.unique(of):
                mine = np.flatnonzero(of == s)
                spots = np.repeat(begin[mine], asks[mine]) + np.arange(asks[mine].sum()) - np.repeat(np.cumsum(asks[mine]) - asks[mine], asks[mine])
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int64()), "body": pa.array([_squeeze(
                    len(mine).to_bytes(8, "little") + _hash_bytes(distinct[used[mine]], 5) + _planes(count[used[mine]])
                    + _planes(asks[mine].astype("<i4")) + _planes(shard[spots]))], pa.binary())})

    return step


def _tell_shards(shards: int):
    """To each shard the trained contexts it asks for, and the levels of their counts."""

    def step(rows: pa.Table) -> pa.Table:
        keys, counts, asks, shard = [], [], [], []
        for body in rows.column("body"):
            raw = _unpack(body.as_py())
            k = int.from_bytes(raw[:8], "little")
            keys.append(_hashes(raw[8: 8 + 7 * k], 5))
            counts.append(_from_planes(raw[8 + 7 * k: 8 + 11 * k], np.dtype("<u4")))
            asks.append(_from_planes(raw[8 + 11 * k: 8 + 15 * k], np.dtype("<i4")))
            shard.append(_from_planes(raw[8 + 15 * k:], _width(shards)))
        back, words = pd.factorize(np.concatenate(keys))
        level = _level(np.bincount(back, np.concatenate(counts), len(words)))
        pairs = pd.unique(np.concatenate(shard).astype(np.int64) * len(words) + np.repeat(back, np.concatenate(asks)))
        pairs = np.sort(pairs[level[pairs % len(words)] > 0])
        to, word = pairs // len(words), pairs % len(words)
        named, first = np.unique(to, return_index=True)
        told = words & _SHORT | level.astype(np.uint64)
        lists = [np.sort(told[w]) for w in np.split(word, first[1:])] if len(named) else []
        return pa.table({"shard": pa.array(named, pa.int64()), "body": pa.array(
            [_squeeze(_hash_bytes(w, 3) + (w & ~_SHORT).astype(np.uint8).tobytes()) for w in lists], pa.binary())})

    return step


def _dealt(docs: DataFrame, sent, shards: int) -> DataFrame:
    """What the shards get: occurrences, and (as unit -1) the levels of their contexts' counts."""
    slices = pieces(shards, 4)
    told = (docs.select("text", "train").mapInArrow(_context_counts(sent, shards, slices), "slice long, body binary").groupBy("slice")
            .applyInArrow(_tell_shards(shards), "shard long, body binary")
            .selectExpr("shard", "-1L as unit", "cast(null as array<long>) as ids", "body"))
    return docs.mapInArrow(_occurrences(sent, shards), "shard long, unit long, ids array<long>, body binary").unionByName(told)


def _levels(facts: Facts, contexts: np.ndarray, told: pa.Table) -> np.ndarray:
    """Level of the count of each of a shard's contexts."""
    level = _level(_looked_up(facts.often & _SHORT, facts.often_count, contexts))
    words, levels = [], []
    for body in told.column("body"):
        raw = _unpack(body.as_py())
        k = len(raw) // 6
        words.append(_hashes(raw[: 5 * k], 3))
        levels.append(np.frombuffer(raw[5 * k:], np.uint8))
    if words:
        both = np.sort(np.concatenate(words) | np.concatenate(levels).astype(np.uint64))
        level = np.maximum(level, _looked_up(both & _SHORT, (both & ~_SHORT).astype(np.uint8), contexts))
    return level


def _occurrences(sent, shards: int):
    """Each unit's occurrences to the shards of their last words, coded by a dictionary per shard; the texts themselves to shard -1."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = Facts(*sent.value)
        base = TaskContext.get().partitionId() << 24
        units = (b.slice(at, len(piece)) for b in batches for at, piece in byte_slices(b.column("text"), _UNIT_BYTES))
        for number, batch in enumerate(units):
            distinct, code, before, two, home, first = _coded(facts, batch.column("text"), shards)
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(first))
            order = np.argsort(home.astype(np.int16) if shards < 1 << 15 else home, kind="stable").astype(np.int32)
            bounds = np.searchsorted(home[order], np.arange(shards + 1))
            used = np.flatnonzero(np.diff(bounds))
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            bodies = [_squeeze(np.diff(first).astype(np.int32).tobytes())]
            for s in used:
                pick = order[bounds[s]: bounds[s + 1]]
                three = np.concatenate([code[pick], before[pick], two[pick]])
                local, three, uses = np.unique(three, return_inverse=True, return_counts=True)
                last, context = three[:len(pick)], three[len(pick):]
                own = np.zeros(len(local), bool)
                own[last] = True
                others = len(local) - int(own.sum())
                place = np.empty(len(local), np.int64)
                names, place[~own] = _names(distinct[local[~own]], uses[~own], 3)
                own_names, place[own] = _names(distinct[local[own]], uses[own], 5)
                last = place[last].astype(_width(len(local) - others))
                place[own] += others
                heads = np.flatnonzero(np.diff(owner[pick], prepend=-1))
                runs = np.diff(np.append(heads, len(pick))).astype(np.int32)
                docs = owner[pick][heads]
                bodies.append(_squeeze(b"".join([
                    np.array([others, len(local) - others, len(pick), len(heads)], np.int64).tobytes(), names, own_names,
                    _planes(last), _planes(place[context].astype(_width(len(local)))),
                    np.diff(docs, prepend=np.int32(0)).astype(np.int32).tobytes(), runs.tobytes(), np.packbits(train[docs]).tobytes()])))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([-1 - (base + number), *used], pa.int64()), "unit": pa.array([base + number] * len(bodies), pa.int64()),
                "ids": pa.array([batch.column("doc_id").to_pylist()] + [None] * len(used), pa.list_(pa.int64())),
                "body": pa.array(bodies, pa.binary())})

    return step


def _width(words: int) -> np.dtype:
    return np.dtype("<u2" if words <= 65536 else "<u4")


def _planes(values: np.ndarray) -> bytes:
    """Little-endian numbers as all their low bytes, then all the next ones: frequent words have zeros in the high ones."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _names(hashes: np.ndarray, uses: np.ndarray, low: int) -> tuple[bytes, np.ndarray]:
    """A dictionary of a message, by the power of two of the uses, then by hash, and the place of each word in it."""
    order = np.lexsort((hashes, -np.frexp(uses)[1]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return _hash_bytes(hashes[order], low), place


def _hash_bytes(hashes: np.ndarray, low: int) -> bytes:
    """The upper 16 bits of hashes as steps from the one before (small where they ascend, so they compress), ``low`` more bytes as they are."""
    steps = np.diff((hashes >> np.uint64(48)).astype("<u2"), prepend=np.uint16(0))
    return _planes(steps) + np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, 6 - low:6]).tobytes()


def _hashes(raw: bytes, low: int) -> np.ndarray:
    """The hashes that ``_hash_bytes`` wrote."""
    words = len(raw) // (2 + low)
    high = np.cumsum(_from_planes(raw[: 2 * words], np.dtype("<u2")), dtype=np.uint16)
    own = np.zeros((words, 8), np.uint8)
    own[:, 6 - low:6] = np.frombuffer(raw[2 * words:], np.uint8).reshape(words, low)
    return own.view("<u8").ravel() | high.astype(np.uint64) << np.uint64(48)


def _squeeze(body: bytes) -> bytes:
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _read(rows: pa.Table):
    """The occurrences of a shard: its words and contexts, codes of the last word and the two before, text (over all units), whether it trains."""
    names, around, blocks = [], [], []
    for unit, body in enumerate(rows.column("body")):
        raw = _unpack(body.as_py())
        others, own, n, d = (int(x) for x in np.frombuffer(raw[:32], np.int64))
        sizes = [5 * others, 7 * own, n * _width(own).itemsize, 2 * n * _width(others + own).itemsize, 4 * d, 4 * d]
        ends = 32 + np.cumsum(sizes)
        other, mine, last, context, docs, runs = (raw[e - size: e] for e, size in zip(ends, sizes))
        names.append(_hashes(mine, 5))
        around.append(np.append(_hashes(other, 3), names[-1] & _SHORT))
        runs = np.frombuffer(runs, np.int32)
        train = np.unpackbits(np.frombuffer(raw[ends[-1]:], np.uint8), count=d).astype(bool)
        blocks.append((_from_planes(last, _width(own)), _from_planes(context, _width(others + own)).reshape(2, n),
                       np.repeat(np.cumsum(np.frombuffer(docs, np.int32)), runs), np.repeat(train, runs), unit))
    word, vocabulary = pd.factorize(np.concatenate(names))
    near, contexts = pd.factorize(np.concatenate(around))
    word, near = word.astype(np.int32), near.astype(np.int32)
    at, beside, last, one, two, doc, train, unit = 0, 0, [], [], [], [], [], []
    for own, all_names, (lasts, (ones, twos), docs, trains, u) in zip(names, around, blocks):
        local = near[beside: beside + len(all_names)]
        last.append(word[at: at + len(own)][lasts])
        one.append(local[ones])
        two.append(local[twos])
        at += len(own)
        beside += len(all_names)
        doc.append(docs.astype(np.int32))
        train.append(trains)
        unit.append(np.full(len(docs), u, np.int32))
    return (vocabulary, contexts, *(np.concatenate(x) for x in (last, one, two, doc, train, unit)))


def _last_words(facts: Facts, vocabulary: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the known words; a split word is known here even if this shard trains none of its occurrences."""
    hot = facts.hot_counts(vocabulary)
    here = np.bincount(last, minlength=len(vocabulary))
    words = np.flatnonzero((here > 0) | (hot > 0))
    return words, np.where(hot > 0, hot, here)[words]


def _context_spread(facts: Facts, contexts: np.ndarray, level: np.ndarray, context: np.ndarray) -> np.ndarray:
    return np.where(contexts[context] == _START & _SHORT, facts.spread_at_start(), facts.spread(level[context]))


def build_trie(facts: Facts, vocabulary: np.ndarray, contexts: np.ndarray, level: np.ndarray, last: np.ndarray, one: np.ndarray, two: np.ndarray) -> Trie:
    """The trie of a shard's training occurrences (codes into ``vocabulary``, and into ``contexts`` for the words before)."""
    size = np.int64(len(contexts))
    words, count = _last_words(facts, vocabulary, last)
    keys = np.searchsorted(words, last) * size + one
    pairs, n2 = np.unique(keys, return_counts=True)
    keys = np.searchsorted(pairs, keys) * size + two
    triples, n3 = np.unique(keys, return_counts=True)
    del keys
    up2, before = pairs // size, pairs % size
    up3 = triples // size
    chance, own = facts.chance(count), facts.spread(_level(count))
    over2 = n2 + _context_spread(facts, contexts, level, before) * chance[up2]
    return Trie.build(
        [(None, words), (up2, before), (up3, triples % size)],
        [{"word": np.log10(chance), "next": -np.log10(count + own), "base": np.log10(count + 1.0)},
         {"word": np.log10(over2), "next": -np.log10(A * n2 + count[up2] + own[up2])},
         {"word": np.log10(A * n3 + over2[up3])}])


def occurrence_scores(facts: Facts, trie: Trie, vocabulary: np.ndarray, contexts: np.ndarray, level: np.ndarray, last: np.ndarray, one: np.ndarray,
                      two: np.ndarray):
    """Per occurrence: the log10 it adds to its text, and the node of its word (-1: unknown)."""
    size = np.int64(len(contexts))
    # each distinct question once
    to_pair, pairs = pd.factorize(last * size + one)
    to_triple, triples = pd.factorize(to_pair * size + two)
    w, v = pairs // size, pairs % size
    node1 = trie.child(0, None, w)
    node2 = trie.child(1, node1, v)
    up = triples // size
    node3 = trie.child(2, node2[up], triples % size)
    spread = np.log10(_context_spread(facts, contexts, level, v))
    unknown = float(np.log10(facts.chance(np.zeros(1, np.int64)))[0])
    own = facts.spread(np.zeros(1))  # of a word that no training text has
    word = np.where(node1 >= 0, trie.value(0, "word", np.maximum(node1, 0)) if trie.words[0].n else 0, unknown) + spread
    after = np.where(node1 >= 0, trie.value(0, "next", np.maximum(node1, 0)) if trie.words[0].n else 0, -np.log10(own))
    if trie.words[0].n:
        word = np.where(node2 >= 0, trie.value(1, "word", np.maximum(node2, 0)), word)
        after = np.where(node2 >= 0, trie.value(1, "next", np.maximum(node2, 0)), after)
    after = np.where(vocabulary[w] == _END, 0, after)  # nothing follows the end
    score = word[up]
    if trie.words[0].n:
        score = np.where(node3 >= 0, trie.value(2, "word", np.maximum(node3, 0)), score)
    return (score + after[up])[to_triple], node1[to_pair]


def _fixed(sums: np.ndarray, bits: int) -> bytes:
    """Numbers in steps of 2 ** -bits, finer than what is summed."""
    return _planes(np.round(np.ldexp(sums, bits)).astype("<i8"))


def _score_shard(sent):
    def step(key: tuple, rows: pa.Table) -> pa.Table:
        told, rows = rows.filter(pc.less(rows.column("unit"), 0)), rows.filter(pc.greater_equal(rows.column("unit"), 0))
        empty = pa.array([None] * rows.num_rows, pa.binary())
        if key[0].as_py() < 0:
            return pa.table({"unit": rows.column("unit"), "ids": rows.column("ids"), "texts": rows.column("body"), "sums": empty})
        facts = Facts(*sent.value)
        vocabulary, contexts, last, one, two, doc, train, unit = _read(rows)
        level = _levels(facts, contexts, told)
        last, one = last.astype(np.int64), one.astype(np.int64)
        raw = build_trie(facts, vocabulary, contexts, level, last[train], one[train], two[train]).to_bytes()
        level_map = mmap.mmap(-1, len(raw))  # the levels are read where they lie, as from a file
        level_map[:] = raw
        del raw
        trie = Trie.from_buffer(level_map)
        score, node = occurrence_scores(facts, trie, vocabulary, contexts, level, last, one, two)
        # the base score is exact: counts, not codes
        _, count = _last_words(facts, vocabulary, last[train])
        per_word = np.append(np.log10(count + 1.0), 0.0)
        base = per_word[node]
        bodies, units = [], rows.column("unit").to_pylist()
        for u in range(len(units)):
            mine = slice(*np.searchsorted(unit, [u, u + 1]))
            docs, at = np.unique(doc[mine], return_inverse=True)
            bodies.append(_squeeze(_planes(np.diff(docs, prepend=0).astype("<i4")) + _planes(np.bincount(at, node[mine] >= 0).astype("<i4"))
                                   + _fixed(np.bincount(at, base[mine]), _BASE_BITS) + _fixed(np.bincount(at, score[mine]), _SCORE_BITS)))
        return pa.table({"unit": pa.array(units, pa.int64()), "ids": pa.array([None] * len(units), pa.list_(pa.int64())),
                         "texts": empty, "sums": pa.array(bodies, pa.binary())})

    return step


def _sum_units(sent):
    def step(rows: pa.Table) -> pa.Table:
        facts = Facts(*sent.value)
        ids = texts = None
        for i, t in zip(rows.column("ids"), rows.column("texts")):
            if t.is_valid:
                ids, texts = i.values, _unpack(t.as_py())
        n = len(ids)
        size = np.frombuffer(texts, np.int32).astype(np.int64)
        known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for sums in rows.column("sums"):
            if sums.is_valid:
                raw = _unpack(sums.as_py())
                k = len(raw) // 24
                docs = np.cumsum(_from_planes(raw[: 4 * k], np.dtype("<i4")))
                known[docs] += _from_planes(raw[4 * k: 8 * k], np.dtype("<i4"))
                base[docs] += np.ldexp(_from_planes(raw[8 * k: 16 * k], np.dtype("<i8")), -_BASE_BITS)
                score[docs] += np.ldexp(_from_planes(raw[16 * k:], np.dtype("<i8")), -_SCORE_BITS)
        begin = -np.log10(A * facts.docs + facts.docs + facts.spread_at_start())
        return pa.table({"doc_id": ids, "n_tokens": pa.array(size), "n_known": pa.array(known),
                         "base_score": pa.array(base - size * np.log10(facts.tokens + facts.types + 1)), "score": pa.array(score + begin)})

    return step


def score(docs: DataFrame, train: Column) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) for all of ``docs``, learned from its rows under ``train``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", train.alias("train"))
    shards = pieces(text_size(docs)[1], _SHARD_BYTES)
    facts = gather_facts(docs.where("train"), shards)
    sent = spark.sparkContext.broadcast(facts.parts())  # fewer than _OFTEN * shards words
    told = (_dealt(docs, sent, shards)
            .groupBy("shard").applyInArrow(_score_shard(sent), "unit long, ids array<long>, texts binary, sums binary"))
    out = told.groupBy("unit").applyInArrow(_sum_units(sent), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(facts.tokens).cast("bigint"))


def train_tries(docs: DataFrame) -> DataFrame:
    """The model itself: rows (shard, vocabulary, contexts, trie), each trie one buffer for ``Trie.from_buffer``, trained on all of ``docs``."""
    docs = docs.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(True).alias("train"))
    shards = pieces(text_size(docs)[1], _SHARD_BYTES)
    sent = docs.sparkSession.sparkContext.broadcast(gather_facts(docs, shards).parts())

    def step(key: tuple, rows: pa.Table) -> pa.Table:
        told, rows = rows.filter(pc.less(rows.column("unit"), 0)), rows.filter(pc.greater_equal(rows.column("unit"), 0))
        facts = Facts(*sent.value)
        vocabulary, contexts, last, one, two, *_ = _read(rows)
        trie = build_trie(facts, vocabulary, contexts, _levels(facts, contexts, told), last.astype(np.int64), one.astype(np.int64), two)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "vocabulary": pa.array([vocabulary.tobytes()], pa.binary()),
                         "contexts": pa.array([contexts.tobytes()], pa.binary()), "trie": pa.array([trie.to_bytes()], pa.binary())})

    return (_dealt(docs, sent, shards)
            .where("shard >= 0").groupBy("shard").applyInArrow(step, "shard long, vocabulary binary, contexts binary, trie binary"))
