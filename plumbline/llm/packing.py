"""Pack tokenised documents into windows of a fixed length by the sum-of-squares rule.

Documents are cut into full windows; what is left of a document joins the open
window whose fill level makes the sum of squared level counts smallest, found
with one array expression over the level counts.  Each task packs its own
partition in one pass, so nothing is shuffled; when it ends, the pieces in its
open windows are laid end to end and cut anew, which leaves one window with
padding per task.

Defined results: a null or empty text is a document of the end id alone; rows
are packed one by one, so repeated rows and null ids are kept; an empty
partition makes no window.
"""

from __future__ import annotations

import itertools
import operator
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.id_store import IdStore
from plumbline.llm.words import byte_slices, tokenise

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
_SLICE, _WORDS = 1 << 20, 8192  # bytes of text and words at a time
_LINE = 64  # words that the tokenizer gets as one text
_KEPT_WORDS = 1_000_000  # distinct words that a worker process keeps from task to task
_GIVEN = 1 << 18  # ids of open windows that a task gives back at once


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordIds:
    """Token ids of whitespace-separated words; each distinct word goes through the tokenizer once in a worker process.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.store = IdStore(_KEPT_WORDS)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text followed by END_ID; where each text begins (and the end)."""
        words = tokenise(texts)

        def learn(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = words.data.tobytes()
            flat, sizes = [], []
            for k in range(0, len(at), _WORDS):
                some = at[k: k + _WORDS]
                own = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[some].tolist(), words.ends[some].tolist())]
                lines = [" ".join(own[j: j + _LINE]) for j in range(0, len(own), _LINE)]
                # a token belongs to the word in whose characters it starts
                begin = np.cumsum([0, *(n + 1 for n in map(len, own))])[:-1]
                line_at = begin[::_LINE]
                made = self.tokenizer.encode_batch(lines, add_special_tokens=False)
                ids = [e.ids for e in made]
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                first = map(operator.itemgetter(0), itertools.chain.from_iterable(e.offsets for e in made))
                start = np.fromiter(first, np.int64, int(n.sum())) + np.repeat(line_at, n)
                sizes.append(np.bincount(np.searchsorted(begin, start, side="right") - 1, minlength=len(own)))
                flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(n.sum())))
            return np.concatenate(flat), np.concatenate(sizes)

        ids, upto = self.store.expand(words.hashes()[0], learn)
        cuts = upto[words.first]
        out = np.full(len(ids) + len(texts), END_ID, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(cuts))] = ids
        return out, cuts + np.arange(len(texts) + 1)


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The vocabulary's ``WordIds`` of this worker process: its next task starts with the words that earlier ones met."""
    if path not in _WORD_IDS:
        _WORD_IDS.clear()
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


class Windows:
    """Open windows by fill level, and the pieces that are done."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list] = [[] for _ in range(window + 1)]
        self.done: list[tuple] = []

    def _new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def best_level(self, size: int) -> int:
        """Fill level (0: a new window) whose choice makes the sum of squared counts smallest; ties: the fullest."""
        n, most = self.counts, self.window - size
        change = np.where(n[: most + 1] > 0, 1 - 2 * n[: most + 1], np.iinfo(np.int64).max // 4)
        change[0] = 0
        change[:most] += 2 * n[size: self.window] + 1
        return most - int(np.argmin(change[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.window * self.window
        for a in range(0, whole, self.window):
            self.done.append((doc, a, ids[a: a + self.window], total, self._new(), 0))
        if whole == total:
            return
        size = total - whole
        level = self.best_level(size)
        if level:
            number, pieces = self.open[level].pop()
            self.counts[level] -= 1
        else:
            number, pieces = self._new(), []
        pieces.append((doc, whole, ids[whole:].copy(), total, number, level))
        if level + size == self.window:
            self.done.extend(pieces)
        else:
            self.open[level + size].append((number, pieces))
            self.counts[level + size] += 1

    def finish(self) -> Iterator[None]:
        """Lay what is in open windows end to end, fullest first, and cut it into windows; stops whenever much is done."""
        number, fill, held = None, self.window, 0
        for level in range(self.window - 1, 0, -1):
            for _, pieces in self.open[level]:
                for doc, start, ids, total, _, _ in pieces:
                    held += len(ids)
                    at = 0
                    while at < len(ids):
                        if fill == self.window:
                            number, fill = self._new(), 0
                        part = ids[at: at + self.window - fill]
                        self.done.append((doc, start + at, part, total, number, fill))
                        at, fill = at + len(part), fill + len(part)
                if held >= _GIVEN:
                    yield
                    held = 0
            self.open[level] = []
        self.counts = np.zeros(self.window + 1, np.int64)
        yield


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece of a document (doc_id, text): where it starts in the document's ids, and where it lies.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves with ``keep_ids``.
    """
    path = vocabulary or vocabulary_path()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packed = word_ids(path), Windows(window, TaskContext.get().partitionId() << 33)

        def rows() -> pa.RecordBatch:
            done, packed.done = packed.done, []
            made = {
                "doc_id": pa.array([p[0] for p in done], pa.int64()), "start": pa.array([p[1] for p in done], pa.int64()),
                "length": pa.array([len(p[2]) for p in done], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p[2].astype("<u4").tobytes()) for p in done], pa.int64()),
                "doc_tokens": pa.array([p[3] for p in done], pa.int64()),
                "sequence_id": pa.array([p[4] for p in done], pa.int64()), "offset": pa.array([p[5] for p in done], pa.int64()),
            }
            if keep_ids:
                sizes = np.concatenate([[0], np.cumsum([len(p[2]) for p in done])]).astype(np.int32)
                flat = np.concatenate([p[2] for p in done]) if done else np.zeros(0, np.int32)
                made["ids"] = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_pydict(made)

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for at, texts in byte_slices(batch.column("text"), _SLICE):
                ids, cuts = words.encode(texts)
                for i in range(len(texts)):
                    packed.add(names[at + i], ids[cuts[i]: cuts[i + 1]])
                yield rows()
        for _ in packed.finish():
            yield rows()

    fields = [T.StructField(c, T.LongType()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.select("doc_id", "text").mapInArrow(step, T.StructType(fields))
