"""SentencePiece encoding and decoding: the best-scoring segmentation, for many words at once.

Spaces become U+2581, one is put before the text, and no piece has that
character after another one, so a text falls into words that begin with it.
Each distinct word is segmented once: words of one length advance together,
position by position, over all piece lengths; substring hashes from running
sums are searched in the sorted hashes of the pieces, the largest total so far
is kept, and the length of the piece that gave it is the backpointer.  A
character without piece becomes its UTF-8 bytes' pieces.

The vocabulary is read from a SentencePiece file; its piece scores are summed
as a unigram model's, in double precision.  Ties go to the longer last piece.

Defined results: a null or empty text has no ids; decoding no ids gives the
empty text; U+2581 in a text is read as a space, so such a text comes back with a
space there; every other text comes back as it was.  Extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.arrow_steps import add_columns
from plumbline.llm.id_store import IdStore, spread
from plumbline.llm.words import _P, _P_INVERSE, _powers, byte_slices, mix

VOCABULARY = "piece_bpe_32k.model"
_SPACE = 0x2581
_UNKNOWN_PENALTY = 10.0
_ROWS = 1 << 18  # characters of equal-length words that advance together; ids that are decoded together


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _letter(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class Pieces:
    """Sorted hashes of the pieces with ids and scores; the ids of bytes; the bytes of every id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        hashes = np.array([self._hash(_points(names[i])) for i in plain], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(plain, np.int32)[order]
        self.scores = np.array([model.get_score(i) for i in plain])[order]
        self.longest = max((len(names[i]) for i in plain), default=1)
        self.unknown = float(self.scores.min()) - _UNKNOWN_PENALTY
        self.of_byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        written = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if i not in set(plain[:0]) and (model.is_control(i) or model.is_unknown(i))
                   else names[i].replace("▁", " ").encode() for i in range(n)]
        self.size = np.array([len(w) for w in written], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(written), np.uint8)
        self.store = IdStore()

    @staticmethod
    def _hash(points: np.ndarray) -> np.uint64:
        return (_letter(points) * _powers(_P, len(points))).sum(dtype=np.uint64)

    def _segment(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of equal-length words (a row of code points each): id at the end of each piece, -1 unknown; which places are ends."""
        n, length = words.shape
        upto = np.zeros((n, length + 1), np.uint64)
        np.cumsum(_letter(words) * _powers(_P, length), axis=1, out=upto[:, 1:])
        back = _powers(_P_INVERSE, length + 1)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        step, piece = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int32)
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                h = (upto[:, j] - upto[:, i]) * back[i]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                if j - i > 1 and not hit.any():
                    continue
                total = best[:, i] + np.where(hit, self.scores[at], self.unknown if j - i == 1 else -np.inf)
                better = total > best[:, j]
                best[better, j] = total[better]
                step[better, j] = j - i
                piece[better, j] = np.where(hit, self.ids[at], -1)[better]
        ends = np.zeros((n, length + 1), bool)
        place = np.full(n, length)
        rows = np.arange(n)
        while len(rows):
            ends[rows, place[rows]] = True
            place[rows] -= step[rows, place[rows]]
            rows = rows[place[rows] > 0]
        return piece[:, 1:], ends[:, 1:]

    def _learn(self, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and how many each word has, of the words at ``start``."""
        n = len(start)
        counts = np.zeros(n, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(length):
            mine = np.flatnonzero(length == size)
            for a in range(0, len(mine), max(1, _ROWS // int(size))):
                some = mine[a: a + max(1, _ROWS // int(size))]
                words = points[start[some][:, None] + np.arange(size)]
                piece, ends = self._segment(words)
                row, col = np.nonzero(ends)
                ids = piece[row, col]
                lost = np.flatnonzero(ids < 0)
                if len(lost):  # the character's bytes instead
                    raw = [chr(c).encode("utf-8", "surrogatepass") for c in words[row[lost], col[lost]]]
                    width = np.ones(len(ids), np.int64)
                    width[lost] = [len(r) for r in raw]
                    first = np.cumsum(width) - width
                    longer = np.empty(int(width.sum()), np.int32)
                    longer[first] = ids
                    for f, r in zip(first[lost], raw):
                        longer[f: f + len(r)] = self.of_byte[list(r)]
                    row, ids = np.repeat(row, width), longer
                counts[some] = np.bincount(row, minlength=len(some))
                parts.append((some[row], ids))
        owner = np.concatenate([p[0] for p in parts])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([p[1] for p in parts])[order], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin (and the end)."""
        marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        points = _points("".join(marked))
        text_at = np.concatenate([[0], np.cumsum([len(m) for m in marked])])
        space = points == _SPACE
        fresh = space.copy()
        fresh[1:] &= ~space[:-1]
        fresh[text_at[:-1][text_at[:-1] < len(points)]] = True
        start = np.flatnonzero(fresh)
        length = np.diff(np.append(start, len(points)))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_letter(points) * _powers(_P, len(points)), dtype=np.uint64)])
        hashes = mix((upto[start + length] - upto[start]) * _powers(_P_INVERSE, len(points) + 1)[start])
        ids, at = self.store.expand(hashes, lambda places: self._learn(points, start[places], length[places]))
        return ids, at[np.searchsorted(start, text_at)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of id lists given in a row."""
        out, row, n = [], 0, len(first) - 1
        while row < n:
            to = max(row + 1, int(np.searchsorted(first, first[row] + _ROWS, side="right")) - 1)
            some = ids[first[row]: first[to]]
            data, upto = spread(self.bytes, self.begin[some], self.size[some])
            raw = data.tobytes()
            cuts = upto[first[row: to + 1] - first[row]]
            for a, b in zip(cuts[:-1], cuts[1:]):
                text = raw[a:b].decode("utf-8", "replace")
                out.append(text[1:] if text.startswith(" ") else text)
            row = to
        return out


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of ``text``; a column of that name is replaced."""
    path = vocabulary or vocabulary_path()
    kept: list = []

    def make(batch: pa.RecordBatch) -> dict:
        if not kept:
            kept.append(Pieces(path))
        flat, first = [], [np.zeros(1, np.int64)]
        for _, texts in byte_slices(batch.column("text")):
            ids, at = kept[0].encode(texts.to_pylist())
            flat.append(ids)
            first.append(at[1:] + first[-1][-1])
        return {"ids": pa.LargeListArray.from_arrays(np.concatenate(first), pa.array(np.concatenate([np.zeros(0, np.int32), *flat]), pa.int32()))}

    return add_columns(docs, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids``; a column of that name is replaced; null ids give the empty text."""
    path = vocabulary or vocabulary_path()
    kept: list = []

    def make(batch: pa.RecordBatch) -> dict:
        if not kept:
            kept.append(Pieces(path))
        lists = batch.column("ids").fill_null(pa.scalar([], batch.column("ids").type)) if batch.column("ids").null_count else batch.column("ids")
        first = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
        return {"decoded": kept[0].decode(lists.flatten().to_numpy(zero_copy_only=False), first)}

    return add_columns(rows, make, [T.StructField("decoded", T.StringType())])
