"""Repeated passages by windows that earlier documents hold, reported as factors against their sources.

A word is removed when a window of ``window`` words over it stands in an earlier
document (a smaller doc_id) too.  Documents lie in blocks.  Each block indexes all its windows of that many words by hash and keeps,
per distinct window, the first document that has it; these go to the index
shards, which hold the windows of all blocks.  A shard answers each block whose
first document is not the first of all with the reference: source document and
place.  These window hits alone decide which words go.  Factors are made from
the hits afterwards: hits that follow each other, with references one word further
in the same source, are one.  They are no greedy longest factors: only the first
holder of each window is known, so one breaks where an inner window has another
source, and neighbours may overlap by up to window - 1 words.

Windows that follow each other mostly share their smallest five-word hash, which
picks the shard, so that they travel as runs with one position each.  A block
sends a window once, however often it holds it: a passage in every document
reaches a shard at most once per block.

Defined results: a null text has no words; rows with a null doc_id are neither
references nor cut; rows that share a doc_id are not earlier than each other;
texts under ``window`` words stay whole.  Extra columns are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.sizing import pieces, text_size
from plumbline.llm.words import byte_slices, tokenise, window_hashes, window_starts

WINDOW = 13
ANCHOR = 5
BLOCK_BYTES = 6 << 20
_KEPT_BYTES = 7  # of each window hash; a shard holds windows of about one block's number


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Differences, byte by byte of equal weight: small numbers in order compress to little."""
    d = np.diff(x.astype(kind), prepend=np.zeros(1, kind))
    return d.view(np.uint8).reshape(len(d), -1).T.tobytes()


def _unplanes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel(), dtype=kind)


class Block:
    """The documents of one block in order of doc_id, their words, and their distinct windows."""

    def __init__(self, rows: pa.Table, window: int):
        self.size = window
        known = pc.is_valid(rows.column("doc_id")).to_numpy()
        ids = pc.fill_null(rows.column("doc_id"), 0).to_numpy()  # whole numbers throughout: no detour over floats
        digest = [hashlib.md5(t.as_buffer() if t.is_valid else b"").digest() for t in rows.column("text")]
        order = np.array(sorted(range(len(ids)), key=lambda i: (not known[i], ids[i], digest[i])), dtype=np.int64)
        self.rows = rows.take(pa.array(order))
        self.known = known[order]
        self.doc = ids[order].astype(np.int64)
        hashes, counts, self.slices = [], [], []
        for at, texts in byte_slices(self.rows.column("text")):
            words = tokenise(texts)
            hashes.append(words.hashes()[0])
            counts.append(words.counts())
            self.slices.append((at, texts))
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        at = window_starts(self.first, window)
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        at = at[self.known[owner[at]]] if len(at) else at
        self.at, self.owner = at, owner[at] if len(at) else at
        self.window = window_hashes(words, window)[at] if len(at) else np.zeros(0, np.uint64)
        self.words = words
        self.distinct, self.leader, self.member = np.unique(self.window, return_index=True, return_inverse=True)

    def anchors(self) -> np.ndarray:
        """Smallest hash of ANCHOR words within each distinct window's first place."""
        least = window_hashes(self.words, ANCHOR)
        span, width = 1, self.size - ANCHOR + 1
        while span < width:
            step = min(span, width - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        return least[self.at[self.leader]]


def _requests(shards: int, window: int):
    def step(key: tuple, rows: pa.Table) -> pa.Table:
        block = Block(rows, window)
        out: dict[str, list] = {"shard": [], "sender": [], "body": []}
        if len(block.at):
            places = np.sort(block.leader)  # first places in text order
            back = np.argsort(block.leader, kind="stable")
            anchor = block.anchors()[back]
            fresh = np.ones(len(places), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(block.at[places]) != 1) | (np.diff(block.owner[places]) != 0)
            runs = np.flatnonzero(fresh)
            sizes = np.diff(np.append(runs, len(places)))
            # no run is longer than its length byte can say
            many = -(-sizes // 255)
            if many.max() > 1:
                part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                runs, sizes = np.repeat(runs, many) + part * 255, np.minimum(np.repeat(sizes, many) - part * 255, 255)
            shard = (anchor[runs] % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            short = np.ascontiguousarray(block.window[places]).view(np.uint8).reshape(-1, 8)[:, :_KEPT_BYTES]
            for s in range(shards):
                pick = order[bounds[s]: bounds[s + 1]]
                if not len(pick):
                    continue
                r, n = runs[pick], sizes[pick]
                take = np.arange(n.sum()) + np.repeat(r - (np.cumsum(n) - n), n)
                own = block.owner[places[r]]
                body = [_planes(block.doc[own], "<i8"), _planes(own, "<i4"), _planes(block.at[places[r]] - block.first[own], "<i4"),
                        n.astype(np.uint8).tobytes(), short[take].tobytes()]
                out["shard"].append(s)
                out["sender"].append(key[0].as_py())
                out["body"].append(len(pick).to_bytes(8, "little") + b"".join(body))
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "sender": pa.array(out["sender"], pa.int32()),
                         "body": pa.array(out["body"], pa.binary())})

    return step


def _answers(key: tuple, rows: pa.Table) -> pa.Table:
    """For each block, its windows whose first document of all is earlier than its own first."""
    parts = []
    for sender, body in zip(rows.column("sender").to_pylist(), rows.column("body")):
        raw = body.as_py()
        k, raw = int.from_bytes(raw[:8], "little"), raw[8:]
        doc, own, start = _unplanes(raw[: 8 * k], "<i8"), _unplanes(raw[8 * k: 12 * k], "<i4"), _unplanes(raw[12 * k: 16 * k], "<i4")
        n = np.frombuffer(raw[16 * k: 17 * k], np.uint8).astype(np.int64)
        within = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        short = np.zeros((len(within), 8), np.uint8)
        short[:, :_KEPT_BYTES] = np.frombuffer(raw[17 * k:], np.uint8).reshape(-1, _KEPT_BYTES)
        parts.append((np.full(len(within), sender, np.int32), np.repeat(doc, n), np.repeat(own, n), np.repeat(start, n) + within, short.view(np.uint64).ravel()))
    sender, doc, own, start, window = (np.concatenate(x) for x in zip(*parts))
    del parts
    order = np.lexsort((start, doc, window))
    ordered = window[order]
    head = np.ones(len(order), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    lead = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    late = doc[order] > doc[lead]
    hit, lead = order[late], lead[late]
    by = np.lexsort((start[hit], own[hit], sender[hit]))
    hit, lead = hit[by], lead[by]
    bounds = np.flatnonzero(np.diff(sender[hit], prepend=-1, append=-1))
    out: dict[str, list] = {"block": [], "body": []}
    for a, b in zip(bounds[:-1], bounds[1:]):
        h, g = hit[a:b], lead[a:b]
        out["block"].append(int(sender[h[0]]))
        out["body"].append(b"".join([_planes(own[h], "<i4"), _planes(start[h], "<i4"), _planes(doc[g], "<i8"), _planes(start[g], "<i4")]))
    return pa.table({"block": pa.array(out["block"], pa.int32()), "body": pa.array(out["body"], pa.binary())})


def _parse(keep_text: bool, names: list[str], window: int):
    def step(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(rows, window)
        source_doc = block.doc[block.owner[block.leader]].copy() if len(block.at) else np.zeros(0, np.int64)
        source_at = (block.at - block.first[block.owner])[block.leader] if len(block.at) else np.zeros(0, np.int64)
        for body in answers.column("body"):
            raw = body.as_py()
            k = len(raw) // 20
            own, start = _unplanes(raw[: 4 * k], "<i4"), _unplanes(raw[4 * k: 8 * k], "<i4")
            spot = np.searchsorted(block.at, block.first[own] + start)
            source_doc[block.member[spot]] = _unplanes(raw[8 * k: 16 * k], "<i8")
            source_at[block.member[spot]] = _unplanes(raw[16 * k:], "<i4")
        gone = np.zeros(int(block.first[-1]) + 1, np.int32)
        factors: list[list[dict]] = [[] for _ in range(len(block.counts))]
        late = np.flatnonzero(source_doc[block.member] < block.doc[block.owner]) if len(block.at) else np.zeros(0, np.int64)
        if len(late):
            np.add.at(gone, block.at[late], 1)
            np.add.at(gone, block.at[late] + window, -1)
            doc, place = source_doc[block.member[late]], source_at[block.member[late]]
            fresh = np.ones(len(late), bool)
            fresh[1:] = (np.diff(block.at[late]) != 1) | (np.diff(block.owner[late]) != 0) | (np.diff(doc) != 0) | (np.diff(place) != 1)
            heads = np.flatnonzero(fresh)
            for h, n in zip(heads, np.diff(np.append(heads, len(late)))):
                o = int(block.owner[late[h]])
                factors[o].append({"start": int(block.at[late[h]] - block.first[o]), "length": int(n) + window - 1,
                                   "source": int(doc[h]), "source_start": int(place[h])})
        removed = np.cumsum(gone)[:-1] > 0
        removed_upto = np.concatenate([[0], np.cumsum(removed)])
        digests, left = [], []
        for at, texts in block.slices:
            words = tokenise(texts)
            base = block.first[at]
            kept = np.flatnonzero(~removed[base: base + len(words.starts)])
            sizes = words.ends[kept] - words.starts[kept] + 1
            upto = np.concatenate([[0], np.cumsum(sizes)])
            data = np.append(words.data, np.uint8(32))
            joined = data[np.arange(upto[-1]) + np.repeat(words.starts[kept] - upto[:-1], sizes)] if len(kept) else np.zeros(0, np.uint8)
            joined[upto[1:] - 1] = 32
            cuts = upto[np.searchsorted(kept, words.first)]
            for i in range(len(texts)):
                a, b = cuts[i], cuts[i + 1]
                digests.append(hashlib.sha256(joined[a: max(a, b - 1)].tobytes()).hexdigest())
                if keep_text:
                    lo, hi = words.first[i], words.first[i + 1]
                    cut = removed[base + lo: base + hi]
                    text = words.data[words.text_at[i]: words.text_at[i + 1]]
                    if cut.any():  # a removed word goes with the white space after it
                        stays = np.ones(len(text), bool)
                        edge = np.append(words.starts[lo:hi], words.text_at[i + 1]) - words.text_at[i]
                        for w in np.flatnonzero(cut):
                            stays[edge[w]: edge[w + 1]] = False
                        text = text[stays]
                    left.append(text.tobytes().decode("utf-8"))
        made = {c: block.rows.column(c) for c in names if c != "text" or not keep_text}
        made |= {"text": pa.array(left, pa.string())} if keep_text else {}
        made = {c: made[c] for c in names}
        span = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "source", "source_start")]))
        return pa.table(made | {
            "n_words": pa.array(block.counts, pa.int64()),
            "n_removed": pa.array(removed_upto[block.first[1:]] - removed_upto[block.first[:-1]], pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()), "factors": pa.array(factors, span)})

    return step


def parse(docs: DataFrame, keep_text: bool = True, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and factors (in words: start, length, source, source_start).

    A factor of ``window`` (at least ANCHOR) words counts.  ``text`` becomes what is left of it (with ``keep_text``; else it is left out).  Columns of these names, or
    named ``block``, are replaced.
    """
    added = ("n_words", "n_removed", "kept_sha256", "factors", "block")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    names = [c for c in docs.columns if c != "text" or keep_text]
    n = pieces(text_size(docs)[1], BLOCK_BYTES)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(_requests(n, window), "shard int, sender int, body binary")
    told = asked.groupBy("shard").applyInArrow(_answers, "block int, body binary")
    span = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "source", "source_start")]))
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in names]).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_sha256", T.StringType()), T.StructField("factors", span)])
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_parse(keep_text, names, window), schema)
