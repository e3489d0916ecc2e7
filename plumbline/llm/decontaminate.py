"""Benchmark passages in training documents, found with one FM-index per shard of documents.

A task gathers its documents into shards of SHARD_BYTES and builds an FM-index
over the words of each: nothing is shuffled.  Test phrases (``window`` words in a
row of an item; a shorter item is one phrase) are searched backwards through the
wavelet ranks, all at once, their occurrences located from sampled suffix
positions and merged into spans to remove.

The benchmark is cut into blocks of about PHRASE_BYTES of text, hashed on the
driver and broadcast one at a time.  One block: each shard is asked as soon as
it is built.  More: the indexes are staged as a table in the shared folder, read
once per block, and the spans of a document are merged over the blocks.

Words are runs of ASCII letters and digits and of all non-ASCII characters,
A-Z lower-cased; they are compared by 64-bit hashes.

Defined results: a null or empty text has no words and no hits; rows are judged
one by one, so repeated rows and null ids are kept; items without id, text or
words take no part, and items that share an id count as one item; an empty
benchmark hits nothing.  A word under several windows is hit once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordering import stage_table
from plumbline.llm.arrow_steps import add_columns
from plumbline.llm.fm_index import FmIndex
from plumbline.llm.id_store import spread
from plumbline.llm.sizing import pieces, text_size
from plumbline.llm.words import BARE, byte_slices, tokenise

WINDOW = 10
SHARD_BYTES = 4 << 20
PHRASE_BYTES = 1 << 20  # benchmark text of a broadcast block, or a single item
_INDEX = ("keys", "below", "levels", "zeros", "marks", "samples")
_FOUND = "shard long, place long, doc_id long, n_words long, spans array<struct<start:long,length:long>>, items array<string>"


@dataclass
class Phrases:
    """Distinct phrases (word hashes, right-aligned) and the items that hold each."""

    words: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    holders: np.ndarray
    names: list[str]


def phrases_of(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """The phrases of (id, text) items."""
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    lines, lengths, owners = [np.zeros((0, window), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for name, text in items:
        words = tokenise(pa.array([text], pa.large_string()), lower=True, breaks=BARE).hashes()[0]
        if not len(words):
            continue
        short = min(window, len(words))
        rows = np.lib.stride_tricks.sliding_window_view(words, short)
        lines.append(np.concatenate([np.zeros((len(rows), window - short), np.uint64), rows], axis=1))
        lengths.append(np.full(len(rows), short))
        owners.append(np.full(len(rows), number[name]))
    whole = np.concatenate([np.concatenate(lengths).astype(np.uint64)[:, None], np.concatenate(lines)], axis=1)
    distinct, at = np.unique(whole, axis=0, return_inverse=True)
    holds = np.unique(np.stack([at.ravel(), np.concatenate(owners)], axis=1), axis=0)
    first = np.searchsorted(holds[:, 0], np.arange(len(distinct) + 1))
    return Phrases(distinct[:, 1:], distinct[:, 0].astype(np.int64), first, holds[:, 1], names)


@dataclass
class Shard:
    """Documents in a row, with the index over their words."""

    number: int
    doc_ids: pa.Array
    counts: np.ndarray
    index: FmIndex


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """A task's documents in shards of about SHARD_BYTES of text (a longer document is a shard of its own)."""
    ids, hashes, counts, size, number = [], [], [], 0, TaskContext.get().partitionId() << 32

    def close() -> Shard:
        return Shard(number, pa.chunked_array(ids).combine_chunks(), np.concatenate(counts), FmIndex.build(np.concatenate(hashes), np.concatenate(counts)))

    for batch in batches:
        for at, texts in byte_slices(batch.column("text")):
            tokens = tokenise(texts, lower=True, breaks=BARE)
            ids.append(batch.column("doc_id").slice(at, len(texts)))
            hashes.append(tokens.hashes()[0])
            counts.append(tokens.counts())
            size += len(tokens.data)
            if size >= SHARD_BYTES:
                yield close()
                ids, hashes, counts, size, number = [], [], [], 0, number + 1
    if ids:
        yield close()


def ask(shard: Shard, phrases: Phrases) -> pa.RecordBatch:
    """The documents of a shard with merged spans (in words) and the items whose phrases occur in each."""
    index, n_docs = shard.index, len(shard.counts)
    which, low, high = index.search(phrases.words, phrases.lengths)
    sizes = high - low
    places = index.locate(np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes))
    which = np.repeat(which, sizes)
    first = np.cumsum(shard.counts + 1) - (shard.counts + 1)
    n = int((shard.counts + 1).sum())
    change = np.bincount(places, minlength=n + 1) - np.bincount(places + phrases.lengths[which], minlength=n + 1)
    covered = np.cumsum(change) > 0
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    starts, stops = edges[::2], edges[1::2]
    owner = np.searchsorted(first, starts, side="right") - 1
    pairs = np.unique((np.searchsorted(first, places, side="right") - 1) * np.int64(len(phrases.lengths) + 1) + which)
    doc, phrase = pairs // (len(phrases.lengths) + 1), pairs % (len(phrases.lengths) + 1)
    many = phrases.first[phrase + 1] - phrases.first[phrase]
    held, _ = spread(phrases.holders, phrases.first[phrase], many)
    named = np.unique(np.repeat(doc, many) * np.int64(len(phrases.names) + 1) + held)
    item_doc, item = named // (len(phrases.names) + 1), named % (len(phrases.names) + 1)

    def lists(owners: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owners, np.arange(n_docs + 1)), pa.int32()), values)

    spans = pa.StructArray.from_arrays([pa.array(starts - first[owner], pa.int64()), pa.array(stops - starts, pa.int64())], ["start", "length"])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n_docs, shard.number), pa.int64()), pa.array(np.arange(n_docs), pa.int64()), shard.doc_ids.cast(pa.int64()),
         pa.array(shard.counts, pa.int64()), lists(owner, spans), lists(item_doc, pa.array(phrases.names, pa.string()).take(pa.array(item)))],
        ["shard", "place", "doc_id", "n_words", "spans", "items"])


def index_table(docs: DataFrame) -> DataFrame:
    """One row per shard of ``docs`` (doc_id, text): its documents and the parts of its index."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches):
            made = {"shard": [s.number], "doc_ids": [s.doc_ids.cast(pa.int64()).to_pylist()], "counts": [s.counts.astype("<i8").tobytes()]}
            yield pa.RecordBatch.from_pydict(made | {name: [part] for name, part in zip(_INDEX, s.index.dump())})

    return docs.select("doc_id", "text").mapInArrow(
        step, "shard long, doc_ids array<long>, counts binary, " + ", ".join(f"{c} binary" for c in _INDEX))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for r in range(len(batch)):
            parts = [batch.column(c)[r].as_buffer() for c in _INDEX]
            yield Shard(batch.column("shard")[r].as_py(), batch.column("doc_ids")[r].values, np.frombuffer(batch.column("counts")[r].as_buffer(), "<i8"),
                        FmIndex.load(parts))


def _merged(spans: str):
    """Spans in order, those that touch or overlap joined."""
    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), (F.greatest(last["start"] + last["length"], span["start"] + span["length"]) - last["start"]).alias("length"))
        return (F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["start"] + F.try_element_at(done, F.lit(-1))["length"] >= span["start"]),
                       F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(span))))

    return F.aggregate(F.sort_array(spans), F.slice(F.col(spans), 1, 0), add)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, spans (in words: start, length), items (sorted ids as text), contaminated.

    ``benchmark`` holds item_id and text.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    blocks = pieces(text_size(items)[1], PHRASE_BYTES)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    source = docs.select("doc_id", "text") if blocks == 1 else stage_table(index_table(docs))
    read = shards if blocks == 1 else _stored
    found = None
    for b in range(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(vars(phrases_of([(r.item_id, r.text) for r in dealt.where(F.col("block") == b).collect()], window)))

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(**sent.value)
            for shard in read(batches):
                yield ask(shard, phrases)

        part = source.mapInArrow(step, _FOUND)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("shard", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).withColumn("spans", _merged("spans"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["length"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` with the words of ``spans`` taken out of ``text``, each with what follows it up to the next word."""
    def make(batch: pa.RecordBatch) -> dict:
        left = []
        for at, texts in byte_slices(batch.column("text")):
            words = tokenise(texts, lower=False, breaks=BARE)
            for i in range(len(texts)):
                lo, hi = words.first[i], words.first[i + 1]
                text = words.data[words.text_at[i]: words.text_at[i + 1]]
                edge = np.append(words.starts[lo:hi], words.text_at[i + 1]) - words.text_at[i]
                stays = np.ones(len(text), bool)
                for span in batch.column("spans")[at + i].as_py() or ():
                    stays[edge[span["start"]]: edge[span["start"] + span["length"]]] = False
                left.append(text[stays].tobytes().decode("utf-8") if batch.column("text")[at + i].is_valid else None)
        return {"text": left}

    return add_columns(rows, make, [rows.schema["text"]])

