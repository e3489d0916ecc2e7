"""Ranked lexical search: short lists summed into accumulators, long lists skipped document by document.

Documents are gathered into shards inside the tasks that read them; an inverted
index of each shard (all terms, whole texts) is staged in the shared folder.
Global counts (documents, terms, holders of each query term) are summed from it.
Every shard is then searched for every item:

* short lists (up to SHORT of the shard's documents) are added up term at a time
  into accumulators, which from then on are one more list: documents in order,
  a sum each, and a largest sum per run of RUN documents;
* this list and the long ones are walked document at a time, run by run.  A run
  whose bounds add up to less than the item's 50th score so far is skipped.
  Inside a run the lists with the smallest bounds, which cannot lift a document
  over that score together, give no candidates; they are only asked for the
  candidates of the others, and no longer once a candidate cannot make it.

A task carries the best rows of an item from shard to shard and returns them
once; they are merged in two steps, so no group grows with the input faster
than a 64th of the tasks.  Items come in blocks of about QUERY_BYTES of text, whose
terms are hashed on the driver and broadcast; the index is read once per block.

Terms are runs of ASCII letters and digits and of all non-ASCII characters,
A-Z lower-cased, compared by 64-bit hashes; all arithmetic is in whole numbers.

Defined results: null and empty texts have no terms; documents with a null id,
and items with a null id, take no part; repeated document rows are documents of
their own; items that share an id are one item with the terms of all its texts;
an item without terms, or an empty table, has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.functions.ordering import stage_table
from plumbline.llm.id_store import spread
from plumbline.llm.sizing import pieces, text_size
from plumbline.llm.words import BARE, byte_slices, tokenise

BEST = 50
SHARD_BYTES = 8 << 20
QUERY_BYTES = 1 << 20  # text of a block of items, or a single item
RUN = 512              # documents
SHORT = 1 / 32         # longest share of a shard's documents that goes into accumulators
_BUCKETS = 64
_INDEX = "doc_ids binary, lengths binary, terms binary, holders binary, docs binary, times binary"


def _least(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes that hold them, led by that width."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _numbers(raw: pa.Buffer) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    return data[1:].view(f"<u{data[0]}").astype(np.int64)


def index_table(docs: DataFrame) -> DataFrame:
    """One row per shard of ``docs`` (doc_id, text): document ids and lengths, sorted terms, lists in order of documents."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, counts, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            lengths = np.concatenate(counts)
            terms, code = np.unique(np.concatenate(hashes), return_inverse=True)
            pairs = np.sort(code * np.int64(len(lengths)) + np.repeat(np.arange(len(lengths)), lengths))
            heads = np.flatnonzero(np.diff(pairs, prepend=-1))
            term, doc = np.divmod(pairs[heads], len(lengths))
            return pa.RecordBatch.from_pydict({
                "doc_ids": [np.concatenate(ids).tobytes()], "lengths": [_least(lengths)], "terms": [terms.tobytes()],
                "holders": [_least(np.bincount(term, minlength=len(terms)))], "docs": [_least(doc)],
                "times": [_least(np.diff(np.append(heads, len(pairs))))]})

        for batch in batches:
            for at, texts in byte_slices(batch.column("text")):
                words = tokenise(texts, lower=True, breaks=BARE)
                ids.append(batch.column("doc_id").slice(at, len(texts)).to_numpy(zero_copy_only=False).astype("<i8"))
                hashes.append(words.hashes()[0])
                counts.append(words.counts())
                size += len(words.data)
                if size >= SHARD_BYTES:
                    yield close()
                    ids, hashes, counts, size = [], [], [], 0
        if ids:
            yield close()

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(step, _INDEX)


def _places(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key, -1 for those that are absent."""
    at = np.searchsorted(sorted_keys, wanted)
    found = np.zeros(len(wanted), bool)
    inside = at < len(sorted_keys)
    found[inside] = sorted_keys[at[inside]] == wanted[inside]
    return np.where(found, at, -1)


@dataclass
class Items:
    """Items of a block: sorted distinct terms, each item's places in them, and the items' ids."""

    terms: np.ndarray
    of_item: list[np.ndarray]
    ids: list

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        found: dict = {}
        for name, text in rows:
            words = tokenise(pa.array([text], pa.large_string()), lower=True, breaks=BARE).hashes()[0]
            found.setdefault(name, []).append(words)
        ids = list(found)
        own = [np.unique(np.concatenate(found[i])) for i in ids]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        return cls(terms, [np.searchsorted(terms, o) for o in own], ids)


def term_counts(index: DataFrame, terms: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the holders of each of ``terms``, summed in Spark from the shards."""
    sent = index.sparkSession.sparkContext.broadcast(terms)  # terms of one block of items

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, n, length, total = sent.value, 0, 0, np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for r in range(len(batch)):
                lengths = _numbers(batch.column("lengths")[r].as_buffer())
                n, length = n + int(np.count_nonzero(lengths)), length + int(lengths.sum())
                at = _places(np.frombuffer(batch.column("terms")[r].as_buffer(), "<u8"), wanted)
                total[at >= 0] += _numbers(batch.column("holders")[r].as_buffer())[at[at >= 0]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *seen.tolist()], pa.int64()), "n": pa.array([n, length, *total[seen].tolist()], pa.int64())})

    rows = index.select("lengths", "terms", "holders").mapInArrow(step, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sums = {r.term: r.n for r in rows}
    holders = np.zeros(len(terms), np.int64)
    for term, n in sums.items():
        if term >= 0:
            holders[term] = n
    return sums.get(-2, 0), sums.get(-1, 0), holders


def weights(n_docs: int, holders: np.ndarray) -> np.ndarray:
    """Whole-number weight of each term from the documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holders], np.int64)


class ShardLists:
    """The lists of a block's terms in one shard, with the score part of every entry and its largest per run of documents."""

    def __init__(self, row: dict[str, pa.Buffer], terms: np.ndarray, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["doc_ids"], "<i8")
        lengths = _numbers(row["lengths"])
        middle = 50 + (50 * lengths * n_docs) // max(n_terms, 1)
        at = _places(np.frombuffer(row["terms"], "<u8"), terms)
        holders = _numbers(row["holders"])
        upto = np.concatenate([[0], np.cumsum(holders)])
        self.size = np.where(at >= 0, holders[at] if len(holders) else 0, 0)
        self.docs, self.begin = spread(_numbers(row["docs"]), upto[at], self.size)
        times, _ = spread(_numbers(row["times"]), upto[at], self.size)
        self.part = (1_000_000_000 * times) // (1000 * times + 20 * middle[self.docs])
        self.runs = -(-len(self.ids) // RUN)
        cell = np.repeat(np.arange(len(terms)), self.size) * self.runs + self.docs // RUN
        self.cell = np.searchsorted(cell, np.arange(len(terms) * self.runs + 1))  # first entry of each list in each run
        self.top = np.zeros(len(terms) * self.runs, np.int64)
        heads = np.flatnonzero(np.diff(cell, prepend=-1))
        if len(heads):
            self.top[cell[heads]] = np.maximum.reduceat(self.part, heads)


def search_shard(lists: ShardLists, terms: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int = BEST) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (scores, document ids) of one item after this shard; ``best`` holds those before it."""
    scores, names = best
    terms = terms[lists.size[terms] > 0]
    if not len(terms):
        return best
    short = terms[lists.size[terms] <= max(1, SHORT * len(lists.ids))]
    long_ = terms[lists.size[terms] > max(1, SHORT * len(lists.ids))]
    # the short lists, term at a time, become one list: sums below 2^53, exact as doubles
    entries, _ = spread(np.arange(len(lists.docs)), lists.begin[short], lists.size[short])
    worth = (lists.part[entries] * np.repeat(weight[short], lists.size[short])).astype(np.float64)
    summed = np.bincount(lists.docs[entries], worth, lists.runs * RUN).astype(np.int64).reshape(lists.runs, RUN)
    cells = long_[:, None] * lists.runs + np.arange(lists.runs)
    bounds = np.concatenate([summed.max(axis=1)[None, :], lists.top[cells] * weight[long_][:, None]])  # list 0: the accumulators
    total = bounds.sum(axis=0)
    for run in np.argsort(-total, kind="stable"):
        limit = int(scores[k - 1]) if len(scores) >= k else 1
        if total[run] < limit:
            break
        bound = bounds[:, run]
        rising = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[rising])
        idle = int(np.searchsorted(below, limit))  # these lists together stay under the limit
        score = summed[run].copy() if 0 in rising[idle:] else np.zeros(RUN, np.int64)
        lead = rising[idle:]
        lead = cells[lead[lead > 0] - 1, run]
        sizes = lists.cell[lead + 1] - lists.cell[lead]
        entries, _ = spread(np.arange(len(lists.docs)), lists.cell[lead], sizes)
        worth = (lists.part[entries] * np.repeat(weight[lead // lists.runs], sizes)).astype(np.float64)
        score += np.bincount(lists.docs[entries] - run * RUN, worth, RUN).astype(np.int64)
        asked = np.flatnonzero(score)
        for j in range(idle - 1, -1, -1):
            asked = asked[score[asked] + below[j] >= limit]
            if not len(asked):
                break
            if rising[j] == 0:
                score[asked] += summed[run][asked]
                continue
            cell = cells[rising[j] - 1, run]
            a, b = lists.cell[cell], lists.cell[cell + 1]
            at = _places(lists.docs[a:b] - run * RUN, asked)
            score[asked[at >= 0]] += lists.part[a + at[at >= 0]] * weight[cell // lists.runs]
        asked = asked[score[asked] >= limit]
        if len(asked):
            scores, names = np.concatenate([scores, score[asked]]), np.concatenate([names, lists.ids[asked + run * RUN]])
            keep = np.lexsort((names, -scores))[:k]
            scores, names = scores[keep], names[keep]
    return scores, names


def search(docs: DataFrame, benchmark: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best rows of ``docs`` (doc_id, text) for each item of ``benchmark`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    index = stage_table(index_table(docs))
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    blocks = pieces(text_size(items)[1], QUERY_BYTES)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    kind = benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("bucket", T.LongType()), T.StructField("score", T.LongType()), T.StructField("doc_id", T.LongType())])
    found = None
    for b in range(blocks):
        asked = Items.of([(r.item_id, r.text) for r in dealt.where(F.col("block") == b).collect()])
        n_docs, n_terms, holders = term_counts(index, asked.terms)
        sent = spark.sparkContext.broadcast((vars(asked), weights(n_docs, holders), n_docs, n_terms))

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            made, weight, n_docs, n_terms = sent.value
            asked, none = Items(**made), np.zeros(0, np.int64)
            best = [(none, none)] * len(asked.ids)
            for batch in batches:
                for r in range(len(batch)):
                    lists = ShardLists({c: batch.column(c)[r].as_buffer() for c in batch.schema.names}, asked.terms, n_docs, n_terms)
                    best = [search_shard(lists, own, weight, kept, k) for own, kept in zip(asked.of_item, best)]
            names = [name for name, (scores, _) in zip(asked.ids, best) for _ in scores]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, to_arrow_type(kind)), pa.array([TaskContext.get().partitionId() % _BUCKETS] * len(names), pa.int64()),
                 pa.array(np.concatenate([none, *[s for s, _ in best]]), pa.int64()), pa.array(np.concatenate([none, *[d for _, d in best]]), pa.int64())],
                schema.names)

        part = index.mapInArrow(step, schema)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc("doc_id")]
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "bucket").orderBy(*order))).where(F.col("rank") <= k)
    return (near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
