"""Toxicity by multiple-instance learning: only documents carry labels, sentences carry the blame.

A sentence's chance is a logistic function of the words in it and of their
4, 5 and 6 byte beginnings; a document is toxic unless every sentence is clean
(noisy-or: 1 - prod(1 - p)).  The weights maximise the likelihood of the
document labels, and the fitted sentence chances then say where the offence is.

Defined results: a null or empty text scores 0; rows with a null label, and
held-out rows, teach nothing; repeated rows are scored alike; a document with
contradicting labels counts as toxic, one doc_id with several texts teaches by
the text of smallest hash; a training table without toxic rows gives a model
that scores 0 everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.ordering import stage_table
from plumbline.llm.arrow_steps import add_columns
from plumbline.llm.words import BARE, byte_slices, tokenise

# training rows per class, taken in hash order of doc_id: the bounded sample that the classifier is fitted on
SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
PREFIXES = (4, 5, 6)
FEATURES = 8192      # most features kept by screening
MIN_DOCS = 3         # toxic documents a feature must appear in
STEPS, RATE, SHRINK = 200, 0.25, 0.02
START_BIAS, TOP_BIAS = -6.0, -9.0
_SIEVE_BITS = 20
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    """Sorted feature hashes, their weights, and a bit sieve that lets most words through without a search."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def sieve(self) -> np.ndarray:
        out = np.zeros(1 << _SIEVE_BITS, dtype=bool)
        out[(self.keys >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
        return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sentences(texts: pa.Array):
    """Words, the sentence of each word (numbered over all texts), the first sentence of each text, sentence ends."""
    words = tokenise(texts, lower=True, breaks=BARE)
    ends = np.union1d(np.flatnonzero(_ENDS[words.data]) + 1, words.text_at[1:])
    return words, np.searchsorted(ends, words.starts, side="right"), np.searchsorted(ends, words.text_at, side="right"), ends


def _text_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sentence of each entry, feature hash) of each text, every feature once a sentence; sentences count from 0."""
    words, sentence, _, _ = _sentences(texts)
    hashes = np.stack(words.hashes(*PREFIXES), axis=1) if len(words.starts) else np.zeros((0, 1), np.uint64)
    for a, b in zip(words.first[:-1], words.first[1:]):
        _, own = np.unique(sentence[a:b], return_inverse=True)
        pairs = np.unique(np.stack([np.repeat(own, hashes.shape[1]).astype(np.uint64), hashes[a:b].ravel()], axis=1), axis=0)
        yield pairs[:, 0].astype(np.int64), pairs[:, 1]


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, other documents) that hold it, counted per slice of text."""
    none = np.zeros(0, np.uint64)
    for batch in batches:
        labels = batch.column("toxic").to_numpy()
        for at, texts in byte_slices(batch.column("text")):
            found: dict[int, list] = {0: [none], 1: [none]}
            for i, (_, feats) in enumerate(_text_features(texts)):
                found[int(labels[at + i])].append(np.unique(feats))
            toxic, clean = np.concatenate(found[1]), np.concatenate(found[0])
            keys, code = np.unique(np.concatenate([toxic, clean]), return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(keys.view(np.int64)), "toxic": pa.array(np.bincount(code[: len(toxic)], minlength=len(keys))),
                "clean": pa.array(np.bincount(code[len(toxic):], minlength=len(keys)))})


def _hits(keys: np.ndarray):
    """Per training document: label, number of sentences with words, and (sentence, place in ``keys``) of the features kept."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"sentences": [], "sent": [], "col": []}
            for _, texts in byte_slices(batch.column("text")):
                for sentence, feats in _text_features(texts):
                    k = np.minimum(np.searchsorted(keys, feats), len(keys) - 1)
                    hit = keys[k] == feats
                    out["sentences"].append(int(sentence.max()) + 1 if len(sentence) else 0)
                    out["sent"].append(sentence[hit].astype("<i4").tobytes())
                    out["col"].append(k[hit].astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "sentences": pa.array(out["sentences"], pa.int64()),
                                              "sent": pa.array(out["sent"], pa.binary()), "col": pa.array(out["col"], pa.binary())})

    return step


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs`` (doc_id, text) that are not held out.

    Features are screened by grouped counts; the driver gets only the features kept and, of each sampled document,
    the number of its sentences and where kept features stand.
    """
    learn = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    present = learn.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = present.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    ids = picked.collect()  # at most SAMPLE_TOXIC + SAMPLE_CLEAN pairs
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    toxic_docs = sum(r.toxic for r in ids)
    if not toxic_docs:
        return none
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in ids], "doc_id long, toxic int")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    rows = stage_table(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("place", F.row_number().over(first))
                       .where("place = 1").select("toxic", "text"))
    counts = rows.mapInArrow(_feature_counts, "feature long, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= min(MIN_DOCS, toxic_docs))
    a, b = F.col("toxic") / F.lit(float(toxic_docs)), F.col("clean") / F.lit(float(max(len(ids) - toxic_docs, 1)))
    kept = counts.where(a > 2 * b).orderBy(((a - b) / F.sqrt(a + b)).desc(), "feature").limit(FEATURES).collect()
    if not kept:
        return none
    keys = np.sort(np.array([r.feature for r in kept], dtype=np.int64).view(np.uint64))
    return fit(keys, [(r.toxic, r.sentences, np.frombuffer(r.sent, "<i4"), np.frombuffer(r.col, "<i4"))
                      for r in rows.mapInArrow(_hits(keys), "toxic int, sentences long, sent binary, col binary").collect()])


def fit(keys: np.ndarray, bags: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Model:
    """Noisy-or logistic model of (label, sentences, sentence of each hit, feature of each hit) bags; other sentences count for the bias."""
    y = np.array([b[0] for b in bags], dtype=np.float64)
    sizes = np.array([b[1] for b in bags], dtype=np.int64)
    before, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    sent = np.concatenate([b[2] + at for b, at in zip(bags, before)])
    col = np.concatenate([b[3] for b in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    w = np.zeros(len(keys) + 1)
    w[-1] = START_BIAS
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        z = w[-1] + np.bincount(sent, w[col], total)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))
        pull = np.where(y == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)[doc] * p
        grad = np.append(np.bincount(col, pull[sent], len(keys)) - SHRINK * w[:-1], pull.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        w += RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
        w[-1] = min(w[-1], TOP_BIAS)
    return Model(keys, w[:-1], float(w[-1]))


def score_texts(model: Model, texts: pa.Array, sieve: np.ndarray | None = None):
    """Document scores, number of sentences with words, and the offending sentences (start, length, chance) per text."""
    sieve = model.sieve() if sieve is None else sieve
    words, sentence, first, ends = _sentences(texts)
    n = len(texts)
    busy = np.unique(sentence)
    logit = np.full(len(busy), model.bias)
    pairs = []
    for h in words.hashes(*PREFIXES):
        maybe = np.flatnonzero(sieve[(h >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)])
        if len(maybe):
            k = np.minimum(np.searchsorted(model.keys, h[maybe]), len(model.keys) - 1)
            hit = model.keys[k] == h[maybe]
            pairs.append(np.searchsorted(busy, sentence[maybe[hit]]) * np.int64(1 << 32) + k[hit])
    if pairs:
        each = np.unique(np.concatenate(pairs))  # a feature counts once in a sentence
        logit += np.bincount(each >> 32, model.weights[each & 0xFFFFFFFF], len(busy))
    chance = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    owner = np.searchsorted(first, busy, side="right") - 1
    score = -np.expm1(np.bincount(owner, np.log1p(-np.minimum(chance, 1 - 1e-12)), n)) + 0.0
    spans: list[list[dict]] = [[] for _ in range(n)]
    bad = np.flatnonzero(chance >= 0.5)
    if len(bad):
        chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        for i in bad:
            d, s = int(owner[i]), int(busy[i])
            a = max(int(ends[s - 1]) if s else 0, int(words.text_at[d]))
            spans[d].append({"start": int(chars[a] - chars[words.text_at[d]]), "length": int(chars[ends[s]] - chars[a]),
                             "chance": float(chance[i])})
    return np.clip(score, 0, 1), np.bincount(owner, minlength=n), spans


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from 0.5 on), n_sentences and offending sentences (code points)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))  # plain arrays; at most FEATURES weights

    def make(batch: pa.RecordBatch) -> dict:
        known = Model(*sent.value)
        sieve = known.sieve()
        out = {"score": [], "n_sentences": [], "offending": []}
        for _, texts in byte_slices(batch.column("text")):
            s, n, spans = score_texts(known, texts, sieve)
            out["score"].extend(s.tolist())
            out["n_sentences"].extend(n.tolist())
            out["offending"].extend(spans)
        return out | {"predicted": [int(s >= 0.5) for s in out["score"]]}

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("chance", T.DoubleType())])
    return add_columns(docs, make, [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("n_sentences", T.LongType()), T.StructField("offending", T.ArrayType(span))])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model, fitted on their labels, does not call toxic; columns unchanged.

    A row goes to its task once and comes back, if kept, with the slice of text it was judged in.
    """
    model, at = train(docs, labels), docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        sieve = known.sieve()
        for batch in batches:
            for first, texts in byte_slices(batch.column(at)):
                clean = score_texts(known, texts, sieve)[0] < 0.5
                yield batch.slice(first, len(texts)).filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
