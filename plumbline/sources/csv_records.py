"""CSV records with quoted line breaks, read by many tasks per file.

Whether a line break ends a record depends on all quotes before it, so a file
looks as if one task had to read it from its start.  Here every split is read
from both possible states, outside and inside a quoted field, at once: a split
becomes a small function from the state at its first line to the state after its
last.  These functions are composed over the splits of each file, which gives
the state every split really starts in.  A second pass then cuts the lines into
records; the few pieces of records that cross a split are put together by a
shuffle of those pieces alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE, COMMA = '"', ","


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is still open after ``line``; a quote opens a field at its start only, a doubled one is a character."""
    at = 0
    if not inside:
        inside, at = line.startswith(QUOTE), int(line.startswith(QUOTE))
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line.startswith(QUOTE, at + 1):
                at += 2
                continue
        at = line.find(COMMA, at)
        if at < 0:
            return False
        inside, at = line.startswith(QUOTE, at + 1), at + 1 + int(line.startswith(QUOTE, at + 1))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and the first byte of the split they come from, in order within a split."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Rows of one split each."""
    if not len(batch):
        return
    split = batch.column("split").to_numpy()
    file = batch.column("file").dictionary_encode()
    codes = file.indices.to_numpy()
    cuts = [0, *(np.flatnonzero((np.diff(split) != 0) | (np.diff(codes) != 0)) + 1).tolist(), len(batch)]
    for a, b in zip(cuts, cuts[1:]):
        yield (file.dictionary[int(codes[a])].as_py(), int(split[a])), batch.slice(a, b - a)


def _quoted(rows: pa.RecordBatch) -> np.ndarray:
    """Places of the lines that hold a quote; no other line changes the state."""
    return np.flatnonzero(pc.greater(pc.count_substring(rows.column("value"), QUOTE), 0).to_numpy(zero_copy_only=False))


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, state after it from outside and from inside, whether a field open at its start closes in it)."""
    held, states, closes = None, [False, True], False

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [held[0]], "split": pa.array([held[1]], pa.int64()), "outside": [states[0]],
                                           "inside": [states[1]], "closes": [closes]})

    for batch in batches:
        for key, rows in _runs(batch):
            if key != held:
                if held:
                    yield told()
                held, states, closes = key, [False, True], False
            for i in _quoted(rows):
                line = rows.column("value")[int(i)].as_py()
                after = [inside_after(line, False), inside_after(line, True)]
                states = [after[int(s)] for s in states]
                closes |= not states[1]
    if held:
        yield told()


def _starts(splits: list) -> tuple[dict, dict, bool]:
    """State at the start of each split, for those inside a record the split in which it began, and whether a file ends in an open field."""
    inside, began, open_end = {}, {}, False
    file, state, origin = None, False, None
    for r in sorted(splits, key=lambda r: (r.file, r.split)):
        if r.file != file:
            open_end |= state
            file, state, origin = r.file, False, None
        inside[r.file, r.split] = state
        if state:
            began[r.file, r.split] = origin
        crossed = state and not r.closes
        state = r.inside if state else r.outside
        if state and not crossed:
            origin = r.split
    return inside, began, open_end or state


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record that is not empty: ``record`` (line breaks in quotes kept), and ``head``, true for the first of a file."""
    lines = _lines(spark, path)
    # a line per split: as many as the scan has tasks
    inside, began, open_end = _starts(lines.mapInArrow(_transitions, "file string, split long, outside boolean, inside boolean, closes boolean").collect())
    sent = spark.sparkContext.broadcast((inside, began))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, began = sent.value
        held, open_, parts, first = None, False, [], True

        def made(texts: list[str], heads: list[bool], chains: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "file": pa.array([held[0]] * len(texts), pa.string()), "chain": pa.array(chains, pa.int64()),
                "place": pa.array([held[1]] * len(texts), pa.int64()), "head": pa.array(heads, pa.bool_()), "record": pa.array(texts, pa.string())})

        def rest() -> pa.RecordBatch:  # of a record that goes on in the next split, and maybe came from one before
            return made(["\n".join(parts)], [first and held[1] == 0], [began.get(held, held[1]) if first else held[1]])

        for batch in batches:
            for key, rows in _runs(batch):
                if key != held:
                    if parts:
                        yield rest()
                    held, open_, parts, first = key, inside[key], [], True
                texts, heads, chains = [], [], []
                marked = set(_quoted(rows).tolist())
                for i, line in enumerate(rows.column("value").to_pylist()):
                    if i in marked:
                        open_ = inside_after(line, open_)
                    parts.append(line)
                    if not open_:
                        texts.append("\n".join(parts).removesuffix("\r"))
                        heads.append(first and key[1] == 0)
                        chains.append(began.get(key) if first else None)
                        parts, first = [], False
                if texts:
                    yield made(texts, heads, chains)
        if parts:
            yield rest()

    pieces = lines.mapInArrow(cut, "file string, chain long, place long, head boolean, record string")
    whole = pieces.where("chain is null").select("record", "head")
    if began or open_end:
        joined = pieces.where("chain is not null").groupBy("file", "chain").agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "record"))), lambda p: p["record"]), "\n").alias("record"),
            F.bool_or("head").alias("head"))
        whole = whole.unionByName(joined.select("record", "head"))
    return whole.where("record <> ''")
