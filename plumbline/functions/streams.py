"""Rows with their neighbours, streamed from partitions that are sorted already.

``ordered_index`` leaves rows range-sorted and numbered.  A lag or a centred
frame then needs no shuffle: every task streams its partition once, in chunks
of consecutive rows, and gets only the few rows beyond its ends from the
partitions next to it.  These border rows are collected behind a check of their
number and broadcast.  Rows that do not lie in order over the partitions, and
borders beyond the check, take the other way: shuffled blocks of equal size that
hold copies of the rows next to them.  Both ways run the same function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ordering import neighbour_blocks

CHUNK_ROWS = 65_536
BORDER_ROWS = 2_000_000  # most border rows (16 bytes each) that are broadcast


@dataclass
class Chunk:
    """Consecutive rows of one group: ``values`` also holds ``lead`` values before them and some after them."""

    group: str
    first: int          # idx of the first row
    rows: pa.Table      # the rows themselves
    values: np.ndarray
    lead: int

    @property
    def own(self) -> np.ndarray:
        return self.values[self.lead: self.lead + len(self.rows)]

    def at(self, offset: int) -> np.ndarray:
        """The value ``offset`` rows further for each row, NaN where there is none."""
        out = np.full(len(self.rows), np.nan)
        a = self.lead + offset
        lo, hi = max(a, 0), min(a + len(out), len(self.values))
        if lo < hi:
            out[lo - a: hi - a] = self.values[lo:hi]
        return out


Step = Callable[[Iterator[Chunk]], Iterator[pa.RecordBatch]]


def _borders(rows: DataFrame, group: str, value: str, back: int, ahead: int) -> dict | None:
    """First and last idx of each group and its border rows; None where the rows lie out of order or are too many."""
    placed = rows.select(group, "idx", F.col(value).cast("double").alias("value"), F.spark_partition_id().alias("pid"))
    ends = placed.groupBy("pid", group).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n")).collect()
    spans: dict = {}
    for r in sorted(ends, key=lambda r: r.lo):
        low, high = spans.get(r[group], (r.lo, r.lo - 1))
        if r.lo != high + 1 or r.n != r.hi - r.lo + 1:
            return None
        spans[r[group]] = (low, r.hi)
    if sum(min(r.n, back) + min(r.n, ahead) for r in ends) > BORDER_ROWS:
        return None
    inner = [(r.pid, r[group], r.lo, r.hi) for r in ends if (r.lo, r.hi) != spans[r[group]]]
    found = {g: (lo, hi, np.zeros(0, np.int64), np.zeros(0)) for g, (lo, hi) in spans.items()}
    if inner and back + ahead:
        bounds = rows.sparkSession.createDataFrame(inner, f"pid int, {group} string, lo long, hi long")  # a row per partition and group
        near = placed.join(F.broadcast(bounds), ["pid", group]).where((F.col("idx") - F.col("lo") < ahead) | (F.col("hi") - F.col("idx") < back))
        table = near.select(group, "idx", "value").toArrow()
        names, at, v = np.array(table.column(group).to_pylist(), dtype=object), table.column("idx").to_numpy(), table.column("value").to_numpy()
        for g, (lo, hi, _, _) in found.items():
            mine = np.flatnonzero(names == g)
            by = mine[np.argsort(at[mine], kind="stable")]
            found[g] = (lo, hi, at[by], v[by])
    return found


def _between(border: tuple, lo: int, hi: int) -> np.ndarray:
    """Values of the rows lo..hi of a group, as far as the group has them."""
    first, last, at, values = border
    lo, hi = max(lo, first), min(hi, last)
    a, b = np.searchsorted(at, lo), np.searchsorted(at, hi, side="right")
    if hi >= lo and b - a != hi - lo + 1:
        raise RuntimeError("partitions changed between two reads of the same rows")
    return values[a:b]


def _chunks(batches: Iterator[pa.RecordBatch], borders: dict, group: str, value: str, back: int, ahead: int) -> Iterator[Chunk]:
    size = max(CHUNK_ROWS, 4 * (back + ahead))
    name, parts, held, before, first = None, [], 0, np.zeros(0), 0

    def close(final: bool) -> Chunk:
        nonlocal parts, held, before, first
        rows = pa.Table.from_batches(parts)
        own = rows.column(value).to_numpy().astype(np.float64)
        n = len(own) if final else len(own) - ahead
        after = _between(borders[name], first + n, first + n + ahead - 1) if final else own[n:]
        made = Chunk(name, first, rows.slice(0, n), np.concatenate([before, own[:n], after]), len(before))
        before = np.concatenate([before, own[:n]])
        before = before[len(before) - min(back, len(before)):]
        parts, held, first = rows.slice(n).to_batches(), len(own) - n, first + n
        return made

    for batch in batches:
        codes = batch.column(group).dictionary_encode()
        names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if names[codes[a]] != name:
                if held:
                    yield close(True)
                name, parts, held, first = names[codes[a]], [], 0, part.column("idx")[0].as_py()
                before = _between(borders[name], first - back, first - 1)
            parts.append(part)
            held += len(part)
            if held >= size + ahead:
                yield close(False)
    if held:
        yield close(True)


def over_neighbours(rows: DataFrame, group: str, back: int, ahead: int, step: Step, schema: str, value: str = "value") -> DataFrame:
    """``step`` over chunks of ``rows`` (group, idx, value and others); a chunk sees ``back`` rows before and ``ahead`` rows after its own."""
    borders = _borders(rows, group, value, back, ahead)
    if borders is None:
        def block(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("idx")
            home = np.flatnonzero(table.column("home").to_numpy(zero_copy_only=False))
            if not len(home):
                return pa.table([[] for _ in names], schema=arrow)
            own = table.slice(home[0], len(home))
            chunk = Chunk(key[0].as_py(), own.column("idx")[0].as_py(), own.select(columns), table.column(value).to_numpy().astype(np.float64), int(home[0]))
            made = [b.cast(arrow) for b in step(iter([chunk]))]
            return pa.Table.from_batches(made, schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        kind = _parse_datatype_string(schema)
        arrow, names, columns = to_arrow_schema(kind), kind.names, rows.columns
        return neighbour_blocks(rows, back, ahead).groupBy(group, "blk").applyInArrow(block, schema)
    sent = rows.sparkSession.sparkContext.broadcast(borders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(_chunks(batches, sent.value, group, value, back, ahead))

    return rows.sortWithinPartitions(group, "idx").mapInArrow(run, schema)


def frame_sums(values: np.ndarray, width: int) -> np.ndarray:
    """Sum of each ``width`` consecutive values by a running sum whose rounding errors are carried along."""
    upto = np.concatenate([[0.0], np.cumsum(values)])
    gained = upto[1:] - upto[:-1]
    lost = (upto[:-1] - (upto[1:] - gained)) + (values - gained)
    rest = np.concatenate([[0.0], np.cumsum(lost)])
    return (upto[width:] - upto[:-width]) + (rest[width:] - rest[:-width])
