"""A global row order at any size: dense index, running totals, neighbour blocks.

A window without a partition key puts every row into one task.  Here the rows
are range-sorted over the cluster and written once to the checkpoint folder;
row numbers and running totals then need only one offset per partition.
Lags and centred frames use blocks of consecutive rows that also hold copies
of the few rows next to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 32_768
_ROW_IN_PARTITION = (1 << 33) - 1


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; without one, a folder below the warehouse, which executors share too."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/plumbline-work"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


_STAGED: list[str] = []


def release_staged(spark: SparkSession) -> None:
    """Delete the tables this process has staged so far; results that still read them must be written before."""
    jvm = spark.sparkContext._jvm
    while _STAGED:
        path = jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and cut the lineage; partitions stay as they are."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the checkpoint folder and read it back.

    For loops: unlike a checkpoint, the result carries no knowledge of the plan
    that made it, so plans do not grow from round to round.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _range_sorted(df: DataFrame, group: Sequence[str], by: Sequence[str | Column]) -> DataFrame:
    order = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in (*group, *by)]
    # the file position splits a run of otherwise identical rows over several partitions
    spot = F.monotonically_increasing_id()
    return materialise(df.withColumn("_spot", spot).orderBy(*order, "_spot").drop("_spot"))


def _offsets(ordered: DataFrame, group: str, totals: dict[str, Column]) -> dict[tuple, dict[str, float]]:
    """What each partition must add per group: totals of the partitions before it.

    Holds one entry per (partition, group); groups are the columns of the table.
    """
    per_part = (ordered.groupBy(F.spark_partition_id().alias("pid"), F.col(group).alias("g"))
                .agg(F.count("*").alias("rows"), *[F.sum(c).alias(k) for k, c in totals.items()])
                .orderBy("pid", "g").collect())
    so_far: dict[str, dict[str, float]] = {}
    out = {}
    for r in per_part:
        seen = so_far.setdefault(r.g, {k: 0 for k in ("rows", *totals)})
        out[(r.pid, r.g)] = dict(seen)
        for k in seen:
            seen[k] += r[k] or 0
    # groups start inside a partition: rows of earlier groups there are skipped in the row number
    inside: dict[int, int] = {}
    for r in per_part:
        out[(r.pid, r.g)]["skip"] = inside.get(r.pid, 0)
        inside[r.pid] = inside.get(r.pid, 0) + r["rows"]
    return out


def ordered_index(df: DataFrame, group: str, by: Sequence[str | Column]) -> DataFrame:
    """Add ``idx``: 0, 1, 2... within each ``group`` in the given order (few groups, any number of rows).

    The result is range-partitioned, sorted and checkpointed.
    """
    ordered = _range_sorted(df, [group], by)
    spots = [(pid, g, o["rows"] - o["skip"]) for (pid, g), o in _offsets(ordered, group, {}).items()]
    base = df.sparkSession.createDataFrame(
        spots, T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_g", df.schema[group].dataType),
                             T.StructField("_base", T.LongType())]))
    placed = ordered.select("*", F.spark_partition_id().alias("_pid"),
                            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_IN_PARTITION)).alias("_row"))
    return (placed.alias("r").join(
        F.broadcast(base.alias("p")), (F.col("r._pid") == F.col("p._pid")) & F.col(f"r.{group}").eqNullSafe(F.col("p._g")))
        .select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._row") + F.col("p._base")).alias("idx")))


def running_totals(df: DataFrame, group: str, by: Sequence[str | Column], totals: Sequence[str]) -> DataFrame:
    """Add ``before_<c>``: the sum of ``c`` over earlier rows of the same group.

    One range sort; each partition then streams its batches carrying one number
    per total, so no group has to fit into a task.
    """
    ordered = _range_sorted(df, [group], by)
    sent = df.sparkSession.sparkContext.broadcast(_offsets(ordered, group, {c: F.col(c) for c in totals}))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, offsets = TaskContext.get().partitionId(), sent.value
        carry: dict = {}
        for batch in batches:
            pieces = []
            for g, rows in batch.groupby(group, sort=False, dropna=False):
                g = None if pd.isna(g) else g
                start = carry.setdefault(g, {c: offsets[(pid, g)][c] for c in totals})
                rows = rows.copy()
                for c in totals:
                    upto = rows[c].cumsum()
                    rows[f"before_{c}"] = (start[c] + upto - rows[c]).astype("float64")
                    start[c] += upto.iloc[-1]
                pieces.append(rows)
            if pieces:
                yield pd.concat(pieces)

    schema = T.StructType([*df.schema.fields, *[T.StructField(f"before_{c}", T.DoubleType()) for c in totals]])
    return ordered.mapInPandas(stream, schema)


def running_fold(df: DataFrame, group: str, by: Sequence[str | Column], total: str, step: Callable, schema: str) -> DataFrame:
    """``step`` over the rows of each group in order, with what ``total`` (whole numbers) sums to before each row.

    One range sort; each partition is streamed once.  ``step`` gets (group, sums before, rows) for pieces of a group and
    returns a dictionary of columns, or None.
    """
    ordered = _range_sorted(df, [group], by)
    sent = df.sparkSession.sparkContext.broadcast({k: int(v[total]) for k, v in _offsets(ordered, group, {total: F.col(total)}).items()})

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, start = TaskContext.get().partitionId(), {}
        for batch in batches:
            codes = batch.column(group).dictionary_encode()
            names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                g, rows = names[codes[a]], batch.slice(a, b - a)
                n = rows.column(total).to_numpy()
                upto = start.get(g, sent.value[(pid, g)]) + np.cumsum(n)
                start[g] = int(upto[-1])
                made = step(g, upto - n, rows)
                if made:
                    yield pa.RecordBatch.from_pydict(made)

    return ordered.mapInArrow(stream, schema)


def neighbour_blocks(indexed: DataFrame, back: int, ahead: int = 0, block: int = BLOCK_ROWS) -> DataFrame:
    """Add ``blk`` and ``home``: each block also gets copies of ``back`` rows before and ``ahead`` after it.

    Expressions over lags are right on rows with ``home`` true; blocks are equal
    in size, so no task is larger than another.
    """
    block = max(block, 4 * (back + ahead))
    first = F.greatest(F.floor((F.col("idx") - ahead) / F.lit(block)), F.lit(0).cast("bigint"))
    last = F.floor((F.col("idx") + back) / F.lit(block))
    return (indexed.withColumn("blk", F.explode(F.sequence(first, last)))
            .withColumn("home", F.col("blk") == F.floor(F.col("idx") / F.lit(block))))


def block_window(group: str) -> WindowSpec:
    return Window.partitionBy(group, "blk").orderBy("idx")
