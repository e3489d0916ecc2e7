"""Published reports: one folder per run, one per section, and a manifest that is written last.

``<folder>/<run>/<section>`` holds a section as JSON lines or Parquet,
``<folder>/<run>/manifest`` a line per section (format, rows, schema, time).  A
run without a manifest was not finished: readers do not see it, whatever it has
written, and a later run does not touch the files of an earlier one.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "manifest"
_LINE = "run string, section string, format string, n_rows bigint, fields string, finished timestamp"


def _load(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.json(path) if fmt == "json" else reader.parquet(path)


def write_report(sections: Mapping[str, DataFrame], folder: str, fmt: str = "json") -> str:
    """Write the sections and then the manifest of a new run; returns the run's name."""
    if fmt not in ("json", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    if MANIFEST in sections:
        raise ValueError(f"a section cannot be called {MANIFEST!r}")
    run = f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    lines, spark = [], None
    for name, df in sections.items():
        spark, path = df.sparkSession, f"{folder}/{run}/{name}"
        # columns without any value still show up in the JSON lines
        (df.write.option("ignoreNullFields", "false").json if fmt == "json" else df.write.parquet)(path)
        lines.append((run, name, fmt, _load(spark, path, fmt, df.schema).count(), df.schema.json()))
    if lines:  # a line per section
        spark.createDataFrame(lines, _LINE.rsplit(", ", 1)[0]).coalesce(1).withColumn("finished", F.current_timestamp()).write.parquet(
            f"{folder}/{run}/{MANIFEST}")
    return run


def finished_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest lines of all finished runs below ``folder``; without any, an empty table."""
    try:
        return spark.read.schema(_LINE).parquet(f"{folder}/*/{MANIFEST}")
    except AnalysisException:
        return spark.createDataFrame([], _LINE)


def read_report(spark: SparkSession, folder: str, run: str | None = None) -> dict[str, DataFrame]:
    """The sections of a finished run, the last one unless named; raises where there is none.

    A section whose rows are not as many as the manifest says raises too.
    """
    known = finished_runs(spark, folder)
    lines = (known if run is None else known.where(F.col("run") == run)).orderBy(F.desc("finished"), F.desc("run")).collect()
    if not lines:
        raise ValueError(f"no finished run {run or ''} in {folder}")
    sections = {}
    for line in lines:
        if line.run != lines[0].run:
            break
        df = _load(spark, f"{folder}/{line.run}/{line.section}", line.format, T.StructType.fromJson(json.loads(line.fields)))
        if df.count() != line.n_rows:
            raise ValueError(f"section {line.section} of run {line.run} has gained or lost rows")
        sections[line.section] = df
    return sections


def header(spark: SparkSession, configuration: Mapping[str, Any], **facts: Any) -> DataFrame:
    """One row: facts about the run, the time, and the settings used as a JSON text."""
    row = spark.range(1).select(
        *[F.lit(v).alias(k) for k, v in facts.items()], F.current_timestamp().alias("timestamp"),
        F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in configuration.items()])).alias("configuration"))
    return row
