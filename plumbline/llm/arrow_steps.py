"""Run an array function over an Arrow batch at a time, keeping the other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _typed(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict], fields: list[T.StructField]) -> DataFrame:
    """``df`` with the columns that ``make`` returns for each batch; a column of the same name is replaced."""
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*df.select(*[f"`{c}`" for c in kept]).schema.fields, *fields])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {f.name: f.type for f in to_arrow_schema(T.StructType(fields))}
        for batch in batches:
            made = make(batch)
            columns = [batch.column(c) for c in kept] + [_typed(made[n], types[n]) for n in names]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    return df.mapInArrow(step, schema)
