"""Column selection by type, missing-value rules and the input guard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

# strings longer than this are compared by a SHA-256 digest of the whole text
DIGEST_ABOVE = 64


def ref(name: str) -> Column:
    """Column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _TEMPORAL)]


def type_category(dtype: T.DataType) -> str:
    """Three-way label; a boolean counts as numeric here, unlike in the selectors."""
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return "numeric"
    return "datetime" if isinstance(dtype, _TEMPORAL) else "categorical"


def column_types(df: DataFrame) -> dict[str, str]:
    return {f.name: type_category(f.dataType) for f in df.schema}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Make NaN and null the same in floating-point columns (narrow projection)."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema):
        return df
    return df.select(*[
        F.when(~F.isnan(ref(f.name)), ref(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else ref(f.name)
        for f in df.schema
    ])


def value_key(df: DataFrame, name: str) -> Column:
    """A string that is equal for two rows exactly when the column's values are.

    Long texts are replaced by a digest of the whole text so that a distinct
    count does not shuffle them; a digest is longer than any text kept as is.
    """
    dtype = df.schema[name].dataType
    col = ref(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (col + F.lit(0.0)).cast("string")  # -0.0 and 0.0 are one value
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        col = F.to_json(col)
    text = col.cast("string")
    if isinstance(dtype, (T.NumericType, T.BooleanType, *_TEMPORAL)):
        return text
    return F.when(F.length(text) > DIGEST_ABOVE, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


def rows_from(row: DataFrame, items: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row wide aggregate into one output row per item."""
    return row.select(F.inline(F.array(*[
        F.struct(*[c.alias(k) for k, c in item.items()]) for item in items
    ])))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))


def require_table(df: DataFrame | None, min_rows: int = 1, min_cols: int = 1,
                  required: Sequence[str] | None = None) -> bool:
    """True when the table meets every demand; else one error that lists all demands it fails.

    A KeyError when named columns are the only thing missing, a ValueError otherwise.
    Reads at most ``min_rows`` rows, never the whole table.
    """
    if df is None:
        raise ValueError("no table given")
    rows_needed = max(min_rows, 1)
    absent = sorted(set(required or ()) - set(df.columns))
    unmet = [f"at least {rows_needed} row(s), found {n}" for n in [df.limit(rows_needed).count() if df.columns else 0] if n < rows_needed]
    if len(df.columns) < min_cols:
        unmet.append(f"at least {min_cols} column(s), found {len(df.columns)}")
    named = [f"columns {absent}"] if absent else []
    if unmet or named:
        raise (ValueError if unmet else KeyError)("the table lacks: " + "; ".join(unmet + named))
    return True
