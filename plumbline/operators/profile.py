"""Table and column profiles: types, missing values, distinct counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    categorical_columns, datetime_columns, nan_to_null, numeric_columns, percent, ref, rows_from,
    type_category, value_key)


def _null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: ``n`` and ``m0..mk``, the missing count of each column."""
    return nan_to_null(df.select(*[ref(c) for c in cols])).agg(
        F.count("*").alias("n"),
        *[F.count_if(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])


def column_classes(df: DataFrame) -> DataFrame:
    """Type label of every column, the selector it falls under, and its filled rows."""
    cols = df.columns
    picked = {c: "numeric" for c in numeric_columns(df)}
    picked |= {c: "categorical" for c in categorical_columns(df)}
    picked |= {c: "datetime" for c in datetime_columns(df)}
    return rows_from(_null_counts(df, cols), [{
        "column": F.lit(c),
        "type_category": F.lit(type_category(df.schema[c].dataType)),
        "selector": F.lit(picked.get(c, "none")),
        "non_null_count": F.col("n") - F.col(f"m{i}"),
    } for i, c in enumerate(cols)])


def missing_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent of the columns that have any."""
    cols = list(cols or df.columns)
    return rows_from(_null_counts(df, cols), [{
        "column": F.lit(c),
        "missing_count": F.col(f"m{i}"),
        "missing_percent": F.bround(percent(F.col(f"m{i}"), F.col("n")), 2),
    } for i, c in enumerate(cols)]).where("missing_count > 0")


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns per class and overall missing share, in one row."""
    cols = df.columns
    counts = _null_counts(df, cols)
    total = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0).cast("bigint"))
    cells = F.col("n") * F.lit(len(cols)).cast("bigint")
    return counts.select(
        F.col("n").alias("n_rows"),
        F.lit(len(cols)).cast("bigint").alias("n_cols"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("n_numeric"),
        F.lit(len(categorical_columns(df))).cast("bigint").alias("n_categorical"),
        F.lit(len(datetime_columns(df))).cast("bigint").alias("n_datetime"),
        total.alias("total_missing"),
        F.coalesce(F.bround(percent(total, cells), 2), F.lit(0.0)).alias("missing_percent"))


def _native_key(df: DataFrame, name: str) -> Column:
    """The value itself for numbers (one type per family), else its text key."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return ref(name).cast("bigint")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return ref(name).cast("double")
    return value_key(df, name)


def _families(df: DataFrame, cols: Sequence[str]) -> list[list[int]]:
    """Column positions that can share one unpivot: whole numbers, floats, the rest."""
    groups: dict[str, list[int]] = {}
    for i, c in enumerate(cols):
        dtype = df.schema[c].dataType
        whole = isinstance(dtype, (T.IntegralType, T.BooleanType))
        kind = "whole" if whole else "float" if isinstance(dtype, (T.FloatType, T.DoubleType)) else "text"
        groups.setdefault(kind, []).append(i)
    return list(groups.values())


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, rsd: float | None = None) -> DataFrame:
    """Rows (column, n_rows, n_missing, n_unique).

    Each column is read once; only distinct (column, value) pairs are shuffled,
    whole numbers, floats and texts each in their own type, and copies of a
    value are merged before the shuffle.  With
    ``rsd`` the distinct count is approximate and nothing but sketches move.
    """
    cols = list(cols or df.columns)
    clean = nan_to_null(df.select(*[ref(c) for c in cols]))
    if rsd is not None:
        row = clean.agg(F.count("*").alias("n"), *[
            e for i, c in enumerate(cols) for e in (
                F.count_if(ref(c).isNull()).alias(f"m{i}"),
                F.approx_count_distinct(value_key(clean, c), rsd).alias(f"u{i}"))])
        return rows_from(row, [{
            "column": F.lit(c), "n_rows": F.col("n"), "n_missing": F.col(f"m{i}"), "n_unique": F.col(f"u{i}"),
        } for i, c in enumerate(cols)])
    per_value = None
    for family in _families(clean, cols):
        ids = [str(i) for i in family]
        pairs = clean.select(*[_native_key(clean, cols[i]).alias(str(i)) for i in family]).unpivot([], ids, "c", "v")
        counted = (pairs.groupBy("c", "v").agg(F.count("*").alias("n"))
                   .select("c", F.col("v").isNull().alias("empty"), "n"))
        per_value = counted if per_value is None else per_value.unionByName(counted)
    found = per_value.groupBy("c").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("empty"), F.col("n")).otherwise(0)).alias("n_missing"),
        F.count_if(~F.col("empty")).alias("n_unique"))
    # an empty table still gets one row per column
    row = found.agg(*[
        F.coalesce(F.max(F.when(F.col("c") == str(i), F.col(k))), F.lit(0).cast("bigint")).alias(f"{k}{i}")
        for i in range(len(cols)) for k in ("n_rows", "n_missing", "n_unique")])
    return rows_from(row, [{
        "column": F.lit(c), "n_rows": F.col(f"n_rows{i}"), "n_missing": F.col(f"n_missing{i}"),
        "n_unique": F.col(f"n_unique{i}"),
    } for i, c in enumerate(cols)])


def column_info(df: DataFrame, cols: Sequence[str] | str | None = None) -> DataFrame:
    """Type, distinct count, missing share and constancy of columns (all by default)."""
    cols = [cols] if isinstance(cols, str) else list(cols or df.columns)
    for c in cols:
        if c not in df.columns:
            raise KeyError(f"Column '{c}' not found in DataFrame")
    of = {c: df.schema[c].dataType for c in cols}
    kind = F.create_map(*[F.lit(x) for c in cols for x in (c, type_category(of[c]))])
    dtype = F.create_map(*[F.lit(x) for c in cols for x in (c, of[c].simpleString())])
    return distinct_counts(df, cols).select(
        "column",
        dtype[F.col("column")].alias("dtype"),
        kind[F.col("column")].alias("type_category"),
        "n_unique", "n_missing",
        F.bround(percent(F.col("n_missing"), F.col("n_rows")), 2).alias("missing_percent"),
        (F.col("n_unique") <= 1).alias("is_constant"))
