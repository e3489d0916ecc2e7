"""Completeness, consistency, validity and type compliance of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import settings
from plumbline.functions.columns import (
    nan_to_null, percent, ref, rows_from, type_category)
from plumbline.operators import profile

# Outcome levels of a field check
OK, WARN, FAIL = "OK", "WARN", "FAIL"


def completeness(df: DataFrame) -> DataFrame:
    """Missing and filled rows per column, with the whole table's completeness on every row."""
    cols = df.columns
    row = nan_to_null(df).agg(
        F.count("*").alias("n"), *[F.count_if(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    total = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0).cast("bigint"))
    overall = F.lit(100.0) - percent(total, F.col("n") * len(cols))
    return rows_from(row, [{
        "column": F.lit(c),
        "null_count": F.col(f"m{i}"),
        "null_percentage": F.bround(percent(F.col(f"m{i}"), F.col("n")), 2),
        "complete_count": F.col("n") - F.col(f"m{i}"),
        "overall_completeness": overall,
    } for i, c in enumerate(cols)])


def consistency(df: DataFrame, cols: Sequence[str] | None = None, rsd: float | None = None) -> DataFrame:
    """Distinct values and repeats per column; a missing value counts as a repeat."""
    repeats = F.col("n_rows") - F.col("n_unique")
    return profile.distinct_counts(df, cols, rsd).select(
        "column", F.col("n_unique").alias("unique_values"), repeats.alias("duplicate_count"),
        percent(repeats, F.col("n_rows")).alias("duplicate_percentage"))


def _bounds(rule: Mapping[str, Any], col: Column) -> list[tuple[str, Column, str]]:
    """(short name, violation, message tail) of each bound; a missing value never violates."""
    checks = []
    if "min" in rule:
        checks.append(("min", F.coalesce(col < F.lit(rule["min"]), F.lit(False)),
                       f" values below minimum {rule['min']}"))
    if "max" in rule:
        checks.append(("max", F.coalesce(col > F.lit(rule["max"]), F.lit(False)),
                       f" values above maximum {rule['max']}"))
    if "allowed" in rule:
        checks.append(("allowed", col.isNotNull() & ~col.isin(list(rule["allowed"])),
                       " values outside the allowed set"))
    return checks


def validity(df: DataFrame, rules: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    """Rows breaking the ``min`` / ``max`` / ``allowed`` rule of each column.

    ``valid_count`` is the rows without any violation of the column's rule;
    ``invalid_count`` adds up the violations of each bound.
    """
    rules = rules or {}
    clean = nan_to_null(df)
    aggs, items = [F.count("*").alias("n")], []
    for i, c in enumerate(df.columns):
        checks = _bounds(rules.get(c, {}), ref(c))
        for name, broken, _ in checks:
            aggs.append(F.count_if(broken).alias(f"{name}{i}"))
        if checks:
            any_broken = checks[0][1]
            for _, broken, _ in checks[1:]:
                any_broken = any_broken | broken
            aggs.append(F.count_if(any_broken).alias(f"any{i}"))
        zero = F.lit(0).cast("bigint")
        notes = [F.when(F.col(f"{name}{i}") > 0, F.concat(F.col(f"{name}{i}").cast("string"), F.lit(tail)))
                 for name, _, tail in checks]
        items.append({
            "column": F.lit(c),
            "valid_count": F.col("n") - (F.col(f"any{i}") if checks else zero),
            "invalid_count": sum((F.col(f"{name}{i}") for name, _, _ in checks), zero),
            "issues": F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>"),
        })
    return rows_from(clean.agg(*aggs), items)


def type_mismatch(df: DataFrame, name: str, expected: str, parse_text: bool = True) -> Column:
    """Aggregate column: filled values of ``name`` that are not of the expected type.

    ``expected`` is int, float, str or datetime; anything else never mismatches.
    Text is judged by whether it parses, or, with ``parse_text=False``, counts as
    text only.  A datetime column either passes whole or fails whole.
    """
    dtype, col = df.schema[name].dataType, ref(name)
    filled, none = F.count(col), F.lit(0).cast("bigint")
    is_text = isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))
    if expected == "datetime":
        if is_text:
            bad = F.count_if(col.isNotNull() & col.try_cast("timestamp").isNull())
            return F.when(bad > 0, filled).otherwise(none)
        return none if type_category(dtype) == "datetime" or isinstance(dtype, T.NumericType) else filled
    if expected == "str":
        return none if is_text else filled
    if expected not in ("int", "float"):
        return none
    if is_text:
        if not parse_text:
            return filled
        target = "bigint" if expected == "int" else "double"
        return F.count_if(col.isNotNull() & col.try_cast(target).isNull())
    whole = isinstance(dtype, (T.IntegralType, T.BooleanType))
    return none if whole or (expected == "float" and isinstance(dtype, T.NumericType)) else filled


def check_fields(df: DataFrame, specs: Sequence[Mapping[str, Any]], parse_text: bool = True) -> DataFrame:
    """Presence, completeness and type of each ``{name, type, required=True}`` in one pass."""
    clean = nan_to_null(df)
    aggs, items = [F.count("*").alias("n")], []
    nothing = F.lit(None).cast("bigint")
    for i, spec in enumerate(specs):
        name, expected = spec["name"], spec["type"]
        head = {"field": F.lit(name), "type_expected": F.lit(expected)}
        if name not in df.columns:
            items.append(head | {
                "status": F.lit(FAIL), "issues": F.array(F.lit(f"Column '{name}' not found")),
                "null_count": nothing, "null_percentage": nothing.cast("double"), "non_null_count": nothing})
            continue
        aggs += [F.count_if(ref(name).isNull()).alias(f"m{i}"),
                 type_mismatch(clean, name, expected, parse_text).alias(f"t{i}")]
        missing, wrong = F.col(f"m{i}"), F.col(f"t{i}")
        share = percent(missing, F.col("n"))
        is_short = F.lit(bool(spec.get("required", True))) & (missing > 0)
        items.append(head | {
            "status": F.when(is_short | (wrong > 0), F.lit(WARN)).otherwise(F.lit(OK)),
            "issues": F.array_compact(F.array(
                F.when(is_short, F.format_string("Missing values: %d (%.2f%%)", missing, share)),
                F.when(wrong > 0, F.format_string("Type mismatch: %d values", wrong)))),
            "null_count": missing, "null_percentage": share, "non_null_count": F.col("n") - missing})
    return rows_from(clean.agg(*aggs), items)


def type_compliance(df: DataFrame, expected: Mapping[str, str], parse_text: bool = True) -> DataFrame:
    """Mismatch count of each column against the type it should have."""
    names = list(expected)
    clean = nan_to_null(df)
    row = clean.agg(*[e for i, c in enumerate(names) for e in (
        F.count(ref(c)).alias(f"n{i}"), type_mismatch(clean, c, expected[c], parse_text).alias(f"t{i}"))])
    return rows_from(row, [{
        "column": F.lit(c), "type_expected": F.lit(expected[c]),
        "checked_count": F.col(f"n{i}"), "mismatch_count": F.col(f"t{i}"),
    } for i, c in enumerate(names)])


def data_summary(df: DataFrame) -> DataFrame:
    """Table summary with the type label of every column beside it."""
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, type_category(f.dataType))])
    return profile.table_summary(df).withColumn("column_types", kinds)


def allowed_values(df: DataFrame, column: str, allowed: Sequence[Any] | DataFrame) -> DataFrame:
    """Values of a column outside an allowed set, with their row counts.

    ``allowed`` is a list, or a one-column DataFrame for long lists; values are
    counted before they are matched, so a frequent value crosses the join once.
    """
    counts = (nan_to_null(df.select(ref(column).alias("value"))).where("value is not null")
              .groupBy("value").agg(F.count("*").alias("n")))
    if isinstance(allowed, DataFrame):
        lookup = allowed.select(ref(allowed.columns[0]).alias("value"))
        return counts.join(lookup, "value", "left_anti")
    return counts.where(~F.col("value").isin(list(allowed)))


def duplicate_records(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct records that occur more than once, with the number of copies."""
    keys = [ref(c) for c in (cols or df.columns)]
    return nan_to_null(df.select(*keys)).groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def issue_records(df: DataFrame, key_cols: Sequence[str], rules: Mapping[str, Mapping[str, Any]] | None = None,
                  required: Sequence[str] = ()) -> DataFrame:
    """One row per broken rule per record: keys, column, issue, value as text."""
    clean = nan_to_null(df)
    found = []
    for c in required:
        found.append(F.when(ref(c).isNull(), F.struct(
            F.lit(c).alias("column"), F.lit("missing").alias("issue"), F.lit(None).cast("string").alias("value"))))
    labels = {"min": "below minimum", "max": "above maximum", "allowed": "not allowed"}
    for c, rule in (rules or {}).items():
        for name, broken, _ in _bounds(rule, ref(c)):
            found.append(F.when(broken, F.struct(
                F.lit(c).alias("column"), F.lit(labels[name]).alias("issue"),
                ref(c).cast("string").alias("value"))))
    if not found:
        raise ValueError("give at least one rule or required column")
    return (clean.select(*[ref(k) for k in key_cols], F.explode(F.array(*found)).alias("found"))
            .where("found is not null").select(*[ref(k) for k in key_cols], "found.*"))


def gates(df: DataFrame, cols: Sequence[str] | None = None, max_missing: float = settings.MAX_MISSING_RATE,
          min_unique: float = settings.MIN_UNIQUE_RATIO,
          max_unique: float = settings.MAX_UNIQUE_RATIO) -> DataFrame:
    """Missing-rate and uniqueness gates per column."""
    missing = F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows").cast("double"))
    unique = F.try_divide(F.col("n_unique").cast("double"), F.col("n_rows").cast("double"))
    return profile.distinct_counts(df, cols).select(
        "column", missing.alias("missing_rate"), unique.alias("unique_ratio"),
        (missing <= max_missing).alias("missing_ok"),
        ((unique >= min_unique) & (unique <= max_unique)).alias("unique_ok"))


def report(df: DataFrame, name: str = "dataset",
           rules: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, DataFrame]:
    """All sections of the quality report; the header holds name, size and time."""
    header = df.agg(F.count("*").alias("total_rows")).select(
        F.lit(name).alias("dataset_name"), "total_rows",
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"), F.current_timestamp().alias("timestamp"))
    return {
        "header": header,
        "completeness": completeness(df),
        "consistency": consistency(df),
        "validity": validity(df, rules),
        "data_summary": data_summary(df),
    }
