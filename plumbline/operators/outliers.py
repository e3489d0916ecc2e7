"""Unusual values by interquartile range, z-score and median absolute deviation.

The statistics of every column are found first (exact, a few scalars each) and
enter the later plan as literals.  Counting flags is then one scan with no
shuffle of data, and outlier rows stay distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import settings
from plumbline.functions.columns import nan_to_null, numeric_columns, percent, ref, rows_from
from plumbline.functions.quantiles import ColumnQuantiles, exact_quantiles


@dataclass
class ColumnStats:
    """Scalars of one column that the detectors work from; nulls are left out."""

    column: str
    dtype: str
    total: int
    filled: int
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    std: float | None = None
    q1: float | None = None
    median: float | None = None
    q3: float | None = None
    mad: float | None = None

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1


Detector = Callable[[ColumnStats, Column], Column]


def _finite(*numbers: float | None) -> bool:
    """No rule flags anything when the numbers it rests on are missing, infinite or NaN."""
    return all(v is not None and math.isfinite(v) for v in numbers)


def iqr_rule(multiplier: float = settings.IQR_MULTIPLIER) -> Detector:
    """Outside the quartiles by more than ``multiplier`` times their distance."""
    def flag(s: ColumnStats, x: Column) -> Column:
        lower, upper = iqr_bounds(s, multiplier)
        return F.lit(False) if not _finite(lower, upper) else (x < lower) | (x > upper)
    return flag


def iqr_bounds(s: ColumnStats, multiplier: float = settings.IQR_MULTIPLIER) -> tuple[float | None, float | None]:
    if s.q1 is None:
        return None, None
    return s.q1 - multiplier * s.iqr, s.q3 + multiplier * s.iqr


def zscore_rule(limit: float = settings.ZSCORE_LIMIT) -> Detector:
    """More than ``limit`` sample standard deviations from the mean."""
    def flag(s: ColumnStats, x: Column) -> Column:
        if s.filled < 2 or not s.std or not _finite(s.mean, s.std):
            return F.lit(False)
        return F.abs((x - s.mean) / s.std) > limit
    return flag


def mad_rule(limit: float = settings.MAD_LIMIT) -> Detector:
    """Modified z-score, scaled by the median absolute deviation, above ``limit``."""
    def flag(s: ColumnStats, x: Column) -> Column:
        if s.filled < 2 or not s.mad or not _finite(s.median, s.mad):
            return F.lit(False)
        return F.abs(F.lit(settings.MAD_SCALE) * (x - s.median) / s.mad) > limit
    return flag


_RULES: dict[str, Callable[[], Detector]] = {"iqr": iqr_rule, "zscore": zscore_rule, "mad": mad_rule}


def register_rule(name: str, make: Callable[[], Detector]) -> None:
    """Add a detector: ``make()`` returns a function from (stats, column) to a boolean Column."""
    _RULES[name] = make


def _chosen(methods: Sequence[str] | None) -> dict[str, Detector]:
    """Detectors by name; unknown names are passed over."""
    wanted = ("iqr", "zscore", "mad") if not methods else methods
    return {m: _RULES[m]() for m in wanted if m in _RULES}


def measure(df: DataFrame, cols: Sequence[str] | None = None,
            methods: Sequence[str] | None = None) -> list[ColumnStats]:
    """Statistics of each column: one search for moments and quartiles, one for deviations.

    Searches that none of the built-in ``methods`` asked for needs are left out; moments alone take one plain aggregate.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return []
    wanted = set(_chosen(methods))
    if wanted - {"zscore"}:
        quart = exact_quantiles(df, cols, [0.25, 0.5, 0.75], moments=True)
    else:
        clean = nan_to_null(df.select(*[ref(c).cast("double").alias(c) for c in cols]))
        row = clean.agg(F.count("*").alias("n"), *[e for i, c in enumerate(cols) for e in (
            F.count(ref(c)).alias(f"n{i}"), F.avg(ref(c)).alias(f"avg{i}"), F.stddev_samp(ref(c)).alias(f"sd{i}"))]).first()
        quart = {c: ColumnQuantiles(row[f"n{i}"], row["n"], row[f"avg{i}"], row[f"sd{i}"]) for i, c in enumerate(cols)}
    spread = exact_quantiles(df, {c: F.abs(ref(c).cast("double") - quart[c].get(0.5))
                                  for c in cols if quart[c].count}, [0.5]) if wanted - {"zscore", "iqr"} else {}
    none = ColumnQuantiles()
    return [ColumnStats(
        column=c, dtype=df.schema[c].dataType.simpleString(), total=quart[c].rows, filled=quart[c].count,
        low=quart[c].low, high=quart[c].high, mean=quart[c].mean, std=quart[c].std,
        q1=quart[c].get(0.25), median=quart[c].get(0.5), q3=quart[c].get(0.75),
        mad=spread.get(c, none).get(0.5)) for c in cols]


def _num(v: float | None) -> Column:
    return F.lit(v).cast("double")


def _note(method: str, s: ColumnStats) -> Column:
    text = None
    if s.filled >= 2:
        if method == "zscore" and s.std == 0:
            text = "No variance in data (all values identical)"
        elif method == "mad" and s.mad == 0:
            text = "No deviation from median (insufficient variation)"
    return F.lit(text).cast("string")


def column_statistics(df: DataFrame, cols: Sequence[str] | None = None,
                      stats: list[ColumnStats] | None = None) -> DataFrame:
    """Type, size, missing count and basic statistics of each numeric column."""
    stats = stats or measure(df, cols)
    rows = [(s.column, s.dtype, s.total, s.total - s.filled, s.low, s.high, s.mean, s.median, s.std) for s in stats]
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, total_values bigint, null_count bigint, min double, max double, "
              "mean double, median double, std double")


def detect(df: DataFrame, cols: Sequence[str] | None = None, methods: Sequence[str] | None = None,
           stats: list[ColumnStats] | None = None) -> DataFrame:
    """Outlier count and share per (column, method), with the numbers the method used."""
    stats = stats or measure(df, cols, methods)
    rules = _chosen(methods)
    aggs, items = [], []
    for i, s in enumerate(stats):
        x = ref(s.column).cast("double")
        lower, upper = iqr_bounds(s)
        for name, rule in rules.items():
            aggs.append(F.count_if(F.coalesce(rule(s, x), F.lit(False))).alias(f"{name}{i}"))
            is_iqr, is_z, is_mad = name == "iqr", name == "zscore", name == "mad"
            items.append({
                "column": F.lit(s.column), "method": F.lit(name), "n": F.lit(s.filled).cast("bigint"),
                "outlier_count": F.col(f"{name}{i}"),
                "outlier_percentage": F.coalesce(percent(F.col(f"{name}{i}"), F.lit(s.filled)), F.lit(0.0)),
                "lower": _num(lower if is_iqr else None), "upper": _num(upper if is_iqr else None),
                "q1": _num(s.q1 if is_iqr else None), "q3": _num(s.q3 if is_iqr else None),
                "iqr": _num(s.iqr if is_iqr else None),
                "mean": _num(s.mean if is_z else None), "std": _num(s.std if is_z else None),
                "median": _num(s.median if is_mad else None), "mad": _num(s.mad if is_mad else None),
                "note": _note(name, s)})
    if not items:
        raise ValueError("no numeric column or no known method")
    return rows_from(nan_to_null(df.select(*[ref(s.column) for s in stats])).agg(*aggs), items)


def flagged_rows(df: DataFrame, key_cols: Sequence[str], cols: Sequence[str] | None = None,
                 methods: Sequence[str] | None = None, stats: list[ColumnStats] | None = None,
                 min_votes: int = 1) -> DataFrame:
    """Rows (keys, column, value, one boolean per method, votes) flagged by at least ``min_votes`` methods.

    A narrow plan: one scan, literal limits, no join and no shuffle.
    """
    stats = stats or measure(df, cols, methods)
    rules = _chosen(methods)
    clean = nan_to_null(df.select(*[ref(c) for c in dict.fromkeys([*key_cols, *[s.column for s in stats]])]))
    cells, any_hit = [], F.lit(False)
    for s in stats:
        x = ref(s.column).cast("double")
        flags = {name: F.coalesce(rule(s, x), F.lit(False)) for name, rule in rules.items()}
        votes = sum((f.cast("int") for f in flags.values()), F.lit(0))
        any_hit = any_hit | (votes >= min_votes)
        cells.append(F.struct(F.lit(s.column).alias("column"), x.alias("value"),
                              *[f.alias(name) for name, f in flags.items()], votes.alias("votes")))
    keys = [ref(k) for k in key_cols]
    return (clean.where(any_hit).select(*keys, F.explode(F.array(*cells)).alias("cell"))
            .where(F.col("cell.votes") >= min_votes).select(*keys, "cell.*"))


def consensus(df: DataFrame, key_cols: Sequence[str], cols: Sequence[str] | None = None,
              methods: Sequence[str] | None = None, stats: list[ColumnStats] | None = None) -> DataFrame:
    """Rows flagged by two or more methods, with their values."""
    return flagged_rows(df, key_cols, cols, methods, stats, settings.CONSENSUS_VOTES).select(
        *[ref(k) for k in key_cols], "column", "value")


def consensus_counts(df: DataFrame, cols: Sequence[str] | None = None, methods: Sequence[str] | None = None,
                     stats: list[ColumnStats] | None = None) -> DataFrame:
    """Consensus rows per column; only columns that have any."""
    stats = stats or measure(df, cols, methods)
    return (flagged_rows(df, [], None, methods, stats, settings.CONSENSUS_VOTES)
            .groupBy("column").agg(F.count("*").alias("consensus_count")))


def summary(df: DataFrame, cols: Sequence[str] | None = None, methods: Sequence[str] | None = None,
            stats: list[ColumnStats] | None = None, name: str = "dataset") -> DataFrame:
    """Outliers per method over all columns, columns with consensus, thresholds: one row."""
    stats = stats or measure(df, cols, methods)
    rules = _chosen(methods)
    per_column = flagged_rows(df, [], None, list(rules), stats).groupBy("column").agg(
        *[F.count_if(F.col(m)).alias(m) for m in rules],
        F.count_if(F.col("votes") >= settings.CONSENSUS_VOTES).alias("agreed"))
    return per_column.agg(
        *[F.coalesce(F.sum(m), F.lit(0).cast("bigint")).alias(f"{m}_outliers") for m in rules],
        F.count_if(F.col("agreed") > 0).alias("consensus_columns")).select(
        F.lit(name).alias("dataset_name"), F.lit(len(stats)).cast("bigint").alias("numeric_columns_analyzed"),
        *[f"{m}_outliers" for m in rules], "consensus_columns",
        F.lit(settings.IQR_MULTIPLIER).alias("iqr_multiplier"),
        F.lit(settings.ZSCORE_LIMIT).alias("zscore_threshold"), F.lit(settings.MAD_LIMIT).alias("mad_threshold"))


def impact(df: DataFrame, cols: Sequence[str] | None = None, methods: Sequence[str] | None = None,
           stats: list[ColumnStats] | None = None) -> DataFrame:
    """Mean and std of each column with and without the rows each method flags."""
    stats = stats or measure(df, cols, methods)
    rules = _chosen(methods)
    aggs, items = [], []
    for i, s in enumerate(stats):
        x = ref(s.column).cast("double")
        for m, rule in rules.items():
            kept = F.when(~F.coalesce(rule(s, x), F.lit(False)), x)
            aggs += [F.avg(kept).alias(f"{m}_avg{i}"), F.stddev_samp(kept).alias(f"{m}_sd{i}")]
            items.append({
                "column": F.lit(s.column), "method": F.lit(m), "mean_all": _num(s.mean), "std_all": _num(s.std),
                "mean_without": F.col(f"{m}_avg{i}"), "std_without": F.col(f"{m}_sd{i}")})
    return rows_from(nan_to_null(df.select(*[ref(s.column) for s in stats])).agg(*aggs), items)
