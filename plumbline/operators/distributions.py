"""How single variables are distributed: summaries, frequencies, histograms, shape.

Quartiles come first as exact scalars; the passes that follow use them as
literals and only ever move bin counts between tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    categorical_columns, nan_to_null, numeric_columns, percent, ref, rows_from)
from plumbline.functions.ordering import running_fold
from plumbline.functions.quantiles import ColumnQuantiles, exact_quantiles
from plumbline.functions.tails import lilliefors_p

# density estimate: bin width and reach of a bin in bandwidths, and curve points
BIN_SHARE, REACH = 1 / 64, 9.0
DENSITY_POINTS = 200


def _number(value: float | None) -> Column:
    return F.lit(value).cast("double")


def _numeric(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols is not None else numeric_columns(df)


def _doubles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return nan_to_null(df.select(*[ref(c).cast("double").alias(c) for c in cols]))


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max and missing share per column: all from the quartile search."""
    cols = _numeric(df, cols)
    found = exact_quantiles(df, cols, [0.25, 0.5, 0.75], moments=True)
    missing = {c: F.lit(s.rows - s.count).cast("bigint") for c, s in found.items()}
    return rows_from(df.sparkSession.range(1), [{
        "column": F.lit(c), "count": F.lit(s.count).cast("bigint"), "mean": _number(s.mean), "std": _number(s.std),
        "min": _number(s.low), "p25": _number(s.get(0.25)), "p50": _number(s.get(0.5)), "p75": _number(s.get(0.75)),
        "max": _number(s.high), "missing": missing[c],
        "missing_percent": F.bround(percent(missing[c], F.lit(s.rows).cast("bigint")), 2),
    } for c, s in found.items()])


def frequencies(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, value, count, percent); a missing value is a value of its own.

    One scan and one shuffle for all columns; equal values are merged first.
    """
    cols = list(cols) if cols is not None else categorical_columns(df)
    clean = nan_to_null(df.select(*[ref(c) for c in cols]))
    counts = (clean.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("value")) for c in cols])))
        .groupBy("column", "value").agg(F.count("*").alias("count")))
    # every column has the same number of rows, so the total is one scalar per column name
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "count", percent(F.col("count"), F.col("total")).alias("percent"))


def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int | None = None) -> DataFrame:
    """Frequency bars: the frequency table, most frequent first, the ``k`` longest if given."""
    bars = frequencies(df, cols).orderBy(
        F.col("count").desc(), F.col("column"), F.col("value").asc_nulls_last())
    return bars if k is None else bars.limit(k)


def modes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per column and its count; ties go to the smallest value."""
    cols = list(cols) if cols is not None else categorical_columns(df)
    best = F.min(F.struct(-F.col("count"), F.col("value").isNull().alias("empty"), F.col("value")))
    found = frequencies(df, cols).groupBy("column").agg(
        best.alias("best"), F.sum(F.when(F.col("value").isNull(), F.col("count")).otherwise(0)).alias("missing"),
        F.sum("count").alias("n"))
    row = found.agg(*[F.max(F.when(F.col("column") == c, F.struct(
        F.col("best.value").alias("top"), (-F.col("best.col1")).alias("top_count"), "missing", "n"))).alias(f"r{i}")
        for i, c in enumerate(cols)])
    zero = F.lit(0).cast("bigint")
    return rows_from(row, [{
        "column": F.lit(c), "top": F.col(f"r{i}.top"), "top_count": F.coalesce(F.col(f"r{i}.top_count"), zero),
        "missing": F.coalesce(F.col(f"r{i}.missing"), zero),
        "missing_percent": F.coalesce(
            F.bround(percent(F.col(f"r{i}.missing"), F.col(f"r{i}.n")), 2), F.lit(0.0)),
    } for i, c in enumerate(cols)])


def _auto_bins(q: ColumnQuantiles, integral: bool) -> tuple[float, int]:
    """First edge and number of equal bins: the narrower of the Freedman-Diaconis and
    Sturges widths, the former not below half the square-root width, so that there
    are never more than about 2*sqrt(n) bins."""
    spread = q.high - q.low
    if spread == 0:
        return q.low - 0.5, 1
    fd = 2.0 * (q.get(0.75) - q.get(0.25)) * q.count ** (-1.0 / 3.0)
    width = min(max(fd, spread / math.sqrt(q.count) / 2.0), spread / (math.log2(q.count) + 1.0))
    if integral and width < 1:
        width = 1.0
    return q.low, max(1, math.ceil(spread / width))


def histogram(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, bin, lo, hi, count) of the non-empty automatic bins of each column's finite values."""
    cols = _numeric(df, cols)
    finite = df.select(*[F.when(F.abs(ref(c).cast("double")) < float("inf"), ref(c)).alias(c) for c in cols])
    found = exact_quantiles(finite, cols, [0.25, 0.75])
    cols = [c for c in cols if found[c].count]
    schema = "column string, bin bigint, n_bins bigint, lo double, hi double, count bigint"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    cells = []
    for c in cols:
        start, bins = _auto_bins(found[c], isinstance(df.schema[c].dataType, T.IntegralType))
        width = (found[c].high - found[c].low) / bins if found[c].high > found[c].low else 1.0
        x = ref(c).cast("double")
        cells.append(F.struct(
            F.lit(c).alias("column"),
            F.when(x.isNotNull(), F.least(F.floor((x - start) / width), F.lit(bins - 1).cast("bigint"))).alias("bin"),
            F.lit(bins).cast("bigint").alias("n_bins"), F.lit(float(start)).alias("start"),
            F.lit(float(width)).alias("width")))
    return (nan_to_null(finite.select(*[ref(c) for c in cols])).select(F.inline(F.array(*cells)))
            .where("bin is not null").groupBy("column", "bin", "n_bins", "start", "width")
            .agg(F.count("*").alias("count"))
            .select("column", "bin", "n_bins", (F.col("start") + F.col("bin") * F.col("width")).alias("lo"),
                    (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("hi"), "count"))


def density(df: DataFrame, cols: Sequence[str] | None = None, points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian density curve with Scott's bandwidth: rows (column, point, x, density).

    The rows are first merged into bins of a fixed small part of the bandwidth,
    whatever the range; only bins with rows are kept.  A bin adds to the grid
    points within REACH bandwidths by the mean of its values, corrected for their
    spread, so the error is of third order in (bin width / bandwidth).  Infinite values are left out.
    """
    cols = _numeric(df, cols)
    values = _doubles(df, cols)
    values = values.select(*[F.when(F.abs(ref(c)) < float("inf"), ref(c)).alias(c) for c in cols])
    stats = values.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(ref(c)).alias(f"n{i}"), F.stddev_samp(ref(c)).alias(f"sd{i}"),
        F.min(ref(c)).alias(f"lo{i}"), F.max(ref(c)).alias(f"hi{i}"))]).first() if cols else None
    cells = []
    for i, c in enumerate(cols):
        n, sd, lo, hi = (stats[f"{k}{i}"] for k in ("n", "sd", "lo", "hi"))
        if not n or n < 2 or not sd:
            continue  # no curve for a constant or near-empty column
        cells.append(F.struct(
            F.lit(c).alias("column"), ref(c).alias("v"),
            F.floor((ref(c) - lo) / (sd * n ** -0.2 * BIN_SHARE)).alias("bin"), F.lit(lo).alias("lo"),
            F.lit((hi - lo) / (points - 1)).alias("step"), F.lit(sd * n ** -0.2).alias("h"),
            F.lit(n).cast("bigint").alias("n")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, point bigint, x double, density double")
    merged = (values.select(F.inline(F.array(*cells))).where("v is not null")
              .groupBy("column", "bin", "lo", "step", "h", "n")
              .agg(F.count("*").alias("weight"), F.avg("v").alias("at"), F.var_pop("v").alias("var")))
    first = F.greatest(F.ceil((F.col("at") - REACH * F.col("h") - F.col("lo")) / F.col("step")), F.lit(0).cast("bigint"))
    last = F.least(F.floor((F.col("at") + REACH * F.col("h") - F.col("lo")) / F.col("step")), F.lit(points - 1).cast("bigint"))
    near = merged.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("point"))
    # grid points that no bin reaches have density 0
    grid = merged.select("column", "lo", "step", "h", "n").distinct().select("*", F.explode(
        F.sequence(F.lit(0), F.lit(points - 1)).cast("array<bigint>")).alias("point"))
    curve = near.unionByName(grid.withColumn("weight", F.lit(0).cast("bigint")).withColumn("at", F.col("lo"))
                             .withColumn("var", F.lit(0.0)), allowMissingColumns=True)
    x = F.col("lo") + F.col("point") * F.col("step")
    u = (x - F.col("at")) / F.col("h")
    return (curve.groupBy("column", "point", x.alias("x"), "h", "n")
            .agg(F.sum(F.col("weight") * F.exp(u * u * -0.5) * (
                1 + (u * u - 1) * F.col("var") / (2 * F.col("h") * F.col("h")))).alias("total"))
            .select("column", "point", "x",
                    (F.col("total") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density")))


def box_stats(df: DataFrame, cols: Sequence[str] | None = None, whisker: float = 1.5) -> DataFrame:
    """Box-plot numbers: quartiles, whisker ends and the points outside them."""
    cols = _numeric(df, cols)
    quart = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs, items = [], []
    for i, c in enumerate(cols):
        q1, q3 = quart[c].get(0.25), quart[c].get(0.75)
        reach = whisker * (q3 - q1) if quart[c].count else None
        x = ref(c)
        lower, upper = (_number(q1 - reach), _number(q3 + reach)) if quart[c].count else (_number(None),) * 2
        aggs += [F.min(F.when(x >= lower, x)).alias(f"lo{i}"), F.max(F.when(x <= upper, x)).alias(f"hi{i}"),
                 F.count_if((x < lower) | (x > upper)).alias(f"out{i}")]
        items.append({"column": F.lit(c), "q1": _number(q1), "median": _number(quart[c].get(0.5)), "q3": _number(q3),
                      "whisker_low": F.col(f"lo{i}"), "whisker_high": F.col(f"hi{i}"), "n_outside": F.col(f"out{i}")})
    return rows_from(_doubles(df, cols).agg(*aggs), items)


def shape(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Population skewness, excess kurtosis and the Jarque-Bera normality statistic."""
    cols = _numeric(df, cols)
    row = _doubles(df, cols).agg(*[e for i, c in enumerate(cols) for e in (
        F.count(ref(c)).alias(f"n{i}"), F.skewness(ref(c)).alias(f"s{i}"), F.kurtosis(ref(c)).alias(f"k{i}"))])
    items = []
    for i, c in enumerate(cols):
        jb = F.col(f"n{i}") / 6.0 * (F.pow(f"s{i}", F.lit(2.0)) + F.pow(f"k{i}", F.lit(2.0)) / 4.0)
        items.append({
            "column": F.lit(c), "n": F.col(f"n{i}"), "skewness": F.col(f"s{i}"), "kurtosis": F.col(f"k{i}"),
            "jarque_bera": jb, "jarque_bera_p": F.exp(-jb / 2.0)})  # chi-square upper tail with 2 df
    return rows_from(row, items)


def normality_ks(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance of each column from the normal with its own mean and std, with the Lilliefors p-value.

    Equal values are merged first; one range sort then serves all columns, and each task returns its largest gap per column.
    Columns with fewer than 4 finite values, or only one value, have no line.
    """
    cols = _numeric(df, cols)
    long = _doubles(df, cols).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), ref(c).alias("value")) for c in cols]))).where(
        "value is not null and abs(value) < double('infinity')")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    facts = {r["column"]: (r.n, r.mean, r.sd) for r in long.groupBy("column").agg(  # a line per column
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).collect() if r.n >= 4 and r.sd > 0}

    def gaps(column: str, before: np.ndarray, rows: pa.RecordBatch) -> dict:
        n, mean, sd = facts[column]
        share = np.array([0.5 * math.erfc(-z) for z in ((rows.column("value").to_numpy() - mean) / (sd * math.sqrt(2.0))).tolist()])
        upto = before + rows.column("n").to_numpy()
        return {"column": [column], "gap": [float(max((upto / n - share).max(), (share - before / n).max()))]}

    found = (running_fold(counts.where(F.col("column").isin(list(facts))), "column", ["value"], "n", gaps, "column string, gap double")
             .groupBy("column").agg(F.max("gap").alias("statistic")))
    size = F.create_map(*[F.lit(x) for c, (n, _, _) in facts.items() for x in (c, n)]) if facts else F.lit(None).cast("map<string,bigint>")
    sized = found.withColumn("n", size[F.col("column")].cast("bigint"))
    return sized.select("column", "n", "statistic", lilliefors_p(F.col("statistic"), F.col("n")).alias("p_value"))


def tails(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """1, 5, 95 and 99 % points and the share of rows beyond each."""
    cols = _numeric(df, cols)
    probs = {"p01": 0.01, "p05": 0.05, "p95": 0.95, "p99": 0.99}
    found = exact_quantiles(df, cols, list(probs.values()))
    aggs, items = [], []
    for i, c in enumerate(cols):
        item = {"column": F.lit(c), "n": F.col(f"n{i}")}
        aggs.append(F.count(ref(c)).alias(f"n{i}"))
        for key, p in probs.items():
            limit = _number(found[c].get(p))
            aggs.append(F.count_if(ref(c) < limit if p < 0.5 else ref(c) > limit).alias(f"{key}_{i}"))
            item[key] = limit
            item[f"share_beyond_{key}"] = F.try_divide(F.col(f"{key}_{i}").cast("double"), F.col(f"n{i}"))
        items.append(item)
    return rows_from(_doubles(df, cols).agg(*aggs), items)
