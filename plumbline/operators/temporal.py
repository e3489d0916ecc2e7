"""Time series: profile, stationarity, autocorrelation, trend, changepoints, decomposition.

``series_rows`` puts every value column of a table into one long, globally
indexed frame (series, ts, value, idx).  All later steps are aggregates over
``idx``, or stream the sorted partitions with a few rows from their neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import settings
from plumbline.functions import tails
from plumbline.functions.columns import nan_to_null, numeric_columns, percent, ref, rows_from
from plumbline.functions.ordering import block_window, neighbour_blocks, ordered_index, stage_table
from plumbline.functions.streams import Chunk, frame_sums, over_neighbours

_SERIES = "series"


def as_time(df: DataFrame, time_col: str) -> Column:
    """The time column as a timestamp; text that is no time raises."""
    dtype = df.schema[time_col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return ref(time_col)
    return ref(time_col).cast("timestamp_ntz")


def _value_cols(df: DataFrame, time_col: str, value_cols: Sequence[str] | None) -> list[str]:
    return list(value_cols) if value_cols is not None else [c for c in numeric_columns(df) if c != time_col]


def series_rows(df: DataFrame, time_col: str, value_cols: Sequence[str] | None = None,
                key_cols: Sequence[str] = ()) -> DataFrame:
    """Rows (series, ts, value, idx) in time order, missing values left out.

    Equal times are ordered by ``key_cols``, then by value.
    """
    value_cols = _value_cols(df, time_col, value_cols)
    clean = nan_to_null(df.select(*[ref(c) for c in dict.fromkeys([time_col, *value_cols, *key_cols])]))
    long = clean.select(
        as_time(df, time_col).alias("ts"), *[ref(k).alias(f"key{i}") for i, k in enumerate(key_cols)],
        F.inline(F.array(*[F.struct(F.lit(c).alias(_SERIES), ref(c).cast("double").alias("value")) for c in value_cols]))
    ).where("value is not null")
    order = ["ts", *[f"key{i}" for i in range(len(key_cols))], "value"]
    return ordered_index(long, _SERIES, order).select(_SERIES, "ts", "value", "idx")


def profile(df: DataFrame, time_col: str, value_cols: Sequence[str] | None = None) -> DataFrame:
    """Observations, missing share, first and last time and span in whole days per series."""
    value_cols = _value_cols(df, time_col, value_cols)
    clean = nan_to_null(df.select(as_time(df, time_col).alias("_ts"), *[ref(c) for c in value_cols]))
    row = clean.agg(F.count("*").alias("n"), F.min("_ts").alias("start"), F.max("_ts").alias("end"),
                    *[F.count_if(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(value_cols)])
    span = F.extract(F.lit("DAY"), F.col("end") - F.col("start")).cast("bigint")
    return rows_from(row, [{
        _SERIES: F.lit(c), "total_observations": F.col("n"), "missing_values": F.col(f"m{i}"),
        "missing_percentage": F.bround(percent(F.col(f"m{i}"), F.col("n")), 2),
        "start": F.col("start"), "end": F.col("end"), "span_days": span,
    } for i, c in enumerate(value_cols)])


def _per_series(rows: DataFrame) -> DataFrame:
    """One row per series (n, mean, population std, extremes): bounded by the schema."""
    return rows.groupBy(_SERIES).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("low"), F.max("value").alias("high"))


# ---- trend and changepoints -------------------------------------------------

def trend(rows: DataFrame) -> DataFrame:
    """Least-squares slope over the row index, direction, R-squared and level statistics."""
    fit = rows.groupBy(_SERIES).agg(
        F.count("*").alias("n_obs"), F.regr_slope("value", "idx").alias("slope"),
        F.regr_r2("value", "idx").alias("r2"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    enough = F.col("n_obs") >= 3
    noise = F.col("std") / F.col("n_obs")
    way = (F.when((F.col("std") == 0) | (F.abs("slope") < noise), "flat")
           .when(F.col("slope") > 0, "upward").otherwise("downward"))
    return fit.select(
        _SERIES, "n_obs", F.when(enough, F.lit("ok")).otherwise("insufficient_data").alias("status"),
        F.when(enough, F.col("slope")).alias("slope"), F.when(enough, way).alias("direction"),
        F.when(enough, F.when(F.col("std") == 0, 0.0).otherwise(F.col("r2"))).alias("r_squared"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("mean", "std", "min", "max")])


def _facts(rows: DataFrame) -> dict:
    """Size, mean and extremes by series: one entry per value column."""
    return {r[_SERIES]: r for r in _per_series(rows).collect()}


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _steps(rows: DataFrame) -> DataFrame:
    """Each row but the first with its difference from the row before; one stream over the sorted rows."""
    def step(chunks: Iterator[Chunk]) -> Iterator[pa.RecordBatch]:
        for c in chunks:
            change = c.own - c.at(-1)
            there = np.flatnonzero(c.first + np.arange(len(change)) > c.first - c.lead)
            kept = c.rows.take(pa.array(there)).combine_chunks()
            for part in kept.select([_SERIES, "ts", "idx"]).append_column("step", pa.array(change[there])).to_batches():
                yield part

    return over_neighbours(rows.select(_SERIES, "ts", "idx", "value"), _SERIES, 1, 0, step,
                           f"series string, ts {_kind(rows, 'ts')}, idx bigint, step double")


def changepoint_rows(rows: DataFrame, sigmas: float = settings.CHANGEPOINT_SIGMAS, steps: DataFrame | None = None) -> DataFrame:
    """Every row whose step from the row before is far from the mean step.

    The limit is the mean step plus ``sigmas`` standard deviations of the steps (``steps``, where they are at hand).
    """
    steps = _steps(rows) if steps is None else steps
    usual = steps.groupBy(_SERIES).agg(
        F.count("*").alias("n_steps"), F.avg("step").alias("mean_change"), F.stddev_pop("step").alias("std_change"))
    far = F.abs(F.col("step") - F.col("mean_change")) > F.col("mean_change") + sigmas * F.col("std_change")
    return (steps.join(F.broadcast(usual), _SERIES).where((F.col("n_steps") >= 9) & far)
            .select(_SERIES, "idx", "ts", "step"))


def changepoints(rows: DataFrame, sigmas: float = settings.CHANGEPOINT_SIGMAS, steps: DataFrame | None = None) -> DataFrame:
    """Number of changepoints, mean and population std of the steps per series."""
    steps = _steps(rows) if steps is None else steps
    usual = steps.groupBy(_SERIES).agg(
        F.count("*").alias("n_steps"), F.avg("step").alias("mean_change"), F.stddev_pop("step").alias("std_change"))
    limit = F.col("mean_change") + sigmas * F.col("std_change")
    hits = (steps.join(F.broadcast(usual), _SERIES).groupBy(_SERIES)
            .agg(F.count_if(F.abs(F.col("step") - F.col("mean_change")) > limit).alias("hits")))
    sizes = rows.groupBy(_SERIES).agg(F.count("*").alias("n_obs"))
    enough = F.col("n_obs") >= 10
    return sizes.join(F.broadcast(usual), _SERIES, "left").join(F.broadcast(hits), _SERIES, "left").select(
        _SERIES, "n_obs", F.when(enough, F.lit("ok")).otherwise("insufficient_data").alias("status"),
        F.when(enough, F.col("hits")).alias("n_changepoints"),
        F.when(enough, F.col("mean_change")).alias("mean_change"),
        F.when(enough, F.col("std_change")).alias("std_change"))


def first_changepoints(rows: DataFrame, sigmas: float = settings.CHANGEPOINT_SIGMAS,
                       k: int = settings.CHANGEPOINTS_LISTED, steps: DataFrame | None = None) -> DataFrame:
    """The earliest ``k`` changepoints of each series.

    Each block keeps its own first ``k`` before they meet, so no task sees more
    than ``k`` rows per block.
    """
    found = changepoint_rows(rows, sigmas, steps).withColumn("part", F.floor(F.col("idx") / 65_536))
    near = Window.partitionBy(_SERIES, "part").orderBy("idx")
    kept = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    across = Window.partitionBy(_SERIES).orderBy("idx")
    return (kept.withColumn("rank", F.row_number().over(across)).where(F.col("rank") <= k)
            .select(_SERIES, F.col("rank").cast("bigint").alias("rank"), "idx", "ts", "step"))


# ---- autocorrelation --------------------------------------------------------

def _lag_products(rows: DataFrame, lags: int, facts: dict) -> DataFrame:
    """Rows (series, n, lag, total): sums of centred products of values ``lag`` apart, lags 0..``lags``."""
    facts = {name: (r.n, r.mean) for name, r in facts.items()}

    def step(chunks: Iterator[Chunk]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for c in chunks:
            x = c.values - facts[c.group][1]
            own = np.zeros(len(x))
            own[c.lead: c.lead + len(c.rows)] = x[c.lead: c.lead + len(c.rows)]
            found = np.array([float(own[k:] @ x[:len(x) - k]) if k < len(x) else 0.0 for k in range(lags + 1)])
            totals[c.group] = totals.get(c.group, 0.0) + found
        for name, total in totals.items():
            yield pa.RecordBatch.from_pydict({"series": [name] * (lags + 1), "n": [facts[name][0]] * (lags + 1),
                                              "lag": np.arange(lags + 1), "total": total})

    return (over_neighbours(rows.select(_SERIES, "idx", "value"), _SERIES, lags, 0, step, "series string, n bigint, lag bigint, total double")
            .groupBy(_SERIES, "n", "lag").agg(F.sum("total").alias("total")))


def autocorrelation(rows: DataFrame, lags: int = settings.ACF_LAGS) -> DataFrame:
    """Biased autocorrelation at lags 0..``lags`` with the 95 % limit.

    A series with fewer than ``lags + 5`` values gives one row without lag.
    """
    per_lag = Window.partitionBy(_SERIES)  # lags + 1 rows
    sums = _lag_products(rows, lags, _facts(rows)).withColumn(
        "power", F.max(F.when(F.col("lag") == 0, F.col("total"))).over(per_lag))
    enough = F.col("n") >= lags + 5
    return sums.where(enough | (F.col("lag") == 0)).select(
        _SERIES, F.col("n").alias("n_obs"), F.when(enough, F.lit("ok")).otherwise("insufficient_data").alias("status"),
        F.when(enough, F.lit(1.96) / F.sqrt("n")).alias("confidence_limit"),
        F.when(enough, F.col("lag")).alias("lag"),
        F.when(enough, F.try_divide(F.col("total"), F.col("power"))).alias("acf"))


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """Add ``pacf`` to an autocorrelation table (Yule-Walker); null from n/2 lags on.

    Works per series on its few autocorrelations.
    """
    schema = T.StructType([*acf.schema.fields, T.StructField("pacf", T.DoubleType())])

    def finish(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("lag")
        known = table["acf"].notna().all() and table["lag"].notna().all()
        fits = known and len(table) - 1 < table["n_obs"].iloc[0] / 2
        table["pacf"] = tails.partial_autocorrelations(table["acf"].tolist()) if fits else float("nan")
        return table

    return nan_to_null(acf.groupBy(_SERIES).applyInPandas(finish, schema))


def significant_lags(acf: DataFrame, column: str = "acf", k: int = settings.LAGS_LISTED) -> DataFrame:
    """The first ``k`` lags whose correlation is outside the 95 % limit."""
    first = Window.partitionBy(_SERIES).orderBy("lag")
    return (acf.where((F.col("lag") >= 1) & (F.abs(column) > F.col("confidence_limit")))
            .withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
            .select(_SERIES, "lag", column))


# ---- stationarity -----------------------------------------------------------

def adf_max_lag(n: int) -> int:
    """Longest lag tried by the unit-root test."""
    return min(n // 2 - 2, math.ceil(12.0 * (n / 100.0) ** 0.25))


def _adf_row(d: np.ndarray, y: np.ndarray, t: int, lags: int) -> np.ndarray:
    """Target step, constant, level and lagged steps at time ``t``; ``d[t] = y[t] - y[t-1]``."""
    return np.concatenate(([d[t], 1.0, y[t - 1]], d[t - lags:t][::-1]))


def _solve(gram: np.ndarray, n_obs: int) -> tuple[float, float]:
    """(t-statistic of the level, sum of squared residuals) from a Gram matrix led by the target."""
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    g = gram / np.outer(scale, scale)
    inverse = np.linalg.inv(g[1:, 1:])
    beta = inverse @ g[1:, 0]
    ssr = max(float(g[0, 0] - beta @ g[1:, 0]), 0.0)
    sigma2 = ssr / (n_obs - len(beta))
    return float(beta[1] / math.sqrt(sigma2 * inverse[1, 1])), ssr * scale[0] ** 2


_ADF_SCHEMA = ("series string, n_total bigint, status string, statistic double, p_value double, is_stationary boolean, "
               "n_lags bigint, n_obs bigint, critical_1pct double, critical_5pct double, critical_10pct double")


def stationarity(rows: DataFrame) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag chosen by AIC.

    Tasks stream their rows and return the cross products of the regression's columns;
    their sum serves every lag, so the sorted data is read once.  The longest lag grows with
    n^(1/4), and the sums with its square.
    """
    every = _facts(rows)
    facts = {name: (r.n, r.mean) for name, r in every.items() if r.n >= 10 and r.high > r.low}
    longest = max((adf_max_lag(n) for n, _ in facts.values()), default=0)

    def step(chunks: Iterator[Chunk]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for c in chunks:
            n, mean = facts[c.group]
            lags, y = adf_max_lag(n), c.values - mean
            d = np.diff(y, prepend=np.nan)
            at = c.first + np.arange(len(c.rows))
            use = c.lead + np.flatnonzero(at >= lags + 1)
            z = np.empty((len(use), lags + 3))
            if len(use):
                z[:, 0], z[:, 1], z[:, 2] = d[use], 1.0, y[use - 1]
                for k in range(1, lags + 1):
                    z[:, k + 2] = d[use - k]
            grams[c.group] = grams.get(c.group, 0.0) + z.T @ z
            head = np.flatnonzero(at <= lags)  # the first values, for the refit on more rows
            if len(head):
                yield pa.RecordBatch.from_pydict({"series": [c.group] * len(head), "n": [n] * len(head), "i": pa.array([-1] * len(head), pa.int32()),
                                                  "j": pa.array(at[head], pa.int32()), "v": c.own[head] - mean})
        for name, gram in grams.items():
            i, j = np.triu_indices(len(gram))
            yield pa.RecordBatch.from_pydict({"series": [name] * len(i), "n": [facts[name][0]] * len(i), "i": pa.array(i, pa.int32()),
                                              "j": pa.array(j, pa.int32()), "v": gram[i, j]})

    sums = (over_neighbours(rows.where(F.col(_SERIES).isin(list(facts))).select(_SERIES, "idx", "value"), _SERIES, longest + 1, 0, step,
                            "series string, n bigint, i int, j int, v double")
            .groupBy(_SERIES, "n", "i", "j").agg(F.sum("v").alias("v")))

    def finish(table: pd.DataFrame) -> pd.DataFrame:
        series, n = table["series"].iloc[0], int(table["n"].iloc[0])
        lags = adf_max_lag(n)
        body, head = table[table["i"] >= 0], table[table["i"] < 0].sort_values("j")
        gram = np.zeros((lags + 3, lags + 3))
        gram[body["i"], body["j"]] = body["v"]
        gram[body["j"], body["i"]] = body["v"]
        n_common = n - lags - 1
        try:
            scores = []
            for p in range(lags + 1):
                _, ssr = _solve(gram[:p + 3, :p + 3], n_common)
                scores.append(n_common * math.log(ssr / n_common) + 2 * (p + 2))
            best = int(np.argmin(scores))
            full = gram[:best + 3, :best + 3].copy()
            y = head["v"].to_numpy()
            d = np.diff(y, prepend=np.nan)
            for t in range(best + 1, lags + 1):
                z = _adf_row(d, y, t, best)
                full += np.outer(z, z)
            n_obs = n - best - 1
            tau, _ = _solve(full, n_obs)
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            return pd.DataFrame([{"series": series, "n_total": n, "status": "error"}]).reindex(columns=names)
        limits = tails.adf_critical(n_obs)
        p = tails.adf_p(tau)
        return pd.DataFrame([(series, n, "ok", tau, p, p < 0.05, best, n_obs,
                              limits["1%"], limits["5%"], limits["10%"])], columns=names)

    names = [part.split()[0] for part in _ADF_SCHEMA.split(", ")]
    tested = sums.groupBy(_SERIES).applyInPandas(finish, _ADF_SCHEMA)
    rest = rows.sparkSession.createDataFrame(
        [(name, r.n, "insufficient_data" if r.n < 10 else "constant") for name, r in every.items() if name not in facts],
        "series string, n_total bigint, status string")
    return nan_to_null(tested).unionByName(rest, allowMissingColumns=True)


def _running_squares(rows: DataFrame, facts: dict) -> DataFrame:
    """(series, squares): the sum of the squared running sums of the centred values.

    A task returns one line per series: rows, total, and the sums of its own running sums and of their squares; lines in a
    row are joined by B, the total before: sum (B + s)^2 = sum s^2 + 2 B sum s + rows B^2.
    """
    means = {name: r.mean for name, r in facts.items()}

    def step(chunks: Iterator[Chunk]) -> Iterator[pa.RecordBatch]:
        lines: dict[str, list] = {}
        for c in chunks:
            upto = np.cumsum(c.own - means[c.group])
            line = lines.setdefault(c.group, [c.first, 0, 0.0, 0.0, 0.0])
            upto += line[2]
            line[1:] = [line[1] + len(upto), float(upto[-1]), line[3] + float(upto.sum()), line[4] + float(upto @ upto)]
        for name, line in lines.items():
            yield pa.RecordBatch.from_pydict({"series": [name]} | {k: [v] for k, v in zip(("first", "n", "total", "sums", "squares"), line)})

    def join(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("first")
        before = table["total"].cumsum().shift(fill_value=0.0)
        whole = table["squares"] + 2 * before * table["sums"] + table["n"] * before * before
        return pd.DataFrame({"series": [table["series"].iloc[0]], "squares": [float(whole.sum())]})

    lines = over_neighbours(rows.select(_SERIES, "idx", "value"), _SERIES, 0, 0, step,
                            "series string, first bigint, n bigint, total double, sums double, squares double")
    return lines.groupBy(_SERIES).applyInPandas(join, "series string, squares double")  # a line per task


def kpss(rows: DataFrame, lags: int | None = None) -> DataFrame:
    """KPSS test around a constant: small p speaks against stationarity.

    ``lags`` defaults to ceil(12 (n/100)^(1/4)) of each series; products are summed up to the largest once.
    """
    facts = _facts(rows)
    sizes = [r.n for r in facts.values()]

    def default(n: int) -> int:
        return min(n - 1, math.ceil(12.0 * (n / 100.0) ** 0.25))

    most = lags if lags is not None else max(map(default, sizes), default=0)
    # as many branches as there are value columns
    own = F.lit(lags) if lags is not None else F.coalesce(*[F.when(F.col("n") == n, default(n)) for n in dict.fromkeys(sizes)], F.lit(0))
    partial = _running_squares(rows, facts)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2.0 * (1.0 - F.col("lag") / (own + 1.0)))
    long_run = _lag_products(rows, most, facts).where(F.col("lag") <= own).groupBy(_SERIES, "n").agg(F.sum(weight * F.col("total")).alias("long_run"))
    table = long_run.join(F.broadcast(partial), _SERIES).select(
        _SERIES, F.col("n").alias("n_obs"), own.cast("bigint").alias("n_lags"),
        F.try_divide(F.col("squares"), F.col("n") * F.col("long_run")).alias("statistic"))

    @F.pandas_udf("double")
    def look_up(x: pd.Series) -> pd.Series:
        return x.map(tails.kpss_p)

    return table.withColumn("p_value", look_up("statistic"))


# ---- decomposition ----------------------------------------------------------

def _whole_series(df: DataFrame, time_col: str, value_cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """Series without a missing value, and those of them with positive values only."""
    clean = nan_to_null(df.select(*[ref(c) for c in value_cols]))
    row = clean.agg(*[e for i, c in enumerate(value_cols) for e in (
        F.count_if(ref(c).isNull()).alias(f"m{i}"), F.min(ref(c).cast("double")).alias(f"lo{i}"))]).first()
    whole = [c for i, c in enumerate(value_cols) if row[f"m{i}"] == 0]
    positive = [c for i, c in enumerate(value_cols) if c in whole and row[f"lo{i}"] is not None and row[f"lo{i}"] > 0]
    return whole, positive


_PHASES = 200_000


def _smoothed(rows: DataFrame, sizes: dict[str, int], period: int) -> DataFrame:
    """The rows with ``trend``, the centred moving average over one period: one stream, whatever the period."""
    half = period // 2

    def step(chunks: Iterator[Chunk]) -> Iterator[pa.RecordBatch]:
        for c in chunks:
            trend = np.full(len(c.rows), np.nan)
            low, high = max(half - c.first, 0), min(sizes[c.group] - half - c.first, len(trend))  # rows with a whole frame
            if low < high:
                a, b = c.lead + low - half, c.lead + high + half
                sums = frame_sums(c.values[a:b], 2 * half + 1)
                if period % 2 == 0:
                    sums -= (c.values[a: b - 2 * half] + c.values[a + 2 * half: b]) / 2.0
                trend[low:high] = sums / period
            made = c.rows.select([_SERIES, "idx", "ts", "value"]).append_column("trend", pa.array(trend, from_pandas=True))
            yield from made.combine_chunks().to_batches()

    return over_neighbours(rows, _SERIES, half, half, step, f"series string, idx bigint, ts {_kind(rows, 'ts')}, value double, trend double")


def decompose(rows: DataFrame, period: int = settings.SEASONAL_PERIOD, model: str = "additive") -> DataFrame:
    """Classical decomposition: rows (series, method, idx, ts, value, trend, seasonal, residual).

    Trend is the centred moving average over one period (half weights at both
    ends when the period is even) and stays null where the frame is cut; the
    seasonal part is the mean of each phase, centred to sum 0 (mean 1 for the
    ratio form).  Series shorter than two periods are left out, and the
    multiplicative form leaves out series with values of 0 or less.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model {model!r}")
    ratio = model == "multiplicative"
    facts = {name: r.n for name, r in _facts(rows).items() if r.n >= 2 * period and not (ratio and r.low <= 0)}
    kept = rows.where(F.col(_SERIES).isin(list(facts))).select(_SERIES, "idx", "ts", "value")
    smooth = _smoothed(kept, facts, period)
    apart = F.col("value") / F.col("trend") if ratio else F.col("value") - F.col("trend")
    phase = F.pmod(F.col("idx"), F.lit(period).cast("bigint"))
    phases = (smooth.where("trend is not null").groupBy(_SERIES, phase.alias("phase"))
              .agg(F.avg(apart).alias("raw")))
    # one row per series and phase: bounded by the schema and the period
    level = phases.groupBy(_SERIES).agg(F.avg("raw").alias("level"))
    centred = phases.join(F.broadcast(level), _SERIES).select(
        _SERIES, "phase", (F.col("raw") / F.col("level") if ratio else F.col("raw") - F.col("level")).alias("seasonal"))
    # series times period rows: broadcast while their number is small, beyond that left to the planner
    both = smooth.withColumn("phase", phase).join(
        F.broadcast(centred) if len(facts) * period <= _PHASES else centred, [_SERIES, "phase"])
    left = (F.col("value") / F.col("seasonal") / F.col("trend") if ratio
            else F.col("value") - F.col("seasonal") - F.col("trend"))
    return both.select(_SERIES, F.lit(model).alias("method"), "idx", "ts", "value", "trend", "seasonal",
                       left.alias("residual"))


def component_strengths(parts: DataFrame) -> DataFrame:
    """Variance share of trend, seasonal part and residual per series and method."""
    ratio = F.col("method") == "multiplicative"

    def measured(name: str) -> Column:
        return F.var_pop(F.when(ratio, F.ln(F.col(name) + 1e-8)).otherwise(F.col(name)))

    v = parts.groupBy(_SERIES, "method").agg(
        *[measured(c).alias(c) for c in ("trend", "seasonal", "residual")])
    total = F.col("trend") + F.col("seasonal") + F.col("residual")
    return v.select(_SERIES, "method", *[
        F.when(total > 0, F.col(c) / total).otherwise(0.0).alias(f"{c}_strength")
        for c in ("trend", "seasonal", "residual")])


Decomposer = Callable[[DataFrame, int], DataFrame]
# name: (decomposer, whether it takes series with positive values only)
_MODELS: dict[str, tuple[Decomposer, bool]] = {}


def register_model(name: str, fit: Decomposer, positive_only: bool = False) -> None:
    """Add a decomposition: (rows, period) to rows (series, method, idx, ts, value, trend, seasonal, residual)."""
    _MODELS[name] = (fit, positive_only)


register_model("additive", lambda rows, period: decompose(rows, period))
register_model("multiplicative", lambda rows, period: decompose(rows, period, "multiplicative"), positive_only=True)


def decompose_table(df: DataFrame, time_col: str, value_cols: Sequence[str] | None = None,
                    period: int = settings.SEASONAL_PERIOD, key_cols: Sequence[str] = (),
                    rows: DataFrame | None = None, models: Sequence[str] = ("additive", "multiplicative")) -> DataFrame:
    """Parts of every complete series by each model; some models take positive series only."""
    value_cols = _value_cols(df, time_col, value_cols)
    whole, positive = _whole_series(df, time_col, value_cols)
    rows = rows if rows is not None else series_rows(df, time_col, value_cols, key_cols)
    out = None
    for name in models:
        fit, positive_only = _MODELS[name]
        part = fit(rows.where(F.col(_SERIES).isin(positive if positive_only else whole)), period)
        out = part if out is None else out.unionByName(part)
    return out


def _every_series(section: DataFrame, value_cols: Sequence[str], size: str) -> DataFrame:
    """The section with a line for each value column; one without values has size 0 and insufficient data."""
    names = section.sparkSession.createDataFrame([(c,) for c in value_cols], f"{_SERIES} string")
    return (names.join(F.broadcast(section), _SERIES, "left")  # a section holds one line per value column
            .withColumn(size, F.coalesce(size, F.lit(0).cast("bigint")))
            .withColumn("status", F.coalesce("status", F.lit("insufficient_data"))).select(*section.columns))


def analyze(df: DataFrame, time_col: str, value_cols: Sequence[str] | None = None,
            period: int = settings.SEASONAL_PERIOD, key_cols: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every section for every value column; ordered rows, their steps, autocorrelations and components are built once.

    Sections of a line per series are staged too: the overview reads them again.
    """
    value_cols = _value_cols(df, time_col, value_cols)
    rows = series_rows(df, time_col, value_cols, key_cols)
    steps = stage_table(_steps(rows))
    acf = stage_table(partial_autocorrelation(autocorrelation(rows)))
    parts = stage_table(decompose_table(df, time_col, value_cols, period, key_cols, rows))
    return {
        "profile": profile(df, time_col, value_cols),
        "stationarity": stage_table(_every_series(stationarity(rows), value_cols, "n_total")),
        "autocorrelation": acf,
        "significant_acf": significant_lags(acf, "acf"),
        "significant_pacf": significant_lags(acf, "pacf"),
        "trend": stage_table(_every_series(trend(rows), value_cols, "n_obs")),
        "changepoints": stage_table(_every_series(changepoints(rows, steps=steps), value_cols, "n_obs")),
        "first_changepoints": first_changepoints(rows, steps=steps),
        "decomposition": parts,
        "strengths": component_strengths(parts),
    }


def overview(sections: dict[str, DataFrame]) -> DataFrame:
    """One line per series: trend direction, stationary or not, number of changepoints."""
    return (sections["trend"].select(_SERIES, "direction")
            .join(F.broadcast(sections["stationarity"].select(_SERIES, "is_stationary")), _SERIES)
            .join(F.broadcast(sections["changepoints"].select(_SERIES, "n_changepoints")), _SERIES)
            .select(_SERIES, F.coalesce("direction", F.lit("unknown")).alias("direction"),
                    F.coalesce("is_stationary", F.lit(False)).alias("is_stationary"),
                    F.coalesce("n_changepoints", F.lit(0).cast("bigint")).alias("n_changepoints")))


# ---- calendars --------------------------------------------------------------

def by_period(df: DataFrame, time_col: str, period: str, value_cols: Sequence[str] | None = None) -> DataFrame:
    """Count, sum, mean, min and max of each value column per calendar period (hour, day, month...)."""
    value_cols = _value_cols(df, time_col, value_cols)
    time = as_time(df, time_col)
    stamp = F.date_trunc(period, time)
    if not isinstance(df.schema[time_col].dataType, T.TimestampType):
        stamp = stamp.cast("timestamp_ntz")
    return nan_to_null(df).groupBy(stamp.alias("period")).agg(
        F.count("*").alias("n_rows"), *[
            f(ref(c).cast("double")).alias(f"{c}_{k}") for c in value_cols
            for k, f in (("sum", F.sum), ("mean", F.avg), ("min", F.min), ("max", F.max))])


def by_window(df: DataFrame, time_col: str, size: str, slide: str | None = None,
              value_cols: Sequence[str] | None = None) -> DataFrame:
    """Count and mean of each value column per tumbling or sliding time window."""
    value_cols = _value_cols(df, time_col, value_cols)
    frame = nan_to_null(df).withColumn("_ts", as_time(df, time_col))
    return frame.groupBy(F.window("_ts", size, slide)).agg(
        F.count("*").alias("n_rows"), *[F.avg(ref(c).cast("double")).alias(f"{c}_mean") for c in value_cols]).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_rows",
        *[f"{c}_mean" for c in value_cols])


# Calendar units that have one length, in seconds
_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def missing_periods(df: DataFrame, time_col: str, period: str) -> DataFrame:
    """Calendar periods between the first and the last observation that hold no row.

    The calendar is generated in parallel and anti-joined with the observed periods.
    """
    stamp = F.date_trunc(period, as_time(df, time_col)).cast("timestamp_ntz")
    seen = df.select(stamp.alias("period")).where("period is not null").distinct()
    ends = df.agg(F.min(stamp).alias("first"), F.max(stamp).alias("last")).first()
    start = F.lit(ends["first"]).cast("timestamp_ntz")
    if ends["first"] is None:
        return seen.limit(0)
    if period in _SECONDS:
        seconds = _SECONDS[period]
        n = int((ends["last"] - ends["first"]).total_seconds()) // seconds + 1
        at = start + F.make_dt_interval(secs=(F.col("id") * seconds).cast("decimal(18,6)"))
    elif period in _MONTHS:
        step = _MONTHS[period]
        months = (ends["last"].year - ends["first"].year) * 12 + ends["last"].month - ends["first"].month
        n, at = months // step + 1, start + F.make_ym_interval(months=(F.col("id") * step).cast("int"))
    else:
        raise ValueError(f"unknown period {period!r}")
    calendar = df.sparkSession.range(n).select(at.alias("period"))
    return calendar.join(seen, "period", "left_anti")


def _seconds(interval: Column) -> Column:
    """Length of a day-time interval, independent of the session's time zone."""
    units = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    return sum((F.extract(F.lit(u), interval).cast("double") * s for u, s in units.items()), F.lit(0.0))


def interval_stats(df: DataFrame, time_col: str) -> DataFrame:
    """Spacing of the observations in seconds: extremes, mean, std and repeated stamps."""
    stamps = df.select(F.lit("time").alias(_SERIES), as_time(df, time_col).alias("ts")).where("ts is not null")
    rows = ordered_index(stamps, _SERIES, ["ts"]).select(
        _SERIES, "idx", "ts")
    gap = _seconds(F.col("ts") - F.lag("ts").over(block_window(_SERIES)))
    gaps = neighbour_blocks(rows, back=1).withColumn("gap", gap).where("home and gap is not null")
    return gaps.agg(
        F.count("*").alias("n_intervals"), F.min("gap").alias("min_seconds"), F.avg("gap").alias("mean_seconds"),
        F.max("gap").alias("max_seconds"), F.stddev_pop("gap").alias("std_seconds"),
        F.count_if(F.col("gap") == 0).alias("repeated_stamps"))
