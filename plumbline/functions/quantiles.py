"""Exact quantiles of many columns with bounded memory per task.

The built-in ``percentile`` keeps every distinct value of a column in one
aggregation buffer.  Here a histogram is refined instead: each pass counts rows
per bin (map-side combined, a bounded number of bins whatever the row count),
keeps only the bins that hold a wanted rank and splits those further.  Once a
bin holds few enough rows its values are ranked.  A value shared by a third of
all rows is one bin with ``lo == hi`` and costs nothing.

The bins of the first pass can carry means and squared deviations as well; merged
over a column they give its mean and deviation without a scan of their own.

The passes return a handful of scalars per column.  Callers put them into later
plans as literals, so filters on them reach the Parquet scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import nan_to_null, ref

# bins per unit of ln|x| in the first pass (relative bin width about 0.8 %)
_LOG_BINS = 128
# larger than any |ln x| of a double, so bins of positive values stay positive
_LOG_SHIFT = 800 * _LOG_BINS
# equal-width bins per refined bracket
_SPLIT = 16384
# a bracket with at most this many rows is ranked value by value
GATHER_ROWS = 200_000


@dataclass
class ColumnQuantiles:
    """Order statistics of one column; ``at[p]`` is interpolated linearly.

    ``rows`` counts missing values too; mean and (sample) std are there if moments were asked for.
    """

    count: int = 0
    rows: int = 0
    mean: float | None = None
    std: float | None = None
    low: float | None = None
    high: float | None = None
    at: dict[float, float] = field(default_factory=dict)

    def get(self, p: float) -> float | None:
        return self.at.get(p)


@dataclass
class _Bracket:
    column: int
    lo: float
    hi: float
    below: int
    rows: int

    def holds(self, rank: int) -> bool:
        return self.below <= rank < self.below + self.rows


def _between(a: float, b: float, t: float) -> float:
    """Linear interpolation, exact at both ends and for equal ends."""
    if a == b:
        return a
    return b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t


def _log_bin(v: Column) -> Column:
    size = F.floor(F.least(F.ln(F.abs(v)), F.lit(1000.0)) * _LOG_BINS) + F.lit(_LOG_SHIFT)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def _values(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    ids = [str(i) for i in range(len(exprs))]
    wide = df.select(*[e.cast("double").alias(i) for i, e in zip(ids, exprs.values())])
    return nan_to_null(wide).unpivot([], ids, "c", "v")


def _first_pass(df: DataFrame, exprs: dict[str, Column], probs: list[float], moments: bool) -> list:
    """Bins that hold a wanted rank, with totals of their column; a column without values has its one bin of missing values."""
    inner = [F.avg("v").alias("mean"), F.var_pop("v").alias("spread")] if moments else []
    bins = (_values(df, exprs).groupBy("c", _log_bin(F.col("v")).alias("bin"))
            .agg(F.count("v").alias("n"), F.count("*").alias("all"), F.min("v").alias("lo"), F.max("v").alias("hi"), *inner))
    per_column = Window.partitionBy("c")
    ordered = per_column.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.select(
        "*", (F.sum("n").over(ordered) - F.col("n")).alias("below"),
        F.sum("n").over(per_column).alias("total"), F.sum("all").over(per_column).alias("rows"),
        F.min("lo").over(per_column).alias("low"), F.max("hi").over(per_column).alias("high"))
    if moments:
        centre = ranked.withColumn("centre", F.try_divide(F.sum(F.col("n") * F.col("mean")).over(per_column), F.col("total")))
        apart = F.col("spread") + (F.col("mean") - F.col("centre")) ** 2
        ranked = centre.withColumn("squares", F.sum(F.col("n") * apart).over(per_column))
    wanted = F.col("total") == 0
    for p in probs:
        spot = (F.col("total") - 1) * F.lit(float(p))
        for rank in (F.floor(spot), F.ceil(spot)):
            wanted = wanted | ((rank >= F.col("below")) & (rank < F.col("below") + F.col("n")))
    return ranked.where(wanted).collect()  # at most 2 rows per (column, probability)


def _inside(brackets: list[_Bracket], columns: list[Column], df: DataFrame) -> DataFrame:
    """Rows (bracket id, value) of the given brackets; the ranges reach the scan as filters."""
    any_range = None
    cells = []
    for b_id, b in enumerate(brackets):
        x = columns[b.column]
        hit = x.between(F.lit(b.lo), F.lit(b.hi))
        any_range = hit if any_range is None else any_range | hit
        cells.append(F.struct(F.lit(b_id).alias("b"), F.when(hit, x.cast("double")).alias("v")))
    return df.where(any_range).select(F.inline(F.array(*cells))).where("v is not null")


def _split(df: DataFrame, columns: list[Column], brackets: list[_Bracket],
           ranks: dict[int, set[int]]) -> list[_Bracket]:
    """Split each bracket into equal-width bins and keep those holding a wanted rank."""
    rows = _inside(brackets, columns, df)
    lo = F.element_at(F.array(*[F.lit(b.lo) for b in brackets]), F.col("b") + 1)
    hi = F.element_at(F.array(*[F.lit(b.hi) for b in brackets]), F.col("b") + 1)
    bins = (rows.groupBy("b", F.floor((F.col("v") - lo) / (hi - lo) * _SPLIT).alias("bin"))
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    ordered = Window.partitionBy("b").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bins.withColumn("below", F.sum("n").over(ordered) - F.col("n"))
    wanted = F.lit(False)
    for b_id, b in enumerate(brackets):
        for r in sorted(ranks[b.column]):
            if b.holds(r):
                inner = F.lit(r - b.below)
                wanted = wanted | ((F.col("b") == b_id) & (inner >= F.col("below"))
                                   & (inner < F.col("below") + F.col("n")))
    return [_Bracket(brackets[r.b].column, r.lo, r.hi, brackets[r.b].below + r.below, r.n)
            for r in placed.where(wanted).collect()]


def _gather(df: DataFrame, columns: list[Column], brackets: list[_Bracket],
            ranks: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """Rank the few values of each small bracket."""
    counts = _inside(brackets, columns, df).groupBy("b", "v").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("below", F.sum("n").over(ordered) - F.col("n"))
    wanted = F.lit(False)
    asked = []
    for b_id, b in enumerate(brackets):
        for r in sorted(ranks[b.column]):
            if b.holds(r):
                asked.append((b_id, r))
                inner = F.lit(r - b.below)
                wanted = wanted | ((F.col("b") == b_id) & (inner >= F.col("below"))
                                   & (inner < F.col("below") + F.col("n")))
    found = placed.where(wanted).collect()
    out = {}
    for b_id, r in asked:
        b = brackets[b_id]
        for row in found:
            if row.b == b_id and row.below <= r - b.below < row.below + row.n:
                out[(b.column, r)] = row.v
    return out


def _mean_and_std(row) -> tuple[float, float | None]:
    if row.low == row.high:  # without the rounding of a merged mean
        return row.low, None if row.total < 2 else 0.0 if math.isfinite(row.low) else math.nan
    return row.centre, math.sqrt(row.squares / (row.total - 1))


def exact_quantiles(df: DataFrame, exprs: dict[str, Column] | list[str], probs: list[float],
                    gather_rows: int = GATHER_ROWS, moments: bool = False) -> dict[str, ColumnQuantiles]:
    """Exact linear-interpolation quantiles of numeric columns or expressions, with ``moments`` also mean and deviation.

    Two scans for most tables; one more for each further factor of about
    ten thousand in rows per bin.  Nulls and NaN are left out.
    """
    if not isinstance(exprs, dict):
        exprs = {c: ref(c) for c in exprs}
    result = {name: ColumnQuantiles() for name in exprs}
    if not exprs:
        return result
    names, columns = list(exprs), list(exprs.values())
    todo: list[_Bracket] = []
    ranks: dict[int, set[int]] = {}
    known: dict[tuple[int, int], float] = {}
    for row in _first_pass(df, exprs, probs, moments):
        c = int(row.c)
        found = result[names[c]]
        found.count, found.rows, found.low, found.high = row.total, row.rows, row.low, row.high
        if not row.total:
            continue
        if moments:
            found.mean, found.std = _mean_and_std(row)
        todo.append(_Bracket(c, row.lo, row.hi, row.below, row.n))
        if c not in ranks:
            spots = [(row.total - 1) * p for p in probs]
            ranks[c] = {math.floor(s) for s in spots} | {math.ceil(s) for s in spots}
    small: list[_Bracket] = []
    while todo:
        wide = []
        for b in todo:
            if b.lo == b.hi:
                known.update({(b.column, r): b.lo for r in ranks[b.column] if b.holds(r)})
            else:
                (small if b.rows <= gather_rows else wide).append(b)
        todo = _split(df, columns, wide, ranks) if wide else []
    if small:
        known.update(_gather(df, columns, small, ranks))
    for i, name in enumerate(names):
        n = result[name].count
        for p in probs if n else ():
            spot = (n - 1) * p
            lower = math.floor(spot)
            result[name].at[p] = _between(known[(i, lower)], known[(i, math.ceil(spot))], spot - lower)
    return result
