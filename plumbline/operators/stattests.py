"""Hypothesis tests between groups and between categories.

All numeric x categorical pairs share one scan: rows are expanded over the
category columns and reduced map-side to (category, level) moments.  Rank tests
work on distinct values with counts, so a hot value is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import settings
from plumbline.functions.columns import categorical_columns, nan_to_null, numeric_columns, ref, value_key
from plumbline.functions.joins import spread_join
from plumbline.functions.ordering import running_totals, stage_table
from plumbline.functions.tails import add_p_value, rank_sum_p, with_verdict


def _level(name: str) -> Column:
    return ref(name).cast("string")


def group_moments(df: DataFrame, cats: Sequence[str], nums: Sequence[str],
                  group_values: Sequence[str] | None = None) -> DataFrame:
    """Rows (cat, level, num, n, mean, var) of every category level and numeric column.

    Missing levels and missing numbers are left out; ``var`` is the sample variance.
    """
    clean = nan_to_null(df.select(*[ref(c) for c in dict.fromkeys([*cats, *nums])]))
    rows = clean.select(
        *[ref(c).cast("double").alias(f"x{i}") for i, c in enumerate(nums)],
        F.inline(F.array(*[F.struct(F.lit(c).alias("cat"), _level(c).alias("level")) for c in cats]))
    ).where("level is not null")
    if group_values is not None:
        rows = rows.where(F.col("level").isin([str(g) for g in group_values]))
    wide = rows.groupBy("cat", "level").agg(*[e for i in range(len(nums)) for e in (
        F.count(f"x{i}").alias(f"n{i}"), F.avg(f"x{i}").alias(f"m{i}"), F.var_samp(f"x{i}").alias(f"v{i}"))])
    return wide.select("cat", "level", F.inline(F.array(*[
        F.struct(F.lit(c).alias("num"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                 F.col(f"v{i}").alias("var")) for i, c in enumerate(nums)]))).where("n > 0")


def _welch(moments: DataFrame, min_rows: int) -> DataFrame:
    group = F.struct("level", "n", "mean", "var")
    two = (moments.groupBy("cat", "num")
           .agg(F.count("*").alias("k"), F.min(group).alias("a"), F.max(group).alias("b"))
           .where((F.col("k") == 2) & (F.col("a.n") >= min_rows) & (F.col("b.n") >= min_rows)))
    va, vb = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    free = F.try_divide((va + vb) * (va + vb),
                        va * va / (F.col("a.n") - 1) + vb * vb / (F.col("b.n") - 1))
    return two.select(
        "cat", "num", F.col("a.level").alias("group1"), F.col("b.level").alias("group2"),
        F.col("a.n").alias("n_g1"), F.col("b.n").alias("n_g2"),
        F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(va + vb)).alias("statistic"), free.alias("df"))


def _ordered_pair(table: DataFrame, group_values: Sequence[str] | None) -> DataFrame:
    """Turn the result round when the caller named the groups in the other order."""
    if group_values is None or str(group_values[0]) <= str(group_values[1]):
        return table
    return table.select(
        "cat", "num", F.col("group2").alias("group1"), F.col("group1").alias("group2"),
        F.col("n_g2").alias("n_g1"), F.col("n_g1").alias("n_g2"), (-F.col("statistic")).alias("statistic"), "df")


def t_tests(df: DataFrame, cats: Sequence[str] | None = None, nums: Sequence[str] | None = None,
            group_values: Sequence[str] | None = None, alpha: float = settings.ALPHA,
            min_rows: int = settings.MIN_GROUP_ROWS, with_p: bool = True) -> DataFrame:
    """Welch's t between the two levels of each category (or the two named levels)."""
    cats, nums = _pick(df, cats, nums)
    table = _ordered_pair(_welch(group_moments(df, cats, nums, group_values), min_rows), group_values)
    return add_p_value(table, "t", alpha, "df") if with_p else table


def _anova(moments: DataFrame, min_rows: int) -> DataFrame:
    # the grand mean first: a difference of two large sums would lose digits
    overall = moments.groupBy("cat", "num").agg(
        F.count("*").alias("k"), F.min("n").alias("least"), F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")).where(
        (F.col("k") >= 2) & (F.col("least") >= min_rows))
    # one row per tested pair of columns: bounded by the schema
    gap = F.col("mean") - F.col("grand")
    parts = (moments.join(F.broadcast(overall), ["cat", "num"]).groupBy("cat", "num", "k", "total")
             .agg(F.sum(F.col("n") * gap * gap).alias("between"),
                  F.sum((F.col("n") - 1) * F.col("var")).alias("within")))
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    return parts.select(
        "cat", "num", F.col("k").alias("n_groups"), F.col("total").alias("n_total"),
        F.try_divide(F.col("between") / df1, F.try_divide(F.col("within"), df2)).alias("statistic"),
        df1.alias("df1"), df2.alias("df2"))


def anova(df: DataFrame, cats: Sequence[str] | None = None, nums: Sequence[str] | None = None,
          alpha: float = settings.ALPHA, min_rows: int = settings.MIN_GROUP_ROWS, with_p: bool = True) -> DataFrame:
    """One-way F over all levels of each category; every level needs ``min_rows`` rows."""
    cats, nums = _pick(df, cats, nums)
    table = _anova(group_moments(df, cats, nums), min_rows)
    return add_p_value(table, "f", alpha, "df1", "df2") if with_p else table


def group_sizes(df: DataFrame, cats: Sequence[str] | None = None, nums: Sequence[str] | None = None) -> DataFrame:
    """Levels of each category with the rows that enter a test, sorted by level within a pair."""
    cats, nums = _pick(df, cats, nums)
    return group_moments(df, cats, nums).select("cat", "num", "level", "n")


def _two_levels(df: DataFrame, cats: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Categories with exactly two levels, found by two scans that shuffle nothing.

    The extremes first, then a count of anything between them.
    """
    ends = df.agg(*[e for i, c in enumerate(cats) for e in (
        F.min(_level(c)).alias(f"a{i}"), F.max(_level(c)).alias(f"b{i}"))]).first()
    found = {c: (ends[f"a{i}"], ends[f"b{i}"]) for i, c in enumerate(cats)
             if ends[f"a{i}"] is not None and ends[f"a{i}"] != ends[f"b{i}"]}
    if not found:
        return {}
    other = df.agg(*[F.count_if(_level(c).isNotNull() & ~_level(c).isin(list(pair))).alias(f"o{i}")
                     for i, (c, pair) in enumerate(found.items())]).first()
    return {c: pair for i, (c, pair) in enumerate(found.items()) if other[f"o{i}"] == 0}


_MW_SCHEMA = ("cat string, num string, group1 string, group2 string, n_g1 bigint, n_g2 bigint, "
              "statistic double, tie_term double, z double")


def mann_whitney(df: DataFrame, cats: Sequence[str] | None = None, nums: Sequence[str] | None = None,
                 group_values: Sequence[str] | None = None, alpha: float = settings.ALPHA,
                 min_rows: int = settings.MIN_GROUP_ROWS, with_p: bool = True) -> DataFrame:
    """Mann-Whitney U of the first level of each two-level category.

    Rows become one line per number and distinct value with two counters for every
    category; one range sort and running totals of the second groups' counters give
    every U without ranking rows in one place.
    """
    cats, nums = _pick(df, cats, nums)
    clean = nan_to_null(df.select(*[ref(c) for c in dict.fromkeys([*cats, *nums])]))
    if group_values is not None:
        pairs = {c: (str(group_values[0]), str(group_values[1])) for c in cats}
    else:
        pairs = _two_levels(clean, cats)
    empty = df.sparkSession.createDataFrame([], _MW_SCHEMA)
    if not pairs or not nums:
        return _rank_verdict(empty, alpha) if with_p else empty
    # a row per number, not per test: every category has its two counters in it
    sides = [F.when(_level(c) == first, 1).when(_level(c) == second, 2) for c, (first, second) in pairs.items()]
    cells = F.array(*[F.struct(F.lit(x).alias("num"), (ref(x).cast("double") + 0.0).alias("v")) for x in nums])
    held = clean.select(*[s.alias(f"s{i}") for i, s in enumerate(sides)], F.inline(cells)).where("v is not null").where(
        F.coalesce(*[F.col(f"s{i}") for i in range(len(sides))]).isNotNull())
    counts = held.groupBy("num", "v").agg(*[F.count_if(F.col(f"s{i}") == side).alias(f"c{side}_{i}") for i in range(len(sides)) for side in (1, 2)])
    below = running_totals(counts, "num", ["v"], [f"c2_{i}" for i in range(len(sides))])
    sums = []
    for i in range(len(sides)):
        c1, c2 = F.col(f"c1_{i}"), F.col(f"c2_{i}")
        t = (c1 + c2).cast("double")
        sums += [F.sum(c1).alias(f"n1_{i}"), F.sum(c2).alias(f"n2_{i}"), F.sum(c1 * (F.col(f"before_c2_{i}") + c2 / 2.0)).alias(f"u_{i}"),
                 F.sum(t * t * t - t).alias(f"tie_{i}")]
    u = below.groupBy("num").agg(*sums).select("num", F.inline(F.array(*[F.struct(
        F.lit(c).alias("cat"), F.lit(first).alias("group1"), F.lit(second).alias("group2"), F.col(f"n1_{i}").alias("n_g1"),
        F.col(f"n2_{i}").alias("n_g2"), F.col(f"u_{i}").alias("statistic"), F.col(f"tie_{i}").alias("tie_term"))
        for i, (c, (first, second)) in enumerate(pairs.items())]))).where((F.col("n_g1") >= min_rows) & (F.col("n_g2") >= min_rows))
    n1, n2 = F.col("n_g1").cast("double"), F.col("n_g2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    larger = F.greatest(F.col("statistic"), n1 * n2 - F.col("statistic"))
    out = u.select("cat", "num", "group1", "group2", "n_g1", "n_g2", "statistic", "tie_term",
                   F.try_divide(larger - n1 * n2 / 2.0 - 0.5, spread).alias("z"))
    return _rank_verdict(out, alpha) if with_p else out


def _rank_verdict(table: DataFrame, alpha: float) -> DataFrame:
    return with_verdict(table.withColumn("p_value", rank_sum_p(
        F.col("statistic"), F.col("z"), F.col("n_g1"), F.col("n_g2"), F.col("tie_term"))), alpha)


def _cells(df: DataFrame, cats: Sequence[str], level: Callable[[str], Column]) -> DataFrame:
    pairs = list(combinations(cats, 2))
    cells = F.array(*[F.struct(F.lit(a).alias("cat1"), F.lit(b).alias("cat2"), level(a).alias("level1"),
                               level(b).alias("level2")) for a, b in pairs])
    return (nan_to_null(df.select(*[ref(c) for c in cats])).select(F.inline(cells))
            .where("level1 is not null and level2 is not null")
            .groupBy("cat1", "cat2", "level1", "level2").agg(F.count("*").alias("n")))


def contingency(df: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Observed cells (cat1, cat2, level1, level2, n) of every pair of the given categories."""
    return _cells(df, cats, _level)


def chi_square(df: DataFrame, cats: Sequence[str] | None = None, alpha: float = settings.ALPHA,
               with_p: bool = True) -> DataFrame:
    """Chi-square independence test of every pair of categories; a 2 x 2 table gets Yates' correction.

    Cells stay in long form.  Cells without rows are never made: their share is
    what the expected counts of the present cells leave of the total.
    """
    cats = list(cats) if cats is not None else categorical_columns(df)
    schema = "cat1 string, cat2 string, n_rows bigint, n_cols bigint, n_total bigint, statistic double, df bigint"
    if len(cats) < 2:
        empty = df.sparkSession.createDataFrame([], schema)
        return add_p_value(empty, "chi2", alpha, "df") if with_p else empty
    # long texts travel as digests; the source is read once, all that follows works on the staged cells
    cells = stage_table(_cells(df, cats, lambda c: value_key(df, c)).select(
        "cat1", "cat2", F.struct("cat1", "cat2", "level1").alias("k1"), F.struct("cat1", "cat2", "level2").alias("k2"), "n"))
    pair = ["cat1", "cat2"]
    rows = cells.groupBy(*pair, "k1").agg(F.sum("n").alias("r"), F.count("*").alias("held"))
    cols = cells.groupBy(*pair, "k2").agg(F.sum("n").alias("c"), F.count("*").alias("held"))
    # one row per tested pair of columns: bounded by the schema
    size = (rows.groupBy(*pair).agg(F.count("*").alias("n_rows"), F.sum("r").alias("n_total"),
                                    F.sum(F.lit(1.0) / F.col("r")).alias("inv_r"))
            .join(cols.groupBy(*pair).agg(F.count("*").alias("n_cols"), F.sum(F.lit(1.0) / F.col("c")).alias("inv_c")),
                  pair).where("n_rows >= 2 and n_cols >= 2"))
    # a level in many cells meets its margin by broadcast, the others by shuffle
    total = cells.count()
    full = spread_join(cells, rows.select("k1", "r", "held"), "k1", "held", total)
    full = spread_join(full, cols.select("k2", "c", "held"), "k2", "held", total).join(F.broadcast(size), pair)
    expected = F.col("r").cast("double") * F.col("c") / F.col("n_total")
    gap = F.col("n") - expected
    sums = full.groupBy(*pair, "n_rows", "n_cols", "n_total", "inv_r", "inv_c").agg(
        F.sum(gap * gap / expected).alias("seen"), F.sum(expected).alias("expected_seen"),
        F.max(F.abs(gap)).alias("gap"))
    plain = F.col("seen") + (F.col("n_total") - F.col("expected_seen"))
    # in a 2 x 2 table all four cells differ from their expectation by the same amount
    less = F.col("gap") - F.least(F.col("gap"), F.lit(0.5))
    yates = less * less * F.col("n_total") * F.col("inv_r") * F.col("inv_c")
    out = sums.select(*pair, "n_rows", "n_cols", "n_total",
                      F.when((F.col("n_rows") == 2) & (F.col("n_cols") == 2), yates).otherwise(plain).alias("statistic"),
                      ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).alias("df"))
    return add_p_value(out, "chi2", alpha, "df") if with_p else out


def _pick(df: DataFrame, cats: Sequence[str] | None, nums: Sequence[str] | None) -> tuple[list[str], list[str]]:
    return (list(cats) if cats is not None else categorical_columns(df),
            list(nums) if nums is not None else numeric_columns(df))


def run_all(df: DataFrame, cats: Sequence[str] | None = None, nums: Sequence[str] | None = None,
            alpha: float = settings.ALPHA, min_rows: int = settings.MIN_GROUP_ROWS) -> dict[str, DataFrame]:
    """Every applicable test: t and rank-sum for two-level categories, ANOVA, chi-square."""
    cats, nums = _pick(df, cats, nums)
    moments = stage_table(group_moments(df, cats, nums))  # one row per group and number, shared by two tests
    return {
        "ttest": add_p_value(_welch(moments, min_rows), "t", alpha, "df"),
        "mannwhitney": mann_whitney(df, cats, nums, alpha=alpha, min_rows=min_rows),
        "anova": add_p_value(_anova(moments, min_rows), "f", alpha, "df1", "df2"),
        "chi2": chi_square(df, cats, alpha),
    }


def results_table(results: dict[str, DataFrame]) -> DataFrame:
    """One line per test: (test, var1, var2, statistic, p_value, significant)."""
    out = None
    for name, table in results.items():
        a, b = ("cat1", "cat2") if name == "chi2" else ("cat", "num")
        part = table.select(F.lit(name).alias("test"), F.col(a).alias("var1"), F.col(b).alias("var2"),
                            "statistic", "p_value", "significant")
        out = part if out is None else out.unionByName(part)
    return out


def significance_counts(results: dict[str, DataFrame]) -> DataFrame:
    """Significant results per kind of test, of how many."""
    return results_table(results).groupBy("test").agg(
        F.count_if("significant").alias("n_significant"), F.count("*").alias("n_tests"))
