import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import nan_to_null
from plumbline.functions.quantiles import exact_quantiles
from plumbline.operators import distributions, outliers

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def heavy(spark, parts=4):
    """A third of the rows share one value; the rest spans 600 orders of magnitude."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(1000, 7.25), 10.0 ** rng.uniform(-300, 300, 500), -(10.0 ** rng.uniform(-300, 300, 500)),
                        rng.integers(-50, 50, 900).astype(float), 1e9 + rng.uniform(0, 1, 100)])
    rng.shuffle(x)
    return x, spark.createDataFrame([(float(v),) for v in x], "x double").repartition(parts)


@pytest.mark.parametrize("gather", [1, 50, 10**6])
def test_quantiles_match_numpy(spark, gather):
    x, df = heavy(spark)
    got = exact_quantiles(df, ["x"], PROBS, gather_rows=gather)["x"]
    assert got.count == len(x) and (got.low, got.high) == (x.min(), x.max())
    assert [got.at[p] for p in PROBS] == [float(v) for v in np.quantile(x, PROBS)]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_quantiles_do_not_depend_on_partitions(spark, parts):
    x, df = heavy(spark, parts)
    assert exact_quantiles(df, ["x"], [0.3], gather_rows=20)["x"].at[0.3] == float(np.quantile(x, 0.3))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5])
    assert got["a"].count == 0 and got["b"].get(0.5) is None


def test_numeric_summary_and_modes(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, "b"), (4.0, None)], "x double, s string")
    r = distributions.numeric_summary(df).first()
    assert (r["count"], r["min"], r.p50, r["max"], r.missing, r.missing_percent) == (3, 1.0, 2.0, 4.0, 1, 25.0)
    m = distributions.modes(df).first()
    assert (m.top, m.top_count, m.missing) == (None, 2, 2)
    empty = distributions.modes(df.where("x > 9")).first()
    assert (empty.top, empty.top_count, empty.missing_percent) == (None, 0, 0.0)


def test_histogram_matches_numpy(spark):
    x = np.random.default_rng(5).normal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    counts, edges = np.histogram(x, bins="auto")
    got = {r.bin: r for r in distributions.histogram(df).collect()}
    assert {b: r["count"] for b, r in got.items()} == {i: c for i, c in enumerate(counts) if c}
    assert all(math.isclose(r.lo, edges[b], abs_tol=1e-12) for b, r in got.items())
    constant = distributions.histogram(spark.createDataFrame([(3,), (3,)], "x long")).first()
    assert (constant.lo, constant.hi, constant["count"]) == (2.5, 3.5, 2)


def test_density_close_to_exact_curve(spark):
    x = np.random.default_rng(6).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    h = x.std(ddof=1) * len(x) ** -0.2
    for r in distributions.density(df).collect():
        exact = np.exp(-0.5 * ((r.x - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
        assert math.isclose(r.density, exact, rel_tol=1e-4)


@pytest.fixture(scope="module")
def demo(spark):
    cols = {"transaction_amount": [100, 150, 120, 5000, 110, 125, 130, 999, 115, 105],
            "account_age_days": [30, 45, 60, 75, 90, 180, 365, 500, 50, 100],
            "login_attempts": [1, 2, 1, 50, 1, 2, 3, 1, 2, 1]}
    rows = [(i, i + 1, *v) for i, v in enumerate(zip(*cols.values()))]
    return spark.createDataFrame(rows, "row long, user_id long, " + ", ".join(f"{c} long" for c in cols))


COLS = ["user_id", "transaction_amount", "account_age_days", "login_attempts"]


def test_outlier_demo(demo):
    got = {(r["column"], r.method): r for r in outliers.detect(demo, COLS).collect()}
    iqr = got["transaction_amount", "iqr"]
    assert (iqr.q1, iqr.q3, iqr.lower, iqr.upper, iqr.outlier_count) == (111.25, 145.0, 60.625, 195.625, 2)
    assert got["account_age_days", "mad"].median == 82.5 and got["account_age_days", "mad"].mad == 35.0
    assert sum(got[c, "zscore"].outlier_count for c in COLS) == 0
    agreed = sorted((r["column"], r["row"]) for r in outliers.consensus(demo, ["row"], COLS).collect())
    assert agreed == [("account_age_days", 6), ("account_age_days", 7), ("login_attempts", 3),
                      ("transaction_amount", 3), ("transaction_amount", 7)]
    s = outliers.summary(demo, COLS).first()
    assert (s.iqr_outliers, s.zscore_outliers, s.mad_outliers, s.consensus_columns) == (5, 0, 5, 3)


def test_outlier_edges(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0), (None, 5.0)], "none double, same double")
    got = {(r["column"], r.method): r for r in outliers.detect(df).collect()}
    assert got["none", "iqr"].lower is None and got["none", "iqr"].outlier_count == 0
    assert got["same", "zscore"].note.startswith("No variance") and got["same", "mad"].note.startswith("No deviation")
    assert outliers.flagged_rows(df, []).count() == 0


def test_own_rule(demo):
    outliers.register_rule("huge", lambda: lambda s, x: x > F.lit(900.0))
    got = outliers.detect(demo, ["transaction_amount"], ["huge", "unknown"]).collect()
    assert [(r.method, r.outlier_count) for r in got] == [("huge", 2)]


def test_normality_p_is_even_under_normality(spark):
    """60 columns of normal values with estimated parameters: half the p-values are below one half, few below a twentieth."""
    data = np.random.default_rng(12).normal(5, 3, (400, 60))
    names = [f"c{i}" for i in range(60)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in data], ", ".join(f"{c} double" for c in names))
    p = np.array([r.p_value for r in distributions.normality_ks(df).collect()])
    assert len(p) == 60 and 0.3 < (p < 0.5).mean() < 0.7 and (p < 0.05).mean() < 0.15 and p.min() < 0.2


def test_normality_distance_equals_a_scan(spark):
    rng = np.random.default_rng(13)
    table = {"even": rng.random(300), "ties": rng.integers(0, 4, 300).astype(float), "flat": np.full(300, 2.0)}
    rows = [tuple(float(v[i]) for v in table.values()) + (None if i % 2 else float("nan") if i % 4 else 1.0 * i, float("inf") if i == 0 else float(i * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "even double, ties double, flat double, gaps double, wild double").repartition(5)
    got = {r["column"]: r for r in distributions.normality_ks(df).collect()}
    assert set(got) == {"even", "ties", "gaps", "wild"}
    for name, x in (("even", table["even"]), ("ties", table["ties"]), ("wild", np.array([i * i for i in range(1, 300)], float))):
        x = np.sort(x)
        share = np.array([0.5 * math.erfc(-(v - x.mean()) / x.std(ddof=1) / math.sqrt(2)) for v in x])
        n = len(x)
        gap = max(max(np.searchsorted(x, v, "right") / n - s, s - np.searchsorted(x, v, "left") / n) for v, s in zip(x, share))
        assert got[name].n == n and math.isclose(got[name].statistic, gap, abs_tol=1e-12) and got[name].p_value < 0.05
    assert distributions.normality_ks(df.limit(0)).count() == 0


def test_moments_come_with_the_quartile_search(spark):
    """Mean and deviation merged over bins equal the plain aggregates, also of constant, single, missing and infinite values."""
    rng = np.random.default_rng(8)
    rows = [(float(x), 0.1, None, 3.0 if i == 7 else None, math.inf if i == 3 else float(i), float("nan") if i % 3 else float(-x * 1e6))
            for i, x in enumerate(rng.lognormal(0, 3, 500) - 1)]
    df = spark.createDataFrame(rows, "wide double, same double, gone double, one double, far double, holes double")
    got = exact_quantiles(df, df.columns, [0.5], moments=True)
    clean = nan_to_null(df)
    for c in df.columns:
        n, mean, std = clean.agg(F.count(c), F.avg(c), F.stddev_samp(c)).first()
        assert (got[c].count, got[c].rows) == (n, 500)
        for ours, plain in ((got[c].mean, mean), (got[c].std, std)):
            assert ours == plain if plain is None else ours == pytest.approx(plain, rel=1e-12, abs=1e-12, nan_ok=True)
    assert got["same"].std == 0.0
    empty = exact_quantiles(df.limit(0), ["wide"], [0.5], moments=True)["wide"]
    assert (empty.count, empty.rows, empty.mean, empty.std) == (0, 0, None, None)
