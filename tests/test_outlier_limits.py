"""Infinite values and series of different length."""

import math

import numpy as np

from plumbline.operators import distributions, outliers, temporal


def test_infinite_values_flag_nothing(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (3.0,)], "v double")
    got = {r.method: r.outlier_count for r in outliers.detect(df).collect()}
    assert got["zscore"] == 0
    bars = distributions.histogram(df).collect()
    assert sum(r["count"] for r in bars) == 3 and all(math.isfinite(r.hi) for r in bars)


def test_density_of_heavy_tails(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=5000), [400.0, -400.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    h = x.std(ddof=1) * len(x) ** -0.2
    for r in distributions.density(df).collect():
        want = np.exp(-0.5 * ((r.x - x) / h) ** 2).sum() / (len(x) * h * math.sqrt(2 * math.pi))
        assert abs(r.density - want) <= 1e-6 * max(want, 1e-3)


def test_kpss_lags_are_each_series_own(spark):
    rng = np.random.default_rng(1)
    rows = [(f"2024-01-01 00:00:00.{i:03d}", float(rng.normal()), float(rng.normal()) if i % 4 == 0 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "t string, a double, b double")
    both = {r.series: (r.n_lags, r.statistic) for r in temporal.kpss(temporal.series_rows(df, "t")).collect()}
    alone = temporal.kpss(temporal.series_rows(df, "t", ["b"])).first()
    assert both["b"][0] == alone.n_lags == 16 and both["a"][0] == 22
    assert abs(both["b"][1] - alone.statistic) < 1e-9
