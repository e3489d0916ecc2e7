import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ordering, tails
from plumbline.operators import temporal

START = datetime.datetime(2024, 1, 1)


def table(spark, parts=4, shuffle=True, **series):
    n = len(next(iter(series.values())))
    order = np.random.default_rng(0).permutation(n) if shuffle else range(n)
    rows = [(START + datetime.timedelta(hours=int(i)), *[None if s[i] is None else float(s[i]) for s in series.values()])
            for i in order]
    return spark.createDataFrame(rows, "ts timestamp_ntz, " + ", ".join(f"{c} double" for c in series)).repartition(parts)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordering.neighbour_blocks, "__defaults__", (0, 64))


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(2)
    return np.cumsum(rng.normal(size=500)) + 10 * np.sin(np.arange(500) / 12 * 2 * np.pi) + 200


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_index_and_running_totals(spark, walk, parts):
    y = list(walk)
    z = [None if i % 7 == 0 else v for i, v in enumerate(walk)]
    rows = temporal.series_rows(table(spark, parts, a=y, b=z), "ts")
    got = {(r.series, r.idx): r.value for r in rows.collect()}
    assert [got["a", i] for i in range(500)] == y
    assert [got["b", i] for i in range(428)] == [v for v in z if v is not None]
    sums = ordering.running_totals(rows, "series", ["idx"], ["value"]).where("series = 'b'").orderBy("idx").collect()
    before = np.concatenate([[0], np.cumsum([v for v in z if v is not None])[:-1]])
    assert np.allclose([r.before_value for r in sums], before)


def test_equal_times_and_text_times(spark):
    df = spark.createDataFrame([("2024-01-02", 2, 5.0), ("2024-01-01", 9, 7.0), ("2024-01-02", 1, 6.0)],
                               "t string, k long, v double")
    rows = temporal.series_rows(df, "t", ["v"], ["k"]).orderBy("idx").collect()
    assert [r.value for r in rows] == [7.0, 6.0, 5.0]
    with pytest.raises(Exception):
        temporal.series_rows(df.withColumn("t", F.lit("no date")), "t", ["v"]).collect()


def test_autocorrelation(spark, walk):
    rows = temporal.series_rows(table(spark, v=walk), "ts")
    x = walk - walk.mean()
    want = [float(x[k:] @ x[:len(x) - k] / (x @ x)) for k in range(41)]
    acf = temporal.autocorrelation(rows)
    got = {r.lag: r.acf for r in acf.collect()}
    assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in range(41))
    pacf = {r.lag: r.pacf for r in temporal.partial_autocorrelation(acf).collect()}
    for k in (1, 2, 7):  # solve the Yule-Walker equations directly
        r = np.array([[want[abs(i - j)] for j in range(k)] for i in range(k)])
        assert math.isclose(pacf[k], np.linalg.solve(r, want[1:k + 1])[-1], abs_tol=1e-8)
    first = [r.lag for r in temporal.significant_lags(acf).orderBy("lag").collect()]
    assert first == [k for k in range(1, 41) if abs(want[k]) > 1.96 / math.sqrt(500)][:10]


def adf_direct(y):
    y = np.asarray(y) - np.mean(y)
    n, d = len(y), np.diff(y)
    top = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))

    def fit(p, start):
        x = np.column_stack([np.ones(n - 1 - start), y[start:n - 1], *[d[start - k:n - 1 - k] for k in range(1, p + 1)]])
        target = d[start:]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        ssr = ((target - x @ beta) ** 2).sum()
        cov = np.linalg.inv(x.T @ x) * ssr / (len(x) - x.shape[1])
        return beta[1] / math.sqrt(cov[1, 1]), len(x) * math.log(ssr / len(x)) + 2 * x.shape[1], len(x)

    best = min(range(top + 1), key=lambda p: fit(p, top)[1])
    tau, _, used = fit(best, best)
    return tau, best, used


def test_stationarity(spark, walk):
    noise = np.random.default_rng(4).normal(size=500)
    rows = temporal.series_rows(table(spark, walk=walk, noise=noise, flat=np.full(500, 3.0)), "ts")
    got = {r.series: r for r in temporal.stationarity(rows).collect()}
    for name, y in (("walk", walk), ("noise", noise)):
        tau, lags, used = adf_direct(y)
        assert (got[name].n_lags, got[name].n_obs) == (lags, used)
        assert math.isclose(got[name].statistic, tau, rel_tol=1e-8)
        assert math.isclose(got[name].p_value, tails.adf_p(tau), rel_tol=1e-6)
    assert got["noise"].is_stationary and not got["walk"].is_stationary
    assert got["flat"].status == "constant" and got["flat"].statistic is None
    short = temporal.series_rows(table(spark, v=[1, 2, 3, 4, 5]), "ts")
    assert temporal.stationarity(short).first().status == "insufficient_data"


def test_trend_and_changepoints(spark, walk):
    rows = temporal.series_rows(table(spark, v=walk, c=np.full(500, 2.0)), "ts")
    got = {r.series: r for r in temporal.trend(rows).collect()}
    slope, cut = np.polyfit(np.arange(500), walk, 1)
    assert math.isclose(got["v"].slope, slope, rel_tol=1e-9)
    assert (got["c"].direction, got["c"].r_squared) == ("flat", 0.0)
    d = np.diff(walk)
    want = [i + 1 for i, v in enumerate(d) if abs(v - d.mean()) > d.mean() + 2 * d.std()]
    found = temporal.changepoint_rows(rows).where("series = 'v'")
    assert sorted(r.idx for r in found.collect()) == want
    first = temporal.first_changepoints(rows).where("series = 'v'").orderBy("rank").collect()
    assert [r.idx for r in first] == want[:20]
    assert {r.series: r.n_changepoints for r in temporal.changepoints(rows).collect()}["v"] == len(want)
    short = temporal.series_rows(table(spark, v=[1.0, 2.0]), "ts")
    assert temporal.trend(short).first().status == "insufficient_data"
    assert temporal.changepoints(short).first().status == "insufficient_data"


@pytest.mark.parametrize("period", [12, 7])
@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_decomposition(spark, walk, period, model):
    rows = temporal.series_rows(table(spark, v=walk), "ts")
    ratio = model == "multiplicative"
    weights = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    h = period // 2
    trend = np.full(500, np.nan)
    trend[h:500 - h] = np.convolve(walk, weights, "valid")
    apart = walk / trend if ratio else walk - trend
    phases = np.array([np.nanmean(apart[i::period]) for i in range(period)])
    phases = phases / phases.mean() if ratio else phases - phases.mean()
    parts = temporal.decompose(rows, period, model).orderBy("idx").toPandas()
    assert np.allclose(parts.trend.to_numpy(dtype=float), trend, equal_nan=True)
    assert np.allclose(parts.seasonal, phases[np.arange(500) % period])
    share = temporal.component_strengths(temporal.decompose(rows, period, model)).first()
    assert math.isclose(share.trend_strength + share.seasonal_strength + share.residual_strength, 1.0)


def test_decompose_table_skips_gaps_and_nonpositive(spark, walk):
    df = table(spark, whole=walk, gap=[None, *walk[1:]], low=walk - 300)
    got = {(r.series, r.method) for r in temporal.decompose_table(df, "ts").select("series", "method").distinct().collect()}
    assert got == {("whole", "additive"), ("whole", "multiplicative"), ("low", "additive")}


def test_profile_and_gaps(spark, walk):
    df = table(spark, v=[None, *walk[1:]])
    p = temporal.profile(df, "ts").first()
    assert (p.total_observations, p.missing_values, p.missing_percentage, p.span_days) == (500, 1, 0.2, 20)
    cut = df.where("hour(ts) <> 5")
    assert temporal.missing_periods(cut, "ts", "hour").count() == 21
    months = spark.createDataFrame([(datetime.date(2023, 11, 5),), (datetime.date(2024, 2, 1),)], "d date")
    assert sorted(r.period for r in temporal.missing_periods(months, "d", "month").collect()) == [
        datetime.datetime(2023, 12, 1), datetime.datetime(2024, 1, 1)]


def test_no_single_partition_window(spark, walk, capsys):
    rows = temporal.series_rows(table(spark, v=walk), "ts")
    temporal.changepoint_rows(rows).explain()
    temporal.decompose(rows).explain()
    assert "SinglePartition" not in capsys.readouterr().out


def test_analyze_overview(spark, walk):
    line = temporal.overview(temporal.analyze(table(spark, v=walk), "ts")).first()
    assert line.series == "v" and line.direction in ("upward", "downward", "flat")


def test_analyze_streams_the_steps_once(spark, walk, monkeypatch):
    made, real = [], temporal._steps
    monkeypatch.setattr(temporal, "_steps", lambda rows: made.append(1) or real(rows))
    rows = table(spark, v=walk, gone=[None] * len(walk))
    sections = temporal.analyze(rows, "ts")
    plan = temporal.overview(sections)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "InArrow" not in plan and "InPandas" not in plan
    ordered = temporal.series_rows(rows, "ts")
    apart = {r.series: r for r in temporal.changepoints(ordered).collect()}
    found = {r.series: r for r in sections["changepoints"].collect()}
    assert found["v"].n_changepoints == apart["v"].n_changepoints and found["v"].std_change == pytest.approx(apart["v"].std_change, rel=1e-12)
    assert found["gone"].status == "insufficient_data"
    first = [(r["rank"], r.idx, r.step) for r in sections["first_changepoints"].orderBy("rank").collect()]
    assert first == [(r["rank"], r.idx, r.step) for r in temporal.first_changepoints(ordered).orderBy("rank").collect()]
