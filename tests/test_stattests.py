import itertools
import math

import numpy as np
import pandas as pd
import pytest

from plumbline.functions import tails
from plumbline.operators import stattests


def test_rank_sum_p_of_any_size():
    from itertools import combinations

    from plumbline.functions import tails

    for a, b in ((1, 4), (3, 6), (5, 7)):
        values = [sum(s) - a * (a - 1) // 2 for s in combinations(range(a + b), a)]
        for u in range(a * b + 1):
            want = 2 * sum(v >= max(u, a * b - u) for v in values) / len(values)
            assert abs(tails.rank_sum_exact(u, a, b) - min(1.0, want)) < 1e-12
    far = tails.rank_sum_exact(2.4e8, 8, 10 ** 8)  # three million times the old limit
    assert abs(far - tails.rank_sum_exact(2.4e5, 8, 10 ** 5)) < 1e-4


def test_closed_forms():
    for t in (0.3, 1.0, 12.7, 400.0):
        assert math.isclose(tails.t_two_sided(t, 1), 1 - 2 * math.atan(t) / math.pi, rel_tol=1e-9)
        assert math.isclose(tails.t_two_sided(t, 2), 1 - t / math.sqrt(2 + t * t), rel_tol=1e-8)
        assert math.isclose(tails.f_upper(t, 2, 10), (1 + 2 * t / 10) ** -5, rel_tol=1e-9)
        assert math.isclose(tails.chi2_upper(t, 2), math.exp(-t / 2), rel_tol=1e-9)
        assert math.isclose(tails.chi2_upper(t, 1), tails.normal_two_sided(math.sqrt(t)), rel_tol=1e-9)


def test_exact_rank_sum_counts_arrangements():
    n1, n2 = 3, 4
    us = [sum(a > b for a in pick for b in set(range(7)) - set(pick)) for pick in itertools.combinations(range(7), n1)]
    for u in range(n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        expected = min(1.0, 2 * sum(v >= top for v in us) / len(us))
        assert math.isclose(tails.rank_sum_exact(u, n1, n2), expected)


def test_adf_constants():
    assert [round(tails.adf_p(t), 3) for t in (-3.43035, -2.86154, -2.56677)] == [0.01, 0.05, 0.1]
    assert tails.adf_p(-20) == 0.0 and tails.adf_p(3) == 1.0
    assert abs(tails.adf_p(-1.61) - tails.adf_p(-1.609)) < 2e-3


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    n = 400
    return pd.DataFrame({
        "two": rng.choice(["b", "a"], n), "three": rng.choice(list("xyz"), n),
        "v": np.round(rng.normal(size=n), 1), "w": rng.uniform(1e9, 1e9 + 5, n)})


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_against_numpy(spark, sample, parts):
    df = spark.createDataFrame(sample).repartition(parts)
    a, b = (sample.v[sample.two == g].to_numpy() for g in "ab")
    t = stattests.t_tests(df, ["two"], ["v"]).first()
    se = a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)
    assert math.isclose(t.statistic, (a.mean() - b.mean()) / math.sqrt(se), rel_tol=1e-9)
    u = stattests.mann_whitney(df, ["two"], ["v"]).first()
    ranks = sample.v.rank()
    assert u.statistic == ranks[sample.two == "a"].sum() - len(a) * (len(a) + 1) / 2
    assert u.tie_term == sum(c**3 - c for c in sample.v.value_counts())
    f = stattests.anova(df, ["three"], ["w"]).first()
    groups = [sample.w[sample.three == g].to_numpy() for g in "xyz"]
    between = sum(len(g) * (g.mean() - sample.w.mean()) ** 2 for g in groups) / 2
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(sample) - 3)
    assert math.isclose(f.statistic, between / within, rel_tol=1e-4)


def test_named_groups_flip_the_sign(spark, sample):
    df = spark.createDataFrame(sample)
    t1 = stattests.t_tests(df, ["three"], ["v"], ["x", "z"]).first()
    t2 = stattests.t_tests(df, ["three"], ["v"], ["z", "x"]).first()
    assert t1.statistic == -t2.statistic and (t2.group1, t2.group2) == ("z", "x")


def test_chi_square_yates_and_missing_cells(spark):
    cells = [("a", "x", 12), ("a", "y", 5), ("b", "x", 4), ("b", "y", 9)]
    df = spark.createDataFrame([(r, c) for r, c, n in cells for _ in range(n)], "r string, c string")
    got = stattests.chi_square(df).first()
    assert math.isclose(got.statistic, 3.229436, abs_tol=1e-6) and got.df == 1
    holes = spark.createDataFrame([(i, j) for i, j in zip("aaabbbccc", "xxyyyzzzx")], "r string, c string")
    table = np.array([[2, 1, 0], [0, 2, 1], [1, 0, 2]])
    e = np.outer(table.sum(1), table.sum(0)) / table.sum()
    assert math.isclose(stattests.chi_square(holes).first().statistic, ((table - e) ** 2 / e).sum(), rel_tol=1e-9)


def test_too_small_or_single(spark):
    df = spark.createDataFrame([("a", "k", 1.0), ("a", "k", 2.0), ("b", "k", 3.0), ("b", "k", 4.0), ("b", "k", 5.0)],
                               "g string, one string, v double")
    assert stattests.t_tests(df, ["g"]).count() == 0
    assert stattests.mann_whitney(df, ["g"]).count() == 0
    assert stattests.anova(df, ["g"]).count() == 0
    assert stattests.chi_square(df).count() == 0


def test_run_all(spark, sample):
    counts = {r.test: r.n_tests for r in stattests.significance_counts(
        stattests.run_all(spark.createDataFrame(sample))).collect()}
    assert counts == {"ttest": 2, "mannwhitney": 2, "anova": 4, "chi2": 1}


def test_contingency_with_a_hot_level_and_long_texts(spark, tmp_path):
    """One level holds a third of the rows and of the cells; texts beyond the digest length are told apart to the last letter."""
    rng = np.random.default_rng(6)
    n = 4000
    a = np.where(rng.random(n) < 0.34, "hot", np.char.add("x" * 300, rng.integers(0, 40, n).astype(str)))
    b = np.where(a == "hot", np.arange(n) % 900, rng.integers(0, 900, n)).astype(str)
    spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a string, b string").write.parquet(str(tmp_path / "t"))
    made = stattests.chi_square(spark.read.parquet(str(tmp_path / "t")), ["a", "b"])
    plan = made._jdf.queryExecution().optimizedPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "t") not in plan  # the source was read once, for the staged cells
    seen = pd.crosstab(pd.Series(a), pd.Series(b)).to_numpy().astype(float)
    expected = seen.sum(1)[:, None] * seen.sum(0) / seen.sum()
    got = made.first()
    assert math.isclose(got.statistic, ((seen - expected) ** 2 / expected).sum(), rel_tol=1e-9)
    assert (got.n_rows, got.n_cols, got.n_total) == (*seen.shape, n)


def test_rank_tests_of_many_pairs_share_one_line_per_value(spark):
    rng = np.random.default_rng(7)
    n = 500
    table = pd.DataFrame({"x": rng.integers(0, 30, n).astype(float), "y": rng.normal(size=n), "a": rng.choice(["p", "q"], n), "b": rng.choice(["u", "v"], n),
                          "c": rng.choice(["k", "l", "m"], n)})
    table.loc[::9, "x"] = np.nan
    table.loc[::7, "a"] = None
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in table.itertuples(index=False)], "x double, y double, a string, b string, c string")
    got = {(r.cat, r.num): r for r in stattests.mann_whitney(df, ["a", "b", "c"], ["x", "y"]).collect()}
    assert set(got) == {(c, x) for c in "ab" for x in "xy"}
    for (c, x), r in got.items():
        g = sorted(table[c].dropna().unique())
        one, two = (table.loc[(table[c] == v) & table[x].notna(), x].to_numpy() for v in g)
        u = (one[:, None] > two).sum() + (one[:, None] == two).sum() / 2
        assert (r.group1, r.group2, r.n_g1, r.n_g2) == (*g, len(one), len(two)) and math.isclose(r.statistic, u, rel_tol=1e-12)
