"""Tail probabilities and small finishing steps on already aggregated numbers.

Everything here works on one result row (a statistic and its degrees of
freedom, a short list of autocorrelations), never on table rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Response-surface coefficients for the augmented Dickey-Fuller
# test with a constant (MacKinnon 1994 for p-values, 2010 for critical values).
ADF_P_SMALL = (2.1659, 1.4412, 0.038269)
ADF_P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_P_SWITCH, ADF_P_MIN, ADF_P_MAX = -1.61, -18.83, 2.74
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# KPSS critical values for a constant (Kwiatkowski et al. 1992).
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))

# P-value of the Kolmogorov-Smirnov distance from a normal with estimated mean and standard deviation
# (Lilliefors): the exponent of Dallal and Wilkinson (1986) up to p = 0.1, and polynomials in the distance scaled by
# Stephens (1974) beyond; (limit, coefficients from degree 0).
LILLIEFORS_EXPONENT = (-7.01256, 2.78019, 2.99587, -0.122119, 0.974598, 1.67997)
LILLIEFORS_LARGE, LILLIEFORS_POWER = 100, 0.49
LILLIEFORS_ONE = 0.302
LILLIEFORS_PARTS = (
    (0.5, (2.76773, -19.828315, 80.709644, -138.55152, 81.218052)),
    (0.9, (-4.901232, 40.662806, -97.490286, 94.029866, -32.355711)),
    (1.31, (6.198765, -19.558097, 23.186922, -12.234627, 2.423045)),
)

# Fixed value: the rank-sum p is exact when a group is this small and nothing is tied
EXACT_GROUP = 8

_TINY = 1e-300


def _continued_fraction(term, rounds: int = 20000) -> float:
    """Value of b0 + a1/(b1 + a2/(b2 + ...)) by the modified Lentz rule; ``term(k)`` gives (a_k, b_k)."""
    value = term(0)[1] or _TINY
    c, d = value, 0.0
    for k in range(1, rounds):
        a, b = term(k)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(1.0 - x, b, a)

    def term(k: int) -> tuple[float, float]:
        if k == 0:
            return 0.0, 1.0
        m, odd = divmod(k, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return math.exp(log_front) / a / _continued_fraction(term)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        total = piece = 1.0 / a
        k = a
        while abs(piece) > abs(total) * 1e-17:
            k += 1.0
            piece *= x / k
            total += piece
        return 1.0 - total * math.exp(log_front)
    return math.exp(log_front) / _continued_fraction(
        lambda k: (0.0 if k == 0 else -k * (k - a), x + 2 * k + 1.0 - a))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / (df + t * t), df / 2.0, 0.5)


def f_upper(f: float, df1: float, df2: float) -> float:
    return 1.0 if f <= 0 else beta_share(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def _sums_up_to(limit: int, m: int) -> int:
    """Number of multisets of parts 1..m that add up to ``limit`` at most.

    Exact for any limit: on limits equal modulo L = lcm(1..m) it is a polynomial
    of degree m, found from its values at the first m + 1 of them.
    """
    if limit < 0:
        return 0
    period = math.lcm(*range(1, m + 1))
    step, rest = divmod(limit, period)
    top = period * min(step, m) + rest
    ways = [1] + [0] * top
    for part in range(1, m + 1):
        for s in range(part, top + 1):
            ways[s] += ways[s - part]
    total, known = 0, []
    for s, w in enumerate(ways):
        total += w
        if s % period == rest:
            known.append(total)
    if step <= m:
        return known[step]
    # Newton's forward differences at ``step``
    value = 0
    for k in range(m + 1):
        value += known[0] * math.comb(step, k)
        known = [b - a for a, b in zip(known, known[1:])]
    return value


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of the U statistic without ties; the work depends on the smaller group alone.

    Arrangements with U <= x are coefficients of prod (1 - q^(n+i)) / (1 - q^i), i = 1..m: the subsets of the
    numerator's factors, each with the number of sums of the denominator's parts.
    """
    m, n = min(n1, n2), max(n1, n2)
    least = math.floor(min(u, n1 * n2 - u))  # the tail as far below the centre as u is away from it
    numerator = {0: 1}
    for i in range(1, m + 1):
        for used, sign in list(numerator.items()):
            if used + n + i <= least:
                numerator[used + n + i] = numerator.get(used + n + i, 0) - sign
    tail = sum(sign * _sums_up_to(least - used, m) for used, sign in numerator.items())
    return min(1.0, 2 * tail / math.comb(m + n, m))


def _p(kind: str, x: float, a: float, b: float) -> float | None:
    if x is None or math.isnan(x):
        return None
    if kind == "t":
        return t_two_sided(x, a)
    if kind == "f":
        return f_upper(x, a, b)
    if kind == "chi2":
        return chi2_upper(x, a)
    if kind == "normal":
        return min(1.0, normal_two_sided(max(x, 0.0)))
    raise ValueError(kind)


def p_value(kind: str, statistic: Column, df1: Column | None = None, df2: Column | None = None) -> Column:
    """p-value column for a result table; ``kind`` is t, f, chi2 or normal."""
    @F.pandas_udf("double")
    def tail(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_p(kind, *row) for row in zip(x, a, b)], dtype="float64")

    one = F.lit(1.0)
    return tail(statistic.cast("double"), (df1 if df1 is not None else one).cast("double"),
                (df2 if df2 is not None else one).cast("double"))


def rank_sum_p(u: Column, z: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """Two-sided rank-sum p: exact for a group of at most EXACT_GROUP without ties, else normal."""
    @F.pandas_udf("double")
    def tail(u: pd.Series, z: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for us, zs, a, b, tie in zip(u, z, n1, n2, ties):
            if min(a, b) <= EXACT_GROUP and tie == 0:
                out.append(rank_sum_exact(us, int(a), int(b)))
            else:
                # below the centre the continuity-corrected z may be negative; p is then capped at 1
                out.append(None if zs is None or math.isnan(zs) else min(1.0, math.erfc(zs / math.sqrt(2.0))))
        return pd.Series(out, dtype="float64")

    return tail(u.cast("double"), z.cast("double"), n1.cast("double"), n2.cast("double"), ties.cast("double"))


def lilliefors_p(distance: Column, n: Column) -> Column:
    """Chance of a larger distance of ``n`` normal values from the normal with their own mean and standard deviation."""
    slope, shift, lift, constant, root, inverse = LILLIEFORS_EXPONENT
    size = F.least(n, F.lit(LILLIEFORS_LARGE)).cast("double")
    d = distance * F.pow(F.greatest(n / F.lit(float(LILLIEFORS_LARGE)), F.lit(1.0)), F.lit(LILLIEFORS_POWER))
    small = F.exp(slope * d * d * (size + shift) + lift * d * F.sqrt(size + shift) + constant + root / F.sqrt(size) + inverse / size)
    scaled = (F.sqrt(n) - 0.01 + 0.85 / F.sqrt(n)) * distance
    large = F.when(scaled <= LILLIEFORS_ONE, 1.0)
    for limit, parts in LILLIEFORS_PARTS:
        value = F.lit(parts[-1])
        for c in parts[-2::-1]:
            value = value * scaled + F.lit(c)
        large = large.when(scaled <= limit, value)
    return F.when(small > 0.1, large.otherwise(0.0)).otherwise(small)


def adf_p(tau: float) -> float:
    if tau > ADF_P_MAX:
        return 1.0
    if tau < ADF_P_MIN:
        return 0.0
    poly = ADF_P_SMALL if tau <= ADF_P_SWITCH else ADF_P_LARGE
    return normal_cdf(sum(c * tau ** k for k, c in enumerate(poly)))


def adf_critical(n_obs: int) -> dict[str, float]:
    return {level: sum(c / n_obs ** k for k, c in enumerate(poly)) for level, poly in ADF_CRITICAL.items()}


def kpss_p(statistic: float) -> float:
    """Interpolated p, held at the table's ends."""
    xs, ps = zip(*KPSS_POINTS)
    return float(np.interp(statistic, xs, ps))


def partial_autocorrelations(acf: list[float]) -> list[float]:
    """Yule-Walker partial autocorrelations from autocorrelations 0..k (Durbin-Levinson)."""
    out, phi, noise = [1.0], np.zeros(0), 1.0
    for k in range(1, len(acf)):
        past = np.asarray(acf[k - 1:0:-1])
        if noise <= 0:
            out.append(float("nan"))
            continue
        last = (acf[k] - float(phi @ past)) / noise
        phi = np.append(phi - last * phi[::-1], last)
        noise *= 1.0 - last * last
        out.append(last)
    return out


def add_p_value(df: DataFrame, kind: str, alpha: float, df1: str | None = None, df2: str | None = None) -> DataFrame:
    """Append p_value, significant and alpha to a table with a ``statistic`` column."""
    p = p_value(kind, F.col("statistic"), F.col(df1) if df1 else None, F.col(df2) if df2 else None)
    return with_verdict(df.withColumn("p_value", p), alpha)


def with_verdict(df: DataFrame, alpha: float) -> DataFrame:
    return df.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False))).withColumn(
        "alpha", F.lit(float(alpha)))
