"""p-values from test statistics: vectorised over the (few) test rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a, b, x):
    """Continued fraction of the regularised incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a, b, x):
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t, df):
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def z_two_sided(z):
    return None if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2.0))


def signed_rank_exact(w, n):
    """Two-sided exact p of min(W+, W-) = w for n untied non-zero pairs."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy() if r < len(ways) else ways[r:]
    return float(min(1.0, 2.0 * ways[: int(w) + 1].sum() / 2.0**n))


#: the exact distribution is summed up to this many pairs of values; above it the
#: normal approximation with continuity correction agrees to more digits than are reported
EXACT_PAIRS = 20000


def rank_sum_exact(u, n1, n2):
    """Two-sided exact p of the Mann-Whitney U for untied samples."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1.0
    # choose which pooled positions belong to sample one; each contributes the
    # number of sample-two members before it
    for pos in range(1, n1 + n2 + 1):
        for k in range(min(n1, pos), 0, -1):
            gain = pos - k
            if gain <= n2:
                ways[k, gain:] += ways[k - 1, : n1 * n2 + 1 - gain]
    dist = ways[n1]
    hi = max(u, n1 * n2 - u)
    return float(min(1.0, 2.0 * dist[int(math.ceil(hi)):].sum() / dist.sum()))


def _num(v):
    return None if v is None or pd.isna(v) else float(v)


def _rows(fn, *cols):
    return pd.Series([fn(*[_num(v) for v in r]) for r in zip(*cols)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rows(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def z_pvalue(z: pd.Series) -> pd.Series:
    return _rows(z_two_sided, z)


@F.pandas_udf(DoubleType())
def chi2_1df_pvalue(stat: pd.Series) -> pd.Series:
    return _rows(lambda x: None if x is None else math.erfc(math.sqrt(max(x, 0.0) / 2.0)), stat)


def _signed_rank(w_plus, w_minus, n, tie_term, had_zeros):
    if w_plus is None or not n:
        return None
    w = min(w_plus, w_minus)
    if n <= 50 and not tie_term and not had_zeros:
        return signed_rank_exact(w, int(n))
    mean, var = n * (n + 1) / 4.0, n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0
    return z_two_sided((w - mean) / math.sqrt(var)) if var > 0 else None


@F.pandas_udf(DoubleType())
def signed_rank_pvalue(w_plus: pd.Series, w_minus: pd.Series, n: pd.Series, tie_term: pd.Series,
                       zeros: pd.Series) -> pd.Series:
    return _rows(_signed_rank, w_plus, w_minus, n, tie_term, zeros)


def _mann_whitney(u, n1, n2, tie_term):
    if u is None or not n1 or not n2:
        return None
    if min(n1, n2) <= 8 and not tie_term and n1 * n2 <= EXACT_PAIRS:
        return rank_sum_exact(u, int(n1), int(n2))
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))
    if var <= 0:
        return 1.0
    top = max(u, n1 * n2 - u)
    return min(1.0, z_two_sided((top - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)))


@F.pandas_udf(DoubleType())
def mann_whitney_pvalue(u: pd.Series, n1: pd.Series, n2: pd.Series, tie_term: pd.Series) -> pd.Series:
    return _rows(_mann_whitney, u, n1, n2, tie_term)
