"""Tail probabilities for result tables (one row per feature or per pair, so Arrow batches are tiny)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) for a standard normal."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)))


@pandas_udf(DoubleType())
def chi2_one_df(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(max(v, 0.0) / 2.0)))


@pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|): Simpson integration of cos^(df-1) after the substitution t = sqrt(df) * tan(a)."""

    def tail(tv: float, dv: float) -> float | None:
        if pd.isna(tv) or pd.isna(dv) or dv <= 0:
            return None
        lo, hi = math.atan(abs(tv) / math.sqrt(dv)), math.pi / 2
        a = np.linspace(lo, hi, 2001)
        y = np.cos(a) ** (dv - 1)
        w = np.ones_like(a)
        w[1:-1:2], w[2:-1:2] = 4, 2
        area = float((w * y).sum() * (hi - lo) / 2000 / 3)
        const = math.exp(math.lgamma((dv + 1) / 2) - math.lgamma(dv / 2)) / math.sqrt(math.pi)
        return min(1.0, 2.0 * const * area)

    return pd.Series([tail(a, b) for a, b in zip(t, df)])


def kolmogorov(x: Column, terms: int = 100) -> Column:
    """Limiting upper tail 2 * sum (-1)^(k-1) exp(-2 k^2 x^2) of the two-sample statistic."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


def exact_ks_tail(d: float, n: int, m: int) -> float:
    """P(D >= d) of the two-sample statistic without ties: the share of lattice paths from (0, 0) to (n, m) that leave the band |i/n - j/m| < d.

    Step s holds, for every place (i, s - i) within the band, the share of the paths there that have left it before; outside it is 1. The last step
    of a path to (i, j) came from (i - 1, j) with chance i / s. Shares stay in [0, 1] and are summed without differences, so small tails keep their digits.
    """
    reach = round(d * n * m)  # d is a multiple of 1 / (n m)
    if reach <= 0:
        return 1.0
    left = np.ones(n + 2)  # place i + 1
    left[1] = 0.0
    for s in range(1, n + m + 1):
        low = max(0, s - m, (s * n - reach) // (n + m) + 1)
        high = min(n, s, -((-s * n - reach) // (n + m)) - 1)
        i = np.arange(low, high + 1)
        left[low + 1:high + 2] = (i * left[low:high + 1] + (s - i) * left[low + 1:high + 2]) / s
        left[low] = 1.0
    return float(left[n + 1])


@pandas_udf(DoubleType())
def _exact_ks(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else exact_ks_tail(x, int(a), int(b)) for x, a, b in zip(d, n, m)], dtype="float64")


def two_sample_ks_p(d: Column, n: Column, m: Column, exact_up_to: int) -> Column:
    """Exact tail while both samples hold at most ``exact_up_to`` rows, the limiting one beyond. Null for no statistic."""
    small = F.greatest(n, m) <= exact_up_to
    limiting = kolmogorov(d * F.sqrt(n.cast("double") * m / (n + m)))
    return F.when(d.isNotNull(), F.coalesce(_exact_ks(F.when(small, d), n, m), limiting) if exact_up_to else limiting)
