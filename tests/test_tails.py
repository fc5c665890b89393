"""Tail probabilities against enumeration."""

from __future__ import annotations

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from finstrata.functions.tails import exact_ks_tail, kolmogorov, two_sample_ks_p
from finstrata.operators.statistics import drift_table


def statistics(n: int, m: int) -> list[int]:
    """n * m * D of every order in which n and m values without ties can lie."""
    out = []
    for places in combinations(range(n + m), n):
        i = top = 0
        for s in range(n + m):
            i += s in places
            top = max(top, abs(i * m - (s + 1 - i) * n))
        out.append(top)
    return out


@pytest.mark.parametrize("n,m", [(1, 1), (1, 7), (3, 3), (4, 6), (5, 7), (8, 3), (8, 8)])
def test_exact_tail_equals_enumeration(n, m):
    every = statistics(n, m)
    for d in sorted({0, *every}):
        assert exact_ks_tail(d / (n * m), n, m) == pytest.approx(sum(x >= d for x in every) / len(every), abs=1e-12)


def test_small_tails_keep_their_digits():
    """Only two of all orders are fully apart."""
    from math import comb
    assert exact_ks_tail(1.0, 40, 45) == pytest.approx(2 / comb(85, 40), rel=1e-9)


def test_large_samples_come_near_the_limit(spark):
    d = spark.range(1).select(F.lit(0.031).alias("d"), F.lit(4000).alias("n"), F.lit(4000).alias("m"))
    got = d.select(two_sample_ks_p(F.col("d"), F.col("n"), F.col("m"), 10_000).alias("e"), two_sample_ks_p(F.col("d"), F.col("n"), F.col("m"), 100).alias("a"),
                   kolmogorov(F.col("d") * F.sqrt(F.lit(2000.0))).alias("k")).first()
    assert got["a"] == got["k"] and got["e"] != got["a"] and got["e"] == pytest.approx(got["a"], rel=0.05)


def test_drift_table_takes_the_exact_tail(spark):
    rows = [("a", v, r) for r, vs in ((1, [1, 2, 3, 4, 9]), (0, [5, 6, 7, 8])) for v in vs] + [("b", v, r) for r in (0, 1) for v in (1, 2)] + [("b", None, 1)]
    t = spark.createDataFrame([(f, None if v is None else float(v), r) for f, v, r in rows], "feature string, value double, is_ref int")
    got = {r["feature"]: (r["ks"], r["ks_p"]) for r in drift_table(t).collect()}
    every = statistics(5, 4)
    assert got["a"][0] == pytest.approx(0.8) and got["a"][1] == pytest.approx(sum(x >= 16 for x in every) / len(every))
    assert got["b"] == (None, None)  # too few rows
