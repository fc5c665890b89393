import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from finstrata.functions.draws import with_uniform
from finstrata.functions.ordered import hash_rank, mid_ranks, position, quantile_grid, quantiles, running_totals, sorted_position, value_counts, with_position


def frame(spark, values, group=None):
    rows = [(i, (group[i] if group else 0), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, g int, v double")


def skewed(n=3000, seed=1):
    """A third of all rows share one value."""
    rng = random.Random(seed)
    return [7.0 if rng.random() < 0.34 else rng.gauss(0, 3) for _ in range(n)]


def test_running_totals_match_numpy(spark):
    vals = skewed()
    t = running_totals(value_counts(frame(spark, vals), "v"), "v", ["n"], buckets=16).collect()
    u, c = np.unique(vals, return_counts=True)
    want = dict(zip(u, np.cumsum(c)))
    assert len(t) == len(u)
    assert all(r["n_cum"] == want[r["v"]] and r["n_tot"] == len(vals) for r in t)


def test_running_totals_per_group(spark):
    vals = skewed(900)
    group = [i % 3 for i in range(900)]
    t = running_totals(value_counts(frame(spark, vals, group), "v", ["g"]), "v", ["n"], ["g"]).collect()
    for g in range(3):
        mine = [v for v, k in zip(vals, group) if k == g]
        u, c = np.unique(mine, return_counts=True)
        want = dict(zip(u, np.cumsum(c)))
        assert all(r["n_cum"] == want[r["v"]] for r in t if r["g"] == g)


@pytest.mark.parametrize("n", [1, 2, 5, 501])
def test_quantiles_match_numpy(spark, n):
    vals = skewed(n, seed=n)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["prob"]: r["q"] for r in quantiles(frame(spark, vals), "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(vals, p), abs=1e-12)


@pytest.mark.parametrize("n", [1, 3, 700])
def test_quantile_grid_matches_numpy(spark, n):
    vals = skewed(n, seed=n)
    got = {r["k"]: r["q"] for r in quantile_grid(frame(spark, vals), "v", 50).collect()}
    assert sorted(got) == list(range(51))
    assert np.allclose([got[k] for k in range(51)], np.quantile(vals, np.linspace(0, 1, 51)))


def test_mid_ranks(spark):
    got = {r["v"]: r["mid_rank"] for r in mid_ranks(frame(spark, [3, 1, 3, 2, 3]), "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_positions_are_a_permutation(spark):
    df = frame(spark, skewed(2000))
    t = with_uniform(df, "u", F.col("id"), 5)
    got = hash_rank(t, F.col("u"), "id").select("id", "u", "pos").collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["pos"])] == [r["id"] for r in sorted(got, key=lambda r: (r["u"], r["id"]))]
    got = sorted_position(df, "v", "id").collect()
    assert sorted(r["pos"] for r in got) == list(range(1, 2001))
    assert [r["id"] for r in sorted(got, key=lambda r: r["pos"])] == [r["id"] for r in sorted(got, key=lambda r: (r["v"], r["id"]))]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(bounds=st.lists(st.integers(-50, 50), min_size=1, max_size=120), v=st.integers(-60, 60))
def test_position_two_level_search(spark, bounds, v):
    arr = F.array(*[F.lit(float(b)) for b in sorted(bounds)])
    r = spark.range(1).select(position(F.lit(float(v)), arr).alias("lt"), position(F.lit(float(v)), arr, strict=False).alias("le")).first()
    assert r["lt"] == sum(b < v for b in bounds) and r["le"] == sum(b <= v for b in bounds)


@pytest.mark.parametrize("most", [1, 2, 3, 7, 31, 120, 199])
def test_binary_search_counts_entries(spark, most):
    rng = random.Random(most)
    rows = [(sorted(rng.choices(range(-20, 21), k=rng.randint(0, most))), rng.randint(-25, 25)) for _ in range(300)]
    df = spark.createDataFrame([([float(b) for b in bounds], float(v)) for bounds, v in rows], "bounds array<double>, v double")
    got = with_position(with_position(df, "lt", F.col("v"), "bounds", most), "le", F.col("v"), "bounds", most, strict=False).collect()
    assert all(r["lt"] == sum(b < r["v"] for b in r["bounds"]) and r["le"] == sum(b <= r["v"] for b in r["bounds"]) for r in got)


def test_running_totals_search_compiled_and_move_values_once(spark):
    rows = spark.createDataFrame([(i % 3, float(i % 50)) for i in range(500)], "g int, v double")
    plan = running_totals(value_counts(rows, "v", ["g"]), "v", ["n"], ["g"], buckets=200, few=True)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("REPARTITION_BY_COL") == 1 and len(plan) < 20_000


def test_values_of_a_group_without_any_known_order_are_left_out(spark):
    rows = spark.createDataFrame([(0, 1.0, 1), (0, 2.0, 1), (1, None, 1)], "g int, v double, n int")
    assert sorted((r["g"], r["n_cum"]) for r in running_totals(rows, "v", ["n"], ["g"]).collect()) == [(0, 1), (0, 2)]
    assert running_totals(rows.where("g = 1"), "v", ["n"]).count() == 0


def test_uniform_draws_are_even(spark):
    u = with_uniform(spark.range(20000), "u", F.col("id"), 3).agg(
        F.avg("u").alias("m"), F.stddev("u").alias("s"), F.countDistinct(F.floor(F.col("u") * 100)).alias("b")).first()
    assert abs(u["m"] - 0.5) < 0.01 and abs(u["s"] - 0.2887) < 0.01 and u["b"] == 100
