"""The steps that every fit shares: medians, weights, folds."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from finstrata.operators import models as L
from finstrata.operators import preprocess as Q
from finstrata.operators import validate as V


def _lower_median(v):
    v = np.sort(np.array([x for x in v if x is not None], dtype=float))
    return v[(len(v) + 1) // 2 - 1]


def test_medians_are_exact_where_a_task_holds_few_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), None if i % 3 else float(b), None, float("nan") if i % 2 else 1.0, 5) for i, (a, b) in enumerate(rng.normal(size=(8001, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, none double, odd double, whole int").repartition(3)
    got = Q.sketched_medians(df, df.columns)
    assert got["a"] == _lower_median([r[0] for r in rows]) and got["b"] == _lower_median([r[1] for r in rows])
    assert "none" not in got and got["odd"] == 1.0 and got["whole"] == 5.0
    assert Q.sketched_medians(df.where("a > 100"), ["a"]) == {}


def test_points_stand_for_equal_stretches():
    v = np.random.default_rng(2).permutation(25_000).astype(float)
    got, n = Q._points(v)
    assert len(got) == Q.POINTS and n.sum() == len(v) and n.max() <= 3 and (np.diff(got) > 0).all()
    assert abs(got[np.searchsorted(np.cumsum(n), len(v) / 2)] - 12_500) <= 3


def test_weights_of_one_need_no_pass(spark):
    df = spark.createDataFrame([(0,), (1,)], "y int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("weights-of-one", "")
    try:
        rows = L.with_weights(df, "none")
        assert not tracker.getJobIdsForGroup("weights-of-one")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["w"] for r in rows.collect()} == {1.0}


def test_folds_are_fitted_at_the_same_time_and_scored_once(spark):
    df = spark.createDataFrame([(i, i % 2, i // 10, float(i % 7)) for i in range(20)], "id long, y int, fold int, x double")
    meet = threading.Barrier(2)

    class Plain:
        def transform(self, rows):
            return rows.withColumn("p", F.udf(lambda v: v / 7, "double")("x"))

    def fit(train):
        assert train.count() == 10
        meet.wait(60)
        return Plain()

    oof = V.out_of_fold(df, fit, ["id"])
    assert sorted((r["id"], r["fold"], r["y"], r["p"]) for r in oof.collect()) == [(i, i // 10, i % 2, pytest.approx(i % 7 / 7)) for i in range(20)]
    assert "PythonUDF" not in oof._jdf.queryExecution().analyzed().toString()


def test_a_fold_without_both_classes_is_left_out(spark):
    df = spark.createDataFrame([(i, int(i < 10 and i % 2), i // 10) for i in range(20)], "id long, y int, fold int")
    seen = []

    class Flat:
        def transform(self, rows):
            return rows.withColumn("p", F.lit(0.5))

    oof = V.out_of_fold(df, lambda t: seen.append(t.count()) or Flat(), ["id"])
    assert seen == [10] and {r["fold"] for r in oof.collect()} == {1}
    with pytest.raises(ValueError):
        V.out_of_fold(df.where("fold = 1"), lambda t: Flat(), ["id"])
