"""Left-out models against separate fits."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from finstrata.operators import leave_out


def table(spark, entities, rows=30, seed=1):
    draw = np.random.default_rng(seed)
    out = []
    for e in range(entities):
        shift = draw.normal(size=3) * 0.6
        for i in range(rows):
            x = draw.normal(size=3) * [1.0, 5.0, 0.2] + shift
            y = int(x[0] - 0.2 * x[1] + draw.normal() > 0.3)
            split = "train" if i < rows * 0.6 else "validation" if i < rows * 0.8 else "test"
            out.append((e, split, y, *[float(v) for v in x]))
    return spark.createDataFrame(out, "entity int, split string, y int, a double, b double, c double")


def separate(df, e, reg):
    train = df.where(f"split = 'train' and entity <> {e}")
    stages = VectorAssembler(inputCols=["a", "b", "c"], outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="v", withMean=True).fit(stages.transform(train))
    fit = LogisticRegression(featuresCol="v", labelCol="y", regParam=reg, maxIter=500, tol=1e-12).fit(scaler.transform(stages.transform(train)))
    out = fit.transform(scaler.transform(stages.transform(df.where(f"split <> 'train' and entity = {e}"))))
    return sorted(float(r["probability"][1]) for r in out.select("probability").collect())


def test_equals_separate_fits(spark):
    df = table(spark, 5)
    got = {}
    for r in leave_out.leave_one_entity_out(df, ["a", "b", "c"], reg=0.05, passes=15).collect():
        assert not r["skipped"] and r["n_test"] == 12
        got.setdefault(r["entity"], []).append(r["p"])
    for e in (0, 3):
        assert np.allclose(sorted(got[e]), separate(df, e, 0.05), atol=2e-5)


def test_without_passes_the_gap_shrinks_with_the_number_of_entities(spark):
    gaps = []
    for entities in (4, 24):
        df = table(spark, entities, rows=20, seed=3)
        rows = lambda passes: sorted((r["entity"], r["p"]) for r in leave_out.leave_one_entity_out(df, ["a", "b", "c"], passes=passes).collect())
        gaps.append(max(abs(a[1] - b[1]) for a, b in zip(rows(0), rows(6))))
    assert gaps[1] < gaps[0] / 4


def test_few_rows_and_one_class_are_skipped(spark):
    df = spark.createDataFrame(
        [(1, "train", 1, 1.0), (1, "train", 0, 2.0), (1, "test", 1, 1.0), (2, "train", 0, 0.5), (2, "train", 0, 0.1)] + [(2, "test", i % 2, float(i)) for i in range(5)]
        + [(3, "test", 1, 2.0)] * 5 + [(2, "other", 1, 9.0)], "entity int, split string, y int, a double")
    got = {r["entity"]: (r["skipped"], r["n_test"]) for r in leave_out.leave_one_entity_out(df, ["a"]).collect()}
    assert got == {1: (True, 1), 2: (False, 5)}
