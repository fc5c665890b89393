"""Statistics over a table read it a fixed number of times; what they need again is landed."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from finstrata.operators import statistics as K

N = 400


def counted(spark):
    """(long table whose rows count how often they are computed, the counter)"""
    seen = spark.sparkContext.accumulator(0)

    @pandas_udf("double")
    def value(i):
        seen.add(len(i))
        return (i * 37 % 101).astype(float)

    value = value.asNondeterministic()  # else filters compute it once more
    df = spark.range(0, N, 1, 1).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("is_ref"), F.lit("a").alias("feature"), value("id").alias("value"))
    return df, seen


@pytest.mark.parametrize("make, passes", [
    (K.mutual_information, 1), (K.psi, 1), (K.column_profile, 2), (K.target_association, 2), (K.drift_table, 2)])
def test_long_statistics_count_distinct_values_once(spark, make, passes):
    long, seen = counted(spark)
    assert len(make(long).collect()) == 1
    assert seen.value == passes * N


@pytest.mark.parametrize("make, passes", [(K.effective_dimensionality, 4), (K.variance_inflation, 5)])
def test_medians_are_filled_once(spark, make, passes):
    long, seen = counted(spark)
    assert make(long.select("value", (F.col("value") * F.col("value")).alias("w"), F.col("y").cast("double").alias("z")), ["value", "w", "z"]).count() > 0
    assert seen.value <= passes * N


def test_vif_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 3))
    a[:, 2] = a[:, 0] + 0.5 * rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in a], "a double, b double, c double")
    got = {r["feature"]: r["vif"] for r in K.variance_inflation(df, ["a", "b", "c"]).collect()}
    for i, n in enumerate("abc"):
        rest = np.column_stack([np.ones(200), np.delete(a, i, axis=1)])
        e = a[:, i] - rest @ np.linalg.lstsq(rest, a[:, i], rcond=None)[0]
        assert got[n] == pytest.approx(a[:, i].var() / e.var(), rel=1e-9)
