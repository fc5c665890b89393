"""Cases that broke or changed behaviour on large or incomplete data."""

import datetime
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from finstrata.functions.draws import poisson_bounds, with_pair_uniform, with_uniform
from finstrata.operators import explain, facts, models, resample
from finstrata.operators.validate import Trial
from finstrata.session import checkpoint_dir
from finstrata.sources.writers import content_fingerprint, land_facts

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_fingerprint_of_twenty_million_rows(spark):
    r = content_fingerprint(spark.range(20_000_000).withColumn("id", F.col("id") % 5), ["id"]).first()
    assert r["n_rows"] == 20_000_000 and len(r["fingerprint"]) > 18


def test_draws_do_not_repeat_beyond_32_bits(spark):
    p = 2**31 - 1
    keys = spark.createDataFrame([(k, k + p, k + 2 * p, k + 10**15) for k in range(200)], "a long, b long, c long, d long")
    one = [with_uniform(keys, "u", F.col(c)).select("u").collect() for c in "abcd"]
    two = [with_pair_uniform(keys, "u", F.lit(3), F.col(c)).select("u").collect() for c in "abcd"]
    for draws in (one, two):
        rows = [tuple(r["u"] for r in d) for d in zip(*draws)]
        assert sum(len(set(r)) == 4 for r in rows) > 190 and all(0 <= x < 1 for r in rows for x in r)
    assert poisson_bounds()[:2] == [0.367879441171, 0.735758882343] and 12 <= len(poisson_bounds()) <= 16


def test_adasyn_with_large_ids(spark):
    big = 10**12
    rows = [(big + i, [float(i % 7), float(i % 3)], int(i % 10 == 0)) for i in range(200)]
    new = resample.adasyn_rows(spark.createDataFrame(rows, "id long, x array<double>, y int"), 0.5).select("id").collect()
    ids = sorted(-r["id"] for r in new)
    assert ids == list(range(1, len(ids) + 1)) and len(ids) == 70


def test_a_missing_publication_date_sets_no_limit(spark):
    day = datetime.date
    fact = ("E1", "USD", "Assets", None, day(2020, 3, 31), 5, "a-1", day(2020, 5, 1))
    long = spark.createDataFrame([fact], "entity string, unit string, tag string, start_d date, end_d date, val bigint, accn string, filed date")
    period = "entity string, fiscal_year int, fiscal_quarter int, period_start date, period_end date, available_on date"
    for published, method in ((None, "instant"), (day(2020, 6, 1), "instant"), (day(2020, 4, 1), "absent")):
        cells = facts.derive_cells(long, spark.createDataFrame([("E1", 2020, 1, day(2020, 1, 1), day(2020, 3, 31), published)], period))
        assert {r["method"] for r in cells.where(F.col("indicator").contains("assets") & ~F.col("indicator").contains("current")).collect()} == {method}


def test_one_feature_has_no_coalition(spark):
    assert explain.coalitions(spark, 1).count() == 0


def test_landed_facts_are_sorted_by_tag(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("T"), F.col("id") % 10).alias("tag"), (F.col("id") % 7).alias("entity"), F.col("id").alias("val"))
    land_facts(rows, str(tmp_path / "facts"), buckets=5)
    back = spark.read.parquet(str(tmp_path / "facts"))
    per_file = back.groupBy(F.input_file_name()).agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).collect()
    assert back.count() == 1000 and 2 <= len(per_file) <= 5 and sum(r["lo"] <= "T0" <= r["hi"] for r in per_file) <= 2


def test_trials_agree_to_six_digits():
    import random

    space = {"a": ("loguniform", 0.01, 1.0), "b": ("int", 2, 5), "c": ("choice", (1, 2)), "d": ("float", 0.0, 1.0)}
    for seed in range(50):
        p = dict(Trial.draw(space, random.Random(seed)).params)
        assert 0.01 <= p["a"] <= 1 and p["b"] in range(2, 6) and p["c"] in (1, 2) and 0 <= p["d"] <= 1
    assert Trial.of({"x": 0.12345678, "y": 2}).name == Trial.of({"y": 2, "x": 0.1234570}).name != Trial.of({"x": 0.12346, "y": 2}).name
    with pytest.raises(ValueError):
        Trial.draw({"a": ("gauss", 0, 1)}, random.Random(1))


def test_calibrated_scores_are_probabilities(spark):
    rows = [(i, [float(i % 10), float(i % 3)], int(i % 10 > 7)) for i in range(200)]
    train = spark.createDataFrame(rows, "id long, x array<double>, y int")
    model = models.fit_technique(models.STRATEGIES["calibrated"], train, folds=2, maxIter=3)
    p = [r["p"] for r in models.score(model, models.vectorized(train), ["id", "y"]).collect()]
    assert len(p) == 200 and all(0 <= x <= 1 for x in p) and abs(sum(p) / 200 - 0.2) < 0.05


def test_workers_get_the_package(tmp_path):
    """Run from another folder, with the package on the driver's path only: workers import it from what the driver ships."""
    code = f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from finstrata.session import local_session, ship
        spark = local_session("2")
        ship(spark)
        from finstrata.operators import resample
        rows = [(i, [float(i % 7), float(i % 3)], int(i % 10 == 0)) for i in range(100)]
        print("made", resample.smote_rows(spark.createDataFrame(rows, "id long, x array<double>, y int"), 0.5).count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "made 35" in out.stdout, out.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
