"""Boosted trees against a plain search of every split, and what the parameters promise."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from finstrata.operators import boosting as B


def table(spark, n=220, d=4, seed=0, missing=0.15):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, d)), 1)
    y = (x[:, 0] + (x[:, 1] > 0.3) * 1.5 + draw.normal(size=n) * 0.5 > 0.8).astype(int)
    x[draw.random((n, d)) < missing] = np.nan
    x[(y == 1) & (draw.random(n) < 0.3), -1] = np.nan
    w = draw.uniform(0.5, 3.0, n)  # no two splits gain the same
    rows = [(i, [float(v) for v in r], int(a), float(b)) for i, (r, a, b) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(rows, "id long, features array<double>, y int, w double").repartition(3), x, y, w


def plain_round(x, g, h, use, cols, depth, l2, rate, min_rows):
    """Grow one tree by trying every value of every feature with missing values on either side; returns the value of each row."""
    out = np.zeros(len(x))

    def value(rows):
        r = rows & use
        return -rate * g[r].sum() / (h[r].sum() + l2)

    def score(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + l2)

    def grow(rows, level):
        out[rows] = value(rows) if level else 0.0
        r = rows & use
        best = None
        for j in cols if level < depth else ():
            known = ~np.isnan(x[:, j])
            for v in np.unique(x[r & known, j]):
                for gap_left in (True, False):
                    left = np.where(known, x[:, j] <= v, gap_left)
                    a, b = r & left, r & ~left
                    if min(a.sum(), b.sum()) < min_rows or min(h[a].sum(), h[b].sum()) < 1e-3:
                        continue
                    gain = score(a) + score(b) - score(r)
                    if gain > B.MIN_GAIN and (best is None or gain > best[0] + 1e-10):
                        best = (gain, rows & left, rows & ~left, j, v, known)
        if best:
            gain, left, right, j, v, known = best
            if not (r & ~known).any():  # none missing here: they follow the larger side
                larger_left = 2 * (r & left).sum() >= r.sum()
                left = rows & np.where(known, x[:, j] <= v, larger_left)
                right = rows & ~left
            grow(left, level + 1)
            grow(right, level + 1)

    grow(np.ones(len(x), bool), 0)
    return out


@pytest.mark.parametrize("objective,start", [("log", None), (B.FocalLoss(2.0, 0.7), 0.0)])
def test_equals_a_plain_search(spark, objective, start):
    df, x, y, w = table(spark)
    model = B.HistogramBoosting(weightCol="w", maxIter=4, stepSize=0.3, maxDepth=3, minRows=5, objective=objective, start=start, key="id").fit(df)
    share = (w * y).sum() / w.sum()
    margin = np.full(len(x), np.log(share / (1 - share)) if start is None else start)
    loss = B.log_loss if objective == "log" else objective
    for _ in range(4):
        g, h, _ = loss(y.astype(float), margin)
        margin = margin + plain_round(x, g * w, h * w, np.ones(len(x), bool), range(4), 3, 1.0, 0.3, 5)
    got = {r["id"]: r["probability"][1] for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_drawn_rows_and_columns(spark):
    df, x, y, w = table(spark, d=5)
    model = B.HistogramBoosting(weightCol="w", maxIter=3, stepSize=0.5, maxDepth=2, subsample=0.6, colsample=0.5, key="id", seed=3).fit(df)
    share = (w * y).sum() / w.sum()
    margin = np.full(len(x), np.log(share / (1 - share)))
    for r in range(3):
        use = B._rows_drawn(np.arange(len(x)), 0.6, 3 * 1009 + 2 * r + 1)
        assert 0.4 < use.mean() < 0.8
        g, h, _ = B.log_loss(y.astype(float), margin)
        cols = B._columns_drawn(5, 0.5, 3 * 1009 + 2 * r)
        assert len(cols) == 2
        margin = margin + plain_round(x, g * w, h * w, use, cols, 2, 1.0, 0.5, 1)
    got = {r["id"]: r["probability"][1] for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_margins_survive_being_landed(spark, monkeypatch):
    df, *_ = table(spark, n=150, d=2)
    fit = lambda: B.HistogramBoosting(maxIter=7, stepSize=0.3, maxDepth=2, key="id").fit(df).getOrDefault("trees")
    one = fit()
    monkeypatch.setattr(B, "REFRESH", 2)
    two = fit()
    assert np.allclose([v for t in B.json.loads(one) for v in t["value"]], [v for t in B.json.loads(two) for v in t["value"]], atol=1e-12)


def test_early_stopping_keeps_the_best_round(spark):
    df, *_ = table(spark, n=240, d=6, seed=4)
    df = df.withColumn("late", F.col("id") % 3 == 0)
    model = B.HistogramBoosting(maxIter=40, stepSize=0.8, maxDepth=3, held="late", patience=3, key="id").fit(df)
    losses = model.getOrDefault("losses")
    assert len(model.learned()) == int(np.argmin(losses)) and len(losses) <= len(model.learned()) + 4
    y, p = zip(*[(r["y"], r["probability"][1]) for r in model.transform(df.where("late")).collect()])
    assert -np.mean(np.where(np.array(y) == 1, np.log(p), np.log1p(-np.array(p)))) == pytest.approx(min(losses))


def test_saved_and_loaded(spark, tmp_path):
    df, *_ = table(spark, n=100, d=3)
    model = Pipeline(stages=[B.HistogramBoosting(maxIter=2, maxDepth=2)]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    p = lambda m: sorted((r["id"], r["probability"][1]) for r in m.transform(df).collect())
    assert p(model) == p(again) and len(again.stages[0].importance()) == 3


def test_nothing_to_learn(spark):
    same = spark.createDataFrame([([1.0, None], 1)] * 5 + [([1.0, None], 0)] * 5, "features array<double>, y int")
    model = B.HistogramBoosting(maxIter=20).fit(same)
    assert [r["probability"][1] for r in model.transform(same).collect()] == pytest.approx([0.5] * 10)
    with pytest.raises(ValueError):
        B.HistogramBoosting().fit(same.limit(0))


def test_leaves_are_bounded(spark):
    df, *_ = table(spark, n=300, d=5, seed=2)
    for t in B.HistogramBoosting(maxIter=2, maxDepth=5, maxLeaves=6, key="id").fit(df).learned():
        assert sum(f < 0 for f in t.feature) <= 6


def test_a_level_is_added_up_by_as_many_tasks_as_it_needs(spark, monkeypatch):
    df, *_ = table(spark, n=200, d=5)
    counts = []
    plain = B._level
    monkeypatch.setattr(B, "_level", lambda *a: counts.append((found := plain(*a)).getNumPartitions()) or found)
    fit = lambda: B.HistogramBoosting(maxIter=2, stepSize=0.3, maxDepth=2, key="id").fit(df).getOrDefault("trees")
    one = fit()
    assert set(counts) == {1}
    monkeypatch.setattr(B, "ADDED", 1)
    assert fit() == one and counts[-1] == 6
