"""Samplers, neighbours, models and explanations against brute force or known values."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from finstrata.operators import explain as O
from finstrata.operators import neighbours
from finstrata.operators import models as L
from finstrata.operators import preprocess as Q
from finstrata.operators import resample as R
from finstrata.operators import validate as V
from finstrata.operators.inference import paired_bootstrap
from finstrata.operators.metrics import ladder, rank_metrics
from finstrata.operators.neighbours import nearest


def cloud(spark, n=600, d=3, seed=0, hot=True):
    """A third of the rows sit in one tight cluster; a tenth are positive."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 4
    if hot:
        x[: n // 3] = rng.normal(size=(n // 3, d)) * 0.05 + 9
    y = (np.arange(n) % 10 == 0).astype(int)
    x[y == 1] += 1.5
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(n)], "id long, x array<double>, y int")
    return df, x, y


@pytest.mark.parametrize("block,pivots", [(4096, None), (50, 9), (37, 25)])
def test_nearest_equals_brute_force(spark, block, pivots):
    df, x, _ = cloud(spark, 400)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    got = np.full((len(x), 4), np.nan)
    for r in nearest(df, df, 4, block=block, pivots=pivots).collect():
        got[r["id"], r["rank"] - 1] = r["dist"]
        assert r["dist"] == pytest.approx(d[r["id"], r["nid"]])
    assert np.allclose(got, want)


def test_chunks_do_not_change_the_neighbours(spark):
    df, _, _ = cloud(spark, 300)
    rows = lambda block: {(r["id"], r["rank"]): r["nid"] for r in nearest(df, df, 3, block=block, pivots=8).collect()}
    assert rows(7) == rows(4096)


def test_many_cells_at_default_settings(spark):
    """More rows than one chunk holds, a third of them at one place, queries that are not in the base: ids and ranks as in a full search."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5200, 3))
    x[:1700] = [4.0, 4.0, 4.0]
    asked = np.vstack([rng.normal(size=(40, 3)) * 2, x[1690:1710]])
    table = lambda points, first: spark.createDataFrame([(first + i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, x array<double>")
    got = {(r["id"], r["rank"]): r["nid"] for r in nearest(table(asked, 10_000), table(x, 0), 5).collect()}
    d = neighbours._distances(asked, x)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert got == {(10_000 + i, j + 1): int(want[i, j]) for i in range(len(asked)) for j in range(5)}


def test_no_base_or_no_query(spark):
    df, _, _ = cloud(spark, 50)
    assert nearest(df, df.where("id < 0"), 3).count() == 0
    assert nearest(df.where("id < 0"), df, 3).count() == 0


def test_pivots_group_every_point(spark):
    points = np.vstack([np.zeros((30, 2)), np.random.default_rng(1).normal(size=(70, 2))])
    p = neighbours.Pivots.of(points)
    cell, near, far = p.home(points)
    group = np.searchsorted(p.first, cell, "right") - 1
    assert len(p.pivots) == 100 and (np.diff(p.first) > 0).all()
    assert np.allclose(near, np.linalg.norm(points - p.pivots[cell], axis=1)) and np.allclose(far, np.linalg.norm(points - p.groups[group], axis=1))


def test_more_neighbours_than_rows(spark):
    df, _, _ = cloud(spark, 6, hot=False)
    assert nearest(df, df, 10, block=2, pivots=3).count() == 6 * 5


@pytest.mark.parametrize("kind", ["random_over", "smote", "borderline_smote", "adasyn"])
def test_oversamplers_reach_the_ratio(spark, kind):
    df, _, y = cloud(spark)
    out = R.make_sampler(kind, ratio=0.5)(df)
    n = {r["y"]: r["n"] for r in out.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[0] == int((y == 0).sum()) and n[1] == round(0.5 * n[0])
    assert df.select("id").subtract(out.select("id")).count() == 0


def test_undersampler_is_exact_and_repeatable(spark):
    df, _, y = cloud(spark)
    a = sorted(r["id"] for r in R.random_under(0.5)(df).collect())
    b = sorted(r["id"] for r in R.random_under(0.5)(df.repartition(17)).collect())
    assert a == b and len(a) == int(y.sum()) * 3


def test_smote_points_lie_between_parents(spark):
    df, x, _ = cloud(spark)
    for r in R.smote_rows(df, 0.3).collect():
        want = x[r["base_id"]] + r["gap"] * (x[r["partner_id"]] - x[r["base_id"]])
        assert np.allclose(r["x"], want)


def test_quota_sums_to_request(spark):
    votes = spark.createDataFrame([(i, (i * 7) % 6, 5 - (i * 7) % 6) for i in range(40)], "id long, n_major int, n_minor int")
    assert R.adasyn_quota(votes, 97).agg(F.sum("quota")).first()[0] == 97


def test_winsorizer_learns_from_fit_rows_only(spark):
    train = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    m = Q.Winsorizer(inputCols=["v"], method="p1p99").fit(train)
    assert m.bounds() == [("v", 1.0, 99.0)]
    out = m.transform(spark.createDataFrame([(1e6,), (None,), (-5.0,)], "v double")).collect()
    assert [r["v"] for r in out] == [99.0, None, 1.0]


def test_stages_survive_save_and_load(spark, tmp_path):
    train = spark.createDataFrame([(float(i % 17), float(i % 5), i % 2) for i in range(200)], "a double, b double, y int")
    model = L.fit_model("logistic", train, ["a", "b"], winsorize="iqr", maxIter=10)
    L.save_model(model, str(tmp_path / "m"), ["a", "b"], 0.4)
    again, cols, threshold = L.load_model(spark, str(tmp_path / "m"))
    assert cols == ["a", "b"] and threshold == 0.4
    p = lambda m: [r["p"] for r in L.score(m, train, ["a"]).collect()]
    assert p(model) == pytest.approx(p(again))


def test_all_missing_column_is_filled(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, None)], "a double, b double")
    out = Q.MedianFill(inputCols=["a", "b"], outputCols=["a_f", "b_f"], exact=True).fit(df).transform(df).collect()
    assert [(r["a_f"], r["b_f"]) for r in out] == [(0.0, 1.0), (0.0, 3.0), (0.0, 2.0)]


def test_yeo_johnson_reduces_skew(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in rng.lognormal(size=800)], "v double")
    out = Q.PowerNormal(inputCols=["v"]).fit(df).transform(df).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.skewness("v").alias("k")).first()
    assert abs(out["m"]) < 1e-6 and abs(out["s"] - 1) < 1e-6 and abs(out["k"]) < 0.3


def test_focal_derivatives_match_finite_differences(spark):
    z = [-3.0, -0.7, 0.0, 0.4, 2.5]
    eps = 1e-4
    df = spark.createDataFrame([(float(y), v) for y in (0, 1) for v in z], "y double, z double")
    g, h = L.focal_terms(F.col("y"), F.col("z"), 2.0, 0.75)

    def loss(y, v):
        p = 1 / (1 + math.exp(-v))
        return -(0.75 * (1 - p) ** 2 * math.log(p)) if y else -(0.25 * p**2 * math.log(1 - p))

    for r in df.select("y", "z", g.alias("g"), h.alias("h")).collect():
        y, v = r["y"], r["z"]
        assert r["g"] == pytest.approx((loss(y, v + eps) - loss(y, v - eps)) / (2 * eps), abs=1e-6)
        want = (loss(y, v + eps) - 2 * loss(y, v) + loss(y, v - eps)) / eps**2
        assert r["h"] == pytest.approx(max(want, L.HESS_FLOOR), abs=1e-4)


def test_kernel_shap_equals_exact_for_a_linear_score(spark):
    rng = np.random.default_rng(5)
    w = np.array([0.5, -1.0, 2.0, 0.25])
    x = rng.normal(size=(20, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    bg = x[:6]
    lin = lambda d: d.withColumn("p", sum((F.get(F.col("x"), F.lit(i)) * float(c) for i, c in enumerate(w)), F.lit(0.3)))
    out = {r["id"]: r for r in O.kernel_shap(df, lin, bg, 60).collect()}
    want = w * (x - bg.mean(axis=0))
    for i in range(20):
        assert np.allclose(out[i]["phi"], want[i], atol=1e-8) and abs(out[i]["gap"]) < 1e-9


def test_rank_metrics_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    y = (rng.random(400) < 0.2).astype(int)
    p = np.round(rng.random(400) * 0.6 + 0.4 * y * rng.random(400), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double").withColumn("g", F.lit("x"))
    r = rank_metrics(df, ["g"]).first()
    pos, neg = p[y == 1], p[y == 0]
    assert r["auroc"] == pytest.approx(np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])))
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp, k = (y[p >= t] == 1).sum(), (p >= t).sum()
        ap += (tp / y.sum() - last) * tp / k
        last = tp / y.sum()
    assert r["average_precision"] == pytest.approx(ap)
    assert ladder(df, ["g"]).count() == len(set(p))


def test_swapping_systems_flips_the_sign(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, int(i % 3 == 0), float(rng.random()), float(rng.random())) for i in range(120)], "row_id long, y int, a double, b double")
    one = {r["metric"]: r["observed"] for r in paired_bootstrap(df, "a", "b", n_boot=20).collect()}
    two = {r["metric"]: r["observed"] for r in paired_bootstrap(df, "b", "a", n_boot=20).collect()}
    assert all(one[m] == pytest.approx(-two[m]) for m in one)


def test_evaluation_reports_errors_and_goes_on(spark):
    df, _, _ = cloud(spark, 120, hot=False)
    L.TECHNIQUES["broken"] = ("none", lambda t: 1 / 0)
    try:
        got = {r["technique"]: r["status"] for r in V.evaluate_techniques(df, ["broken", "random_under"], k=2, go_on=True, maxIter=5).collect()}
    finally:
        del L.TECHNIQUES["broken"]
    assert got.pop("broken").startswith("error: TypeError: ") and got == {"random_under": "ok"}


def test_bootstrap_sums_do_not_depend_on_blocks(spark, monkeypatch):
    from finstrata.operators import inference as N

    rng = np.random.default_rng(4)
    p = np.round(rng.random(400), 2)
    p[::3] = 0.37  # a third of the rows have one score
    df = spark.createDataFrame([(i, float(v), int(rng.random() < v)) for i, v in enumerate(p)], "row_id long, p double, y int").repartition(5)
    run = lambda: {r["draw"]: r.asDict() for r in N.bootstrap_sums(df, "row_id", F.lit("g"), 0.5, 12, 7).collect()}
    one = run()
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "FOLD", 5)
    two = run()
    weights = N.poisson_weights(np.arange(400), 12, 7)
    y = np.array([r["y"] for r in df.orderBy("row_id").collect()])
    for d in range(12):
        w1, w0 = weights[:, d] * y, weights[:, d] * (1 - y)
        auc = sum(w1[p == v].sum() * (w0[p < v].sum() + w0[p == v].sum() / 2) for v in np.unique(p))
        ap = sum(w1[p == v].sum() / w1.sum() * w1[p >= v].sum() / (w1[p >= v].sum() + w0[p >= v].sum()) for v in np.unique(p) if w1[p == v].sum())
        for got in (one[d], two[d]):
            assert got["auc"] == pytest.approx(auc) and got["ap"] == pytest.approx(ap)
            assert (got["tp"], got["fn"], got["fp"]) == (w1[p >= 0.5].sum(), w1[p < 0.5].sum(), w0[p >= 0.5].sum())


def test_copies_and_repeated_ids(spark):
    """Equal vectors under other ids, the same row twice, one id with two vectors: as a full search over all rows, ids equal to the query's left out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    rows = [(i, x[i % 20].tolist()) for i in range(60)] + [(100 + i, x[20 + i].tolist()) for i in range(40)]
    rows += [(100, x[20].tolist()), (101, x[22].tolist())]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = {(r["id"], r["rank"]): (r["nid"], r["dist"]) for r in nearest(df, df, 4, block=9, pivots=6).collect()}
    want = {}
    for i in {r[0] for r in rows}:
        cands = sorted((float(np.sqrt(((np.array(a[1]) - np.array(b[1])) ** 2).sum())), b[0]) for a in rows if a[0] == i for b in rows if b[0] != i)
        want |= {(i, r + 1): (n, pytest.approx(d)) for r, (d, n) in enumerate(cands[:4])}
    assert got == want


@pytest.mark.parametrize("block", [8, 100])
def test_slices_hold_whole_cells_or_parts_of_one(block):
    sizes = np.random.default_rng(4).integers(0, 30, 50)
    first, parts, (owners, at) = neighbours._slices(sizes, block)
    assert (np.diff(at) >= 0).all() and set(np.diff(at)) <= {0, 1} and at[0] == 0
    for s in np.unique(at):
        own = owners[at == s]
        assert sizes[own].sum() <= block or (len(own) == 1 and parts[own[0]] > 1)


def test_rows_go_to_slices_not_to_cells(spark, monkeypatch):
    """In many dimensions nothing is ruled out: what is exchanged is one row a query and slice."""
    df, _, _ = cloud(spark, 500, d=12, hot=False)
    landed = {}
    plain = neighbours.land
    monkeypatch.setattr(neighbours, "land", lambda t, name: landed.setdefault(name, plain(t, name)))
    nearest(df, df, 3, block=250, pivots=40)
    assert landed["asked-further"].count() <= 500 * 2


def test_rounds_find_the_same_and_leave_nothing(spark, monkeypatch, tmp_path):
    """One slice a round or all at once; what a search lands on the way is deleted, except for the list of slices."""
    df, x, _ = cloud(spark, 400, d=6, hot=False)
    plain, names = neighbours.land, []
    monkeypatch.setattr(neighbours, "land", lambda t, name: names.append((name, got := plain(t, name))) or got)
    found = {}
    for copies in (1, 1000):
        monkeypatch.setattr(neighbours, "COPIES", copies)
        found[copies] = {(r["id"], r["rank"]): r["nid"] for r in nearest(df, df, 3, block=50, pivots=20).collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.diag(np.full(400, np.inf))
    want = {(i, r + 1): int(n) for i in range(400) for r, n in enumerate(np.argsort(far[i], kind="stable")[:3])}
    assert found[1] == found[1000] == want and sum(n == "found-rows" for n, _ in names) > 2
    left = {n for n, t in names if os.path.exists(t.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/"))}
    assert left == {"neighbours"} | ({"asked-further"} & left)


def test_a_chain_hands_on_landed_rows(spark, monkeypatch):
    df, _, _ = cloud(spark, 120, hot=False)
    names, plain = [], R.land
    monkeypatch.setattr(R, "land", lambda t, name: names.append(name) or plain(t, name))
    assert R.make_sampler("smote_enn", ratio=0.4)(df).where("id < 0").count() == round(0.4 * 108) - 12
    assert names == ["sampled-rows"]


def test_scores_that_repeat_are_folded_over_a_task(spark):
    from finstrata.operators import inference as N

    """2,000 rows with 4 scores, in Arrow batches of 100: no batch holds enough equal scores, the task does."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(0, 2000, 1, 1).selectExpr("'a' AS g", "(id % 4) / 4d AS p", "id AS k", "CAST(id % 3 = 0 AS INT) AS y")
        folded = N._fold(rows, 5, 1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(folded) == 4
    w = N.poisson_weights(np.arange(2000), 5, 1)
    for r in folded:
        mine = np.flatnonzero(np.arange(2000) % 4 == r["p"] * 4)
        assert r["w1"] == w[mine[mine % 3 == 0]].sum(axis=0).tolist() and r["w0"] == w[mine[mine % 3 != 0]].sum(axis=0).tolist()


def test_weights_of_a_row_serve_all_systems(spark, monkeypatch):
    """Three systems, three pairs: rows are weighed and folded once; a missing key or score is left out; each pair is as compared by itself."""
    from finstrata.operators import inference as N

    rng = np.random.default_rng(8)
    rows = [(i if i % 50 else None, int(rng.random() < 0.3), *(float(v) for v in np.round(rng.random(3), 1))) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double, c double").withColumn("c", F.when(F.col("c") < 0.9, F.col("c")))
    names, plain = [], N.land
    monkeypatch.setattr(N, "land", lambda t, name: names.append(name) or plain(t, name))
    got = {(r["a"], r["b"], r["metric"]): (r["ci_low"], r["ci_high"], r["boot_p"]) for r in N.compare_systems(df, ["a", "b", "c"], n_boot=15).collect()}
    assert names.count("folded-scores") == 1 and len(got) == 6
    weights = np.array([[0] * 15 if r[0] is None else N.poisson_weights(np.array([r[0]]), 15, N.SEED)[0] for r in rows])
    y = np.array([r[1] for r in rows])
    data = {"a": np.array([r[2] for r in rows]), "c": np.array([r[4] if r[4] < 0.9 else np.nan for r in rows])}

    def auroc(p, w):
        w1, w0 = w * y * ~np.isnan(p), w * (1 - y) * ~np.isnan(p)
        return sum(w1[p == v].sum() * (w0[p < v].sum() + w0[p == v].sum() / 2) for v in np.unique(p[~np.isnan(p)])) / (w1.sum() * w0.sum())

    delta = [auroc(data["a"], w) - auroc(data["c"], w) for w in weights.T]
    assert got["a", "c", "auroc"][:2] == (pytest.approx(np.percentile(delta, 2.5)), pytest.approx(np.percentile(delta, 97.5)))


def test_a_task_hands_on_folded_scores_and_rows(spark):
    """The first score repeats, the second one does not: a task folds the one and hands on the other; repeated keys count as often as they occur."""
    from finstrata.operators import inference as N

    rows = [(i % 400, int(i % 7 == 0), float(i % 2), i / 500.0) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double")
    got = {(r["s"], r["draw"]): r["auroc"] for r in N._system_draws(df, ["a", "b"], "row_id", 6, 3).collect()}
    w, y = N.poisson_weights(np.array([r[0] for r in rows]), 6, 3), np.array([r[1] for r in rows])
    for at, s in ((2, "a"), (3, "b")):
        p = np.array([r[at] for r in rows])
        for d in range(6):
            w1, w0 = w[:, d] * y, w[:, d] * (1 - y)
            want = sum(w1[p == v].sum() * (w0[p < v].sum() + w0[p == v].sum() / 2) for v in np.unique(p)) / (w1.sum() * w0.sum())
            assert got[s, d] == pytest.approx(want)


@pytest.mark.parametrize("high", [50, 2**31 + 5, 2**33, 2**60])
def test_weights_are_those_of_the_hash(high):
    from finstrata.operators import inference as N

    keys = np.append(np.random.default_rng(high % 97).integers(0, high, 40), [0, high, N.PRIME - 1, N.PRIME])
    pair = N._mix(np.arange(300, dtype=np.int64), 17)[None, :] * 40503 + keys[:, None]
    u = N._mix(pair, 7) / float(N.PRIME)
    assert (N.poisson_weights(keys, 300, 7) == sum((u >= b).astype(int) for b in N.poisson_bounds())).all()


def test_variants_read_landed_columns(spark, sf, monkeypatch):
    from __spark_entry__ import queries
    from finstrata.plans import validation as plans

    names, plain = [], plans.land
    monkeypatch.setattr(plans, "land", lambda t, name: names.append((name, t.columns)) or plain(t, name))
    assert queries()["n21_variant_enumeration"](spark, sf).count() == 12
    assert names == [("clipped-columns", plans.CLIP)]
