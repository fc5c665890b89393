"""Queries L*, B9, E30, J32-J34: preparation, baselines, model families, calibration, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FEATURES
from ..functions.panel import entity_rows
from ..functions.scalars import altman_probability, altman_z
from ..operators import features as X
from ..operators import metrics as M
from ..operators import models as L
from ..operators import preprocess as Q
from ..operators import profiles as P
from ..operators import samples as S
from ..operators.validate import stratified_holdout
from ..sources.landing import new_folder
from .profiles import auc_sql, sample_features
from .registry import query
from .views import SQL, panel, scores_long, vectors

CLIP = ["current_ratio_latest", "net_margin_latest", "receivables_to_sales_latest", "net_income_yoy_growth"]


def table_of_samples(spark, sf):
    """(id, entity, split, dates, y, 47 features) of every sample."""
    t = sample_features(spark, sf, ["available_on"])
    return t.withColumn("y", F.col("is_distressed").cast("int")).withColumn("id", F.col("entity") * 1_000_000 + F.col("n_history"))


def _bounds(c, kind):
    if kind == "iqr":
        a, b = f"quantile_cont({c}, 25e-2)", f"quantile_cont({c}, 75e-2)"
        return f"{a} - 15e-1 * ({b} - {a})", f"{b} + 15e-1 * ({b} - {a})"
    return f"quantile_cont({c}, 1e-2)", f"quantile_cont({c}, 99e-2)"


def _fit_train(kind):
    return "WITH b AS (SELECT " + ", ".join(f"{_bounds(c, kind)[0]} AS lo{i}, {_bounds(c, kind)[1]} AS hi{i}" for i, c in enumerate(CLIP)) + " FROM f_sf WHERE split = 'train') "


@query("l1_winsorize_iqr", _fit_train("iqr") + "SELECT entity, period_end, " + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo{i}), hi{i}) END, 6) AS {c}" for i, c in enumerate(CLIP)) + " FROM f_sf, b", ["f_sf"])
def l1(spark, sf):
    t = sample_features(spark, sf)
    m = Q.Winsorizer(inputCols=CLIP, method="iqr").fit(t.where("split = 'train'"))
    return m.transform(t).select("entity", "period_end", *CLIP)


@query("l2_clip_share", _fit_train("p1p99") + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(sum(CASE WHEN {c} < lo{i} OR {c} > hi{i} THEN 1e0 WHEN {c} IS NOT NULL THEN 0e0 END) / count({c}), 6) AS clip_share FROM f_sf, b WHERE split = 'test'" for i, c in enumerate(CLIP)), ["f_sf"])
def l2(spark, sf):
    t = sample_features(spark, sf)
    return Q.Winsorizer(inputCols=CLIP, method="p1p99").fit(t.where("split = 'train'")).clip_share(t.where("split = 'test'"))


@query("l3_power_and_quantile_scalers")
def l3(spark, sf):
    t = sample_features(spark, sf)
    train = t.where("split = 'train'")
    stats = lambda d, k: d.unpivot([], CLIP, "feature", "value").groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.skewness("value").alias("skew")).withColumn("scaler", F.lit(k))
    a = Q.PowerNormal(inputCols=CLIP).fit(train).transform(train)
    b = Q.QuantileNormal(inputCols=CLIP).fit(train).transform(train)
    return stats(a, "power").unionByName(stats(b, "quantile"))


@query("l3_standard_and_robust", "SELECT entity, period_end, round((x - m) / s, 5) AS standard, round((x - med) / (q3 - q1), 5) AS robust FROM (SELECT entity, period_end, revenue_per_asset_latest AS x FROM f_sf), (SELECT avg(revenue_per_asset_latest) AS m, stddev_samp(revenue_per_asset_latest) AS s, quantile_cont(revenue_per_asset_latest, 5e-1) AS med, quantile_cont(revenue_per_asset_latest, 25e-2) AS q1, quantile_cont(revenue_per_asset_latest, 75e-2) AS q3 FROM f_sf WHERE split = 'train')", ["f_sf"], digits=5)
def l3b(spark, sf):
    from ..functions.ordered import quantile_columns
    t = sample_features(spark, sf).select("entity", "period_end", "split", F.col("revenue_per_asset_latest").alias("x"))
    train = t.where("split = 'train'")
    m = train.agg(F.struct(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).alias("b")).scalar()
    q = quantile_columns(train, "x", {"q1": 0.25, "med": 0.5, "q3": 0.75}).select(F.struct("q1", "med", "q3").alias("b")).scalar()
    t = t.withColumn("b", m).withColumn("q", q)
    return t.select("entity", "period_end", ((F.col("x") - F.col("b.m")) / F.col("b.s")).alias("standard"), ((F.col("x") - F.col("q.med")) / (F.col("q.q3") - F.col("q.q1"))).alias("robust"))


@query("l4_median_fill", "WITH b AS (SELECT " + ", ".join(f"quantile_cont({c}, 5e-1) AS m{i}" for i, c in enumerate(CLIP)) + " FROM f_sf WHERE split = 'train') SELECT entity, period_end, " + ", ".join(f"round(coalesce({c}, m{i}, 0), 6) AS {c}" for i, c in enumerate(CLIP)) + " FROM f_sf, b", ["f_sf"])
def l4(spark, sf):
    t = sample_features(spark, sf)
    m = Q.MedianFill(inputCols=CLIP, outputCols=[f"{c}__f" for c in CLIP], exact=True).fit(t.where("split = 'train'"))
    return m.transform(t).select("entity", "period_end", *[F.col(f"{c}__f").alias(c) for c in CLIP])


def _family(name):
    @query(f"l5_model_{name}")
    def run(spark, sf):
        t = L.materialize(table_of_samples(spark, sf))
        model = L.fit_model(name, t.where("split = 'train'"), FEATURES, winsorize="p1p99")
        s = L.materialize(L.score(model, t.where("split <> 'train'"), ["split", "y"]))  # the metrics read scores several times
        return M.rank_metrics(s, ["split"]).withColumn("model", F.lit(name))


for _n in L.HYPERPARAMS:
    _family(_n)


@query("b9_model_with_metadata")
def b9(spark, sf):
    """Fit, save with feature order and threshold, load, score with what was loaded."""
    t = L.materialize(table_of_samples(spark, sf))
    path = new_folder(spark, "model")
    L.save_model(L.fit_model("logistic", t.where("split = 'train'"), list(reversed(FEATURES))), path, list(reversed(FEATURES)), 0.5)
    model, order, threshold = L.load_model(spark, path)
    return M.rank_metrics(L.score(model, t, ["split", "y"]), ["split"]).withColumns({"n_features": F.lit(len(order)), "threshold": F.lit(threshold)})


@query("l6_positive_probability")
def l6(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))
    model = L.fit_model("logistic", t.where("split = 'train'"), FEATURES)
    return L.score(model, t.where("split = 'test'"), ["id", "y"])


@query("l7_most_frequent", "SELECT split, round(avg((SELECT CASE WHEN 2 * sum(is_distressed) > count(*) THEN 1 ELSE 0 END FROM f_split WHERE split = 'train')), 6) AS p, count(*) AS n FROM f_split GROUP BY split", ["f_split"])
def l7(spark, sf):
    s = S.time_split(S.rule_samples(panel(spark, sf), "stress_signals", 2)).withColumn("y", F.col("is_distressed"))
    return L.most_frequent(s.where("split = 'train'"), s).groupBy("split").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n"))


@query("l8_single_feature_logistic")
def l8(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))
    s = L.score(L.single_feature(t.where("split = 'train'"), "debt_to_assets_latest"), t.where("split <> 'train'"), ["split", "y"])
    return M.rank_metrics(s, ["split"])


SQL["f_zs"] = (["f_z", "f_split"], "SELECT s.*, z.z, coalesce(1 / (1 + exp((z.z - 11e-1) / 5e-1)), 5e-1) AS pz FROM f_split s JOIN f_z z USING (entity, period_end)")


@query("l9_altman_probability", "SELECT entity, period_end, round(coalesce(1 / (1 + exp((z - 11e-1) / 5e-1)), 5e-1), 6) AS p FROM f_z", ["f_z"])
def l9(spark, sf):
    return panel(spark, sf).select("entity", "period_end", altman_probability(altman_z()).alias("p"))


@query("l10_baseline_table", f"WITH b AS (SELECT split, 'altman' AS system, is_distressed AS y, pz AS p FROM f_zs WHERE split IN ('validation', 'test') UNION ALL SELECT split, 'entity_prior', is_distressed, coalesce(prior, 5e-1) FROM f_split LEFT JOIN f_prior USING (entity) WHERE split IN ('validation', 'test')) SELECT system, split, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision FROM ({auc_sql('b', 'system', 'split')})", ["f_zs", "f_prior"])
def l10(spark, sf):
    p = S.stress_label(panel(spark, sf), 2).withColumn("is_distressed", F.lead("label").over(entity_rows())).withColumn("pz", altman_probability(altman_z()))
    s = S.time_split(S.make_samples(p, ["is_distressed", "pz"]))
    later = s.where(F.col("split").isin("validation", "test"))
    a = later.select("split", F.lit("altman").alias("system"), F.col("is_distressed").alias("y"), F.col("pz").alias("p"))
    b = P.with_prior(later, P.entity_prior(s)).select("split", F.lit("entity_prior").alias("system"), F.col("is_distressed").alias("y"), F.col("prior").alias("p"))
    return M.rank_metrics(a.unionByName(b), ["system", "split"])


@query("l11_train_and_validation_gap")
def l11(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))
    model = L.fit_model("random_forest", t.where("split = 'train'"), FEATURES)
    s = L.score(model, t.where(F.col("split").isin("train", "validation")), ["split", "y"]).withColumn("model", F.lit("random_forest"))
    m = M.rank_metrics(s, ["model", "split"])
    return M.overfit_table(m.where("split = 'train'"), m.where("split = 'validation'"), ["auroc", "average_precision"])


@query("l12_train_all_select_best")
def l12(spark, sf):
    """All families, measured on validation; the winner is saved, loaded again and scores the test rows."""
    t = L.materialize(table_of_samples(spark, sf))
    path = new_folder(spark, "winner")
    table = L.train_all(t.where("split = 'train'"), t.where("split = 'validation'"), FEATURES, path)
    model, _, threshold = L.load_model(spark, path)
    test = M.evaluate(L.score(model, t.where("split = 'test'"), ["y"]), operating=threshold).select(F.lit(1).alias("kept"), F.col("auroc").alias("test_auroc"), F.col("average_precision").alias("test_average_precision"))
    return table.join(test, "kept", "left")


@query("l13_calibrated_linear_svm")
def l13(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))
    m = L.fit_linear_svm(t.where("split = 'train'"), FEATURES, balanced=True)
    return M.rank_metrics(L.score(m, t.where("split <> 'train'"), ["split", "y"]), ["split"])


@query("l14_boosted_reference")
def l14(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))
    m = L.fit_boosted_reference(t.where("split = 'train'"), FEATURES, weights="ratio")
    return M.evaluate(L.score(m, t.where("split = 'test'"), ["y"]))


@query("l14_boosted_reference_early_stopping")
def l14b(spark, sf):
    """The number of rounds is chosen on the validation rows."""
    t = L.materialize(table_of_samples(spark, sf))
    m = L.fit_boosted_reference(t.where("split = 'train'"), FEATURES, weights="ratio", held=t.where("split = 'validation'"))
    trees = m.stages[-1]
    return M.evaluate(L.score(m, t.where("split = 'test'"), ["y"])).withColumns({"rounds": F.lit(len(trees.learned())), "held_loss": F.lit(min(trees.getOrDefault("losses")))})


@query("l15_scale_pos_weight", "SELECT CAST(y AS BIGINT) AS y, round(CASE WHEN y = 1 THEN (t - n) / CAST(n AS DOUBLE) ELSE 1 END, 6) AS w FROM (SELECT is_distressed AS y, count(*) AS n, sum(count(*)) OVER () AS t FROM f_split WHERE split = 'train' GROUP BY 1)", ["f_split"])
def l15(spark, sf):
    s = S.time_split(S.rule_samples(panel(spark, sf), "stress_signals", 2)).withColumn("y", F.col("is_distressed"))
    return L.class_weights(s.where("split = 'train'"), "ratio")


@query("l16_balanced_weights", "SELECT CAST(y AS BIGINT) AS y, round(t / (2e0 * n), 6) AS w FROM (SELECT is_distressed AS y, count(*) AS n, sum(count(*)) OVER () AS t FROM f_split WHERE split = 'train' GROUP BY 1)", ["f_split"])
def l16(spark, sf):
    s = S.time_split(S.rule_samples(panel(spark, sf), "stress_signals", 2)).withColumn("y", F.col("is_distressed"))
    return L.class_weights(s.where("split = 'train'"), "balanced")


@query("l17_isotonic_calibration")
def l17(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))
    m = L.fit_isotonic("logistic", t.where("split = 'train'"), FEATURES)
    s = L.score(m, t.where("split = 'test'"), ["y"]).withColumn("split", F.lit("test"))
    return M.rank_metrics(s, ["split"]).join(M.brier(s, ["split"]), "split")


def _focal_sql(own, other):
    inner = f"(2e0 * {own} * ln({own}) + {own} - 1)"
    return f"pow({other}, 2) * {inner}", f"{own} * {other} * (pow({other}, 2) * (2e0 * ln({own}) + 3) - 2e0 * {other} * {inner})"


_G1, _H1 = _focal_sql("q", "(1 - q)")
_G0, _H0 = _focal_sql("(1 - q)", "q")


@query("l18_focal_gradient", f"SELECT row_id, round(CASE WHEN y = 1 THEN 75e-2 * {_G1} ELSE 0e0 - 25e-2 * {_G0} END, 6) AS g, round(greatest(CASE WHEN y = 1 THEN 75e-2 * {_H1} ELSE 25e-2 * {_H0} END, 1e-6), 6) AS h FROM (SELECT row_id, y, least(greatest(1 / (1 + exp(-(4e0 * p_b - 2))), 1e-7), 1 - 1e-7) AS q FROM f_scores)", ["f_scores"])
def l18(spark, sf):
    from .views import scores
    g, h = L.focal_terms(F.col("y").cast("double"), 4.0 * F.col("p_b") - 2.0)
    return scores(spark, sf).select("row_id", g.alias("g"), h.alias("h"))


@query("l19_focal_loss", "SELECT system, round(avg(0e0 - CASE WHEN y = 1 THEN 75e-2 * pow(1 - q, 2) * ln(q) ELSE 25e-2 * pow(q, 2) * ln(1 - q) END), 6) AS loss FROM (SELECT system, y, least(greatest(p, 1e-7), 1 - 1e-7) AS q FROM f_long) GROUP BY system", ["f_long"])
def l19(spark, sf):
    return scores_long(spark, sf).groupBy("system").agg(F.avg(L.focal_loss(F.col("y").cast("double"), F.col("p"))).alias("loss"))


def _vector_model(name, fit):
    @query(name)
    def run(spark, sf):
        v = L.materialize(L.vectorized(stratified_holdout(vectors(spark, sf))))
        s = L.score(fit(v.where("part = 'train'").drop("part")), v.where("part = 'test'"), ["part", "y"])
        return M.rank_metrics(s, ["part"])


_vector_model("l20_focal_boosting", lambda t: L.fit_focal_boosting(t, maxIter=100))
_vector_model("l21_rusboost", lambda t: L.fit_rusboost(t, rounds=4))
_vector_model("l22_rusboost_technique", lambda t: L.fit_technique("rusboost", t, rounds=5))
_vector_model("l23_balanced_forest", lambda t: L.fit_balanced_bags(t, "balanced_forest", 2, numTrees=5))
_vector_model("l24_easy_ensemble", lambda t: L.fit_balanced_bags(t, "easy_ensemble", 2, maxIter=4))
_vector_model("l25_strategy_cost_sensitive", lambda t: L.fit_technique(L.STRATEGIES["cost_sensitive"], t, maxIter=20))
_vector_model("l25_strategy_calibrated", lambda t: L.fit_technique(L.STRATEGIES["calibrated"], t, maxIter=20))
_vector_model("l26_technique_smote", lambda t: L.fit_technique("smote", t, maxIter=20))
_vector_model("l27_technique_random_under", lambda t: L.fit_technique("random_under", t, maxIter=20))
_vector_model("l28_balanced_bagging", lambda t: L.fit_technique("balanced_bagging", t, bags=5))


@query("l29_panel_technique_smote_enn")
def l29(spark, sf):
    """Missing values take training medians, then the technique resamples and fits on the panel's samples."""
    t = L.materialize(table_of_samples(spark, sf))
    m = L.fit_panel_technique("smote_enn", t.where("split = 'train'"), FEATURES, maxIter=20)
    return M.rank_metrics(L.score(m, t.where("split <> 'train'"), ["split", "y"]), ["split"])


_vector_model("m9_sampler_inside_model", lambda t: L.SampledEstimator(L.make_sampler("random_under", ratio=0.5), L._gbt(maxIter=5)).fit(t))
_vector_model("m13_smote_with_weights", lambda t: L.fit_technique("smote_weights", t, maxIter=20))


@query("e30_aligned_vector", "SELECT entity, period_end, round(gross_margin_latest, 6) AS v0, round(revenue_cv, 6) AS v1, CAST(47 AS BIGINT) AS n FROM f_feat WHERE gross_margin_latest IS NOT NULL AND revenue_cv IS NOT NULL", ["f_feat"])
def e30(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    t = X.feature_table(panel(spark, sf)).where("gross_margin_latest is not null and revenue_cv is not null")
    v = VectorAssembler(inputCols=FEATURES, outputCol="v", handleInvalid="keep").transform(t).select("entity", "period_end", vector_to_array("v").alias("a"))
    return v.select("entity", "period_end", F.get("a", F.lit(FEATURES.index("gross_margin_latest"))).alias("v0"), F.get("a", F.lit(FEATURES.index("revenue_cv"))).alias("v1"), F.size("a").alias("n"))


@query("j32_one_shot_test")
def j32(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))
    model = L.fit_model("random_forest", t.where("split = 'train'"), FEATURES)
    val = L.score(model, t.where("split = 'validation'"), ["y"])
    best = M.best_f1(M.ladder(val)).select("threshold").scalar()
    test = L.score(model, t.where("split = 'test'"), ["id", "entity", "y"]).withColumn("threshold", F.coalesce(best, F.lit(0.5)))
    return test.withColumn("predicted", (F.col("p") >= F.col("threshold")).cast("int")).where("predicted <> y")


@query("j33_operating_threshold", "SELECT coalesce((SELECT threshold FROM (SELECT NULL::DOUBLE AS threshold)), (SELECT round(min(p_a), 6) FROM f_scores WHERE y = 1), 5e-1) AS threshold", ["f_scores"])
def j33(spark, sf):
    s = scores_long(spark, sf).where("system = 'p_a' and y = 1")
    summary = s.agg(F.min("p").alias("threshold"))
    artifact = summary.select(F.lit(None).cast("double").alias("threshold")).scalar()
    return summary.select(F.coalesce(artifact, F.col("threshold"), F.lit(0.5)).alias("threshold"))


@query("j34_score_batch")
def j34(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))
    model = L.fit_model("logistic", t.where("split = 'train'"), FEATURES)
    s = L.score(model, t, ["id", "entity", "split", "y"])
    return s.withColumn("decision", (F.col("p") >= 0.5).cast("int")).withColumn("correct", (F.col("decision") == F.col("y")).cast("int"))
