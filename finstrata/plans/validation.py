"""Queries G8, N1-N4, N8-N32, D22, G14: folds, validation loops, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..constants import FEATURES
from ..operators import metrics as M
from ..operators import models as L
from ..operators import preprocess as Q
from ..operators import samples as S
from ..operators import validate as V
from ..operators.leave_out import leave_one_entity_out
from ..sources.landing import land
from .features import samples2
from .models import CLIP, table_of_samples
from .profiles import auc_sql, sample_features
from .registry import query
from .views import SQL, panel, scores_long, sql_pair, sql_uniform, table, vectors


@query("n1_group_folds")
def n1_folds(spark, sf):
    """Fold sizes of the greedy assignment (largest group to the lightest fold)."""
    s = samples2(spark, sf)
    f = V.group_folds(s, "entity", 4)
    return s.join(f, "entity").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("n_groups"))


@query("n1_grouped_cv")
def n1(spark, sf):
    oof = V.grouped_cv(table_of_samples(spark, sf), ["logistic", "random_forest"], FEATURES)
    return V.pooled_and_fold(oof, by=["model"])


def _left_out(spark, sf):
    """Every entity in turn is held out: one row per entity, metrics on its validation and test rows."""
    scored = L.materialize(leave_one_entity_out(table_of_samples(spark, sf), FEATURES))
    m = V.group_metrics(scored.where("not skipped"), ["entity"]).drop("n_test")
    heads = scored.groupBy("entity").agg(F.first("skipped").alias("skipped"), F.first("n_test").alias("n_test"))
    return heads.join(m, "entity", "left").withColumnRenamed("entity", "held_out")


@query("n2_leave_one_group_out")
def n2(spark, sf):
    return _left_out(spark, sf)


@query("n29_leave_one_group_out_auroc")
def n29(spark, sf):
    return _left_out(spark, sf).where("not skipped and single_class = 0").select("held_out", "auroc")


SQL["wf"] = (["f_split"], """SELECT k AS fold, (SELECT target_period_end FROM (SELECT target_period_end, row_number() OVER (ORDER BY target_period_end, sample_id) - 1 AS pos FROM f_split) WHERE pos = least(k * n // 5, n - 1)) AS cut,
  CASE WHEN k < 4 THEN (SELECT target_period_end FROM (SELECT target_period_end, row_number() OVER (ORDER BY target_period_end, sample_id) - 1 AS pos FROM f_split) WHERE pos = least((k + 1) * n // 5, n - 1)) END AS stop FROM (SELECT unnest([1, 2, 3, 4]) AS k), (SELECT count(*) AS n FROM f_split)""")
SQL["wfm"] = (["wf"], """SELECT * FROM (SELECT sample_id, target_period_end, fold, cut, CASE WHEN target_period_end < cut AND label_available_on <= cut - INTERVAL 90 DAY THEN 'train' WHEN target_period_end >= cut AND (stop IS NULL OR target_period_end < stop) THEN 'test' END AS role FROM f_split, wf) WHERE role IS NOT NULL""")


@query("n3_walk_forward_folds", "SELECT CAST(fold AS BIGINT) AS fold, cut, count(CASE WHEN role = 'train' THEN 1 END) AS n_train, count(CASE WHEN role = 'test' THEN 1 END) AS n_test, min(CASE WHEN role = 'test' THEN target_period_end END) AS test_from, max(CASE WHEN role = 'test' THEN target_period_end END) AS test_to, CAST(count(CASE WHEN role = 'train' THEN 1 END) < 60 OR count(CASE WHEN role = 'test' THEN 1 END) = 0 AS BIGINT) AS skipped FROM wfm GROUP BY fold, cut", ["wfm"])
def n3(spark, sf):
    return V.walk_forward_summary(V.walk_forward(samples2(spark, sf)))


@query("g8_fold_membership", "SELECT sample_id, CAST(fold AS BIGINT) AS fold, role FROM wfm", ["wfm"])
def g8(spark, sf):
    return V.walk_forward(samples2(spark, sf)).select("sample_id", "fold", "role")


@query("n4_walk_forward_metrics")
def n4(spark, sf):
    t = table_of_samples(spark, sf).withColumn("label_available_on", F.date_add("target_period_end", 40))
    return V.summarize(V.walk_forward_metrics(t, ["logistic"], FEATURES))


@query("n8_cross_group_selection_metric")
def n8(spark, sf):
    oof = V.grouped_cv(table_of_samples(spark, sf), ["logistic"], FEATURES)
    return V.pooled_and_fold(oof, by=["model"]).where("scope = 'pooled'")


def _pos(salt, seed=42):
    return f"SELECT *, row_number() OVER (PARTITION BY y ORDER BY {sql_uniform(sql_pair(str(salt), 'row_id'), seed)}, row_id) AS pos, count(*) OVER (PARTITION BY y) AS nc FROM f_scores"


@query("n10_stratified_folds", f"SELECT row_id, (pos - 1) % 5 AS fold FROM ({_pos(1)})", ["f_scores"])
def n10(spark, sf):
    from .views import scores
    return V.stratified_folds(scores(spark, sf), 5, key="row_id").select("row_id", "fold")


@query("n11_stratified_holdout", f"SELECT row_id, CASE WHEN pos <= round(nc * 8e-1) THEN 'train' ELSE 'test' END AS part FROM ({_pos(2)})", ["f_scores"])
def n11(spark, sf):
    from .views import scores
    return V.stratified_holdout(scores(spark, sf), 0.2, key="row_id").select("row_id", "part")


@query("n12_strategy_cv")
def n12(spark, sf):
    return V.evaluate_techniques(vectors(spark, sf), ["baseline", "class_weight"], k=2, maxIter=20)


@query("n13_untouched_check", "SELECT CAST(1 AS BIGINT) AS same, count(*) AS n_rows FROM f_split WHERE split = 'validation'", ["f_split"])
def n13(spark, sf):
    s = samples2(spark, sf)
    cols = ["sample_id", "is_distressed", "as_of"]
    return V.untouched(s.where("split = 'validation'"), s.orderBy("sample_id").where("split = 'validation'"), cols)


@query("n14_refit_and_score_thresholds")
def n14(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))
    m = L.fit_model("logistic", t.where(F.col("split").isin("train", "validation")), FEATURES)
    return M.metrics_at(L.score(m, t.where("split = 'test'"), ["y"]), [0.3, 0.5, 0.7])


@query("n15_holdout_method")
def n15(spark, sf):
    v = L.materialize(V.stratified_holdout(vectors(spark, sf)))
    return V.evaluate_on_holdout(v.where("part = 'train'"), v.where("part = 'test'"), "random_under", lambda oof: 0.5, k=2, maxIter=20).drop("fit_seconds", "score_seconds")


@query("n16_method_cv")
def n16(spark, sf):
    v = L.materialize(L.vectorized(V.stratified_folds(vectors(spark, sf), 2)))
    oof = V.out_of_fold(v, lambda t: L.fit_technique("random_over", t, maxIter=20), ["id"])
    from ..sources.writers import result_rows
    return result_rows(M.rank_metrics(oof, ["fold"]).withColumn("method", F.lit("random_over")), ["method"], ["auroc", "average_precision"])


@query("n17_technique_evaluation")
def n17(spark, sf):
    return V.evaluate_techniques(vectors(spark, sf), ["random_under", "smote"], k=2, maxIter=20)


@query("n17_technique_on_holdout")
def n17b(spark, sf):
    """Two techniques with tuned thresholds, timings, one scoring of the holdout and the leak checks."""
    v = L.materialize(V.stratified_holdout(vectors(spark, sf)))
    train, test = v.where("part = 'train'"), v.where("part = 'test'")
    one, two = (V.evaluate_on_holdout(train, test, key, V.best_f1_threshold, k=2, maxIter=20) for key in ("random_under", "class_weight"))
    return one.unionByName(two)


@query("n18_tuned_thresholds_on_oof")
def n18(spark, sf):
    v = L.materialize(L.vectorized(V.stratified_folds(vectors(spark, sf), 2)))
    oof = L.materialize(V.out_of_fold(v, lambda t: L.fit_technique("class_weight", t, maxIter=20), ["id"]))
    return M.threshold_modes(M.with_edges(M.ladder(oof), [0.5, 1.0]), M.counts_at(oof, [0.5]))


@query("n19_group_fold_technique")
def n19(spark, sf):
    t = table_of_samples(spark, sf)
    t = L.materialize(t.join(V.group_folds(t, "entity"), "entity").select("id", "fold", "y", *FEATURES))
    oof = V.out_of_fold(t, lambda tr: L.fit_panel_technique("random_under", tr, FEATURES, maxIter=20), ["id"])
    return V.pooled_and_fold(oof)


@query("n20_preprocessing_variants")
def n20(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))

    def variant(v):
        m = L.fit_model("logistic", t.where("split = 'train'"), FEATURES, winsorize=v[0], scaler=v[1])
        return L.materialize(L.score(m, t.where("split = 'validation'"), ["y"])).withColumn("variant", F.lit("|".join(v)))

    parts = V.at_once(variant, [(w, scaler) for w in ("none", "iqr") for scaler in ("standard", "robust")])
    return M.rank_metrics(reduce(DataFrame.unionByName, parts), ["variant"])


@query("n21_variant_enumeration", "SELECT m AS method, feature, round(CASE WHEN m = 'none' THEN 0e0 ELSE sum(CASE WHEN v < CASE WHEN m = 'iqr' THEN q1 - 15e-1*(q3-q1) ELSE p1 END OR v > CASE WHEN m = 'iqr' THEN q3 + 15e-1*(q3-q1) ELSE p99 END THEN 1e0 ELSE 0e0 END) / count(v) END, 6) AS clip_share FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS v, quantile_cont({c}, 25e-2) OVER () AS q1, quantile_cont({c}, 75e-2) OVER () AS q3, quantile_cont({c}, 1e-2) OVER () AS p1, quantile_cont({c}, 99e-2) OVER () AS p99 FROM f_sf" for c in CLIP) + "), (SELECT unnest(['none', 'iqr', 'p1p99']) AS m) WHERE v IS NOT NULL GROUP BY m, feature", ["f_sf"])
def n21(spark, sf):
    t = land(sample_features(spark, sf).select(*CLIP), "clipped-columns")  # every method reads it twice
    out = None
    for m in Q.WINSOR_METHODS:
        one = Q.Winsorizer(inputCols=CLIP, method=m).fit(t).clip_share(t).withColumn("method", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


@query("n22_grid_search")
def n22(spark, sf):
    return V.grid_search(table_of_samples(spark, sf), "logistic", FEATURES, {"regParam": [0.01, 0.5]})


@query("n25_random_search")
def n25(spark, sf):
    return V.random_search(table_of_samples(spark, sf), "logistic", FEATURES, n_trials=3, space={"regParam": ("loguniform", 0.001, 1.0)})


@query("n24_trial_dedup", """SELECT count(*) AS n_trials, count(DISTINCT concat(round(p_a, 1), '|', grp % 3)) AS n_distinct FROM f_scores""", ["f_scores"])
def n24(spark, sf):
    from .views import scores
    t = scores(spark, sf).select(F.to_json(F.struct(F.round("p_a", 1).alias("rate"), (F.col("grp") % 3).alias("depth"))).alias("params"))
    return t.agg(F.count(F.lit(1)).alias("n_trials"), F.countDistinct("params").alias("n_distinct"))


@query("n26_search_vs_grid")
def n26(spark, sf):
    t = L.materialize(table_of_samples(spark, sf))
    g = V.grid_search(t, "logistic", FEATURES, {"regParam": [0.1]})
    r = V.random_search(t, "logistic", FEATURES, n_trials=1, space={"regParam": ("loguniform", 0.001, 1.0)})
    return V.compare_search(r, g)


@query("n27_nested_cv")
def n27(spark, sf):
    return M.rank_metrics(V.nested_cv(table_of_samples(spark, sf), "logistic", FEATURES, {"regParam": [0.01, 0.5]}), ["fold"])


@query("n28_pooled_and_fold", f"SELECT system, concat('fold_', fold) AS scope, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision FROM ({auc_sql('(SELECT system, grp % 5 AS fold, y, p FROM f_long)', 'system', 'fold')}) UNION ALL SELECT system, 'pooled', round(auroc, 6), round(ap, 6) FROM ({auc_sql('f_long', 'system')})", ["f_long"])
def n28(spark, sf):
    s = scores_long(spark, sf).withColumn("fold", F.col("grp") % 5)
    return V.pooled_and_fold(s, by=["system"])


@query("n30_ablation")
def n30(spark, sf):
    t = table_of_samples(spark, sf)
    return V.ablation(t.where("split = 'train'"), t.where("split = 'test'"), V.ablation_variants(FEATURES), "logistic")


@query("n31_one_ablation_variant")
def n31(spark, sf):
    """Only samples with enough history, without the trajectory features."""
    t = S.filter_by_history(table_of_samples(spark, sf), 5)
    cols = V.ablation_variants(FEATURES)["minus_path"]
    return V.ablation(t.where("split = 'train'"), t.where("split = 'test'"), {"minus_path_long_history": cols}, "logistic")


@query("n9_cross_group_ap")
def n9(spark, sf):
    t = table_of_samples(spark, sf)
    t = L.materialize(t.join(V.group_folds(t, "entity"), "entity"))
    return spark.createDataFrame([tuple(V.cross_group_ap(t, "logistic", {"regParam": 0.1}, FEATURES).values())],
                                 "cv_average_precision double, cv_ap_std double, cv_auroc double, n_folds long")


@query("n23_random_parameters")
def n23(spark, sf):
    """Draws from the search space next to the size of the table they would be tried on."""
    import random
    rng = random.Random(42)
    rows = [(i, V.Trial.draw(V.SEARCH_SPACES["random_forest"], rng).name) for i in range(10)]
    n = samples2(spark, sf).where("split = 'train'").groupBy("split").agg(F.count(F.lit(1)).alias("n_train"), F.avg("is_distressed").alias("rate"))
    return n.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(k).alias("params")) for i, k in rows]))).select("t.trial", "t.params", "n_train", "rate")


@query("n32_learning_curve")
def n32(spark, sf):
    return V.learning_curve(table_of_samples(spark, sf), "logistic", FEATURES)


@query("n37_systems_table", "SELECT system, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM f_long WHERE row_id IN (SELECT row_id FROM f_long GROUP BY row_id HAVING count(DISTINCT system) = 2) GROUP BY system", ["f_long"])
def n37(spark, sf):
    s = scores_long(spark, sf)
    common = s.groupBy("row_id").agg(F.countDistinct("system").alias("k")).where("k = 2").select("row_id")
    return s.join(common, "row_id", "left_semi").groupBy("system").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"))


@query("d22_models_under_rules")
def d22(spark, sf):
    from ..operators.features import feature_table
    from ..functions.panel import entity_rows
    out = None
    for rule in ("stress_signals", "altman_z"):
        p = S.label_by_rule(rule, panel(spark, sf), 2).withColumn("is_distressed", F.lead("label").over(entity_rows())).withColumn("target_period_end", F.lead("period_end").over(entity_rows()))
        t = S.time_split(feature_table(p, ["is_distressed", "target_period_end"]).where("target_period_end is not null")).withColumn("y", F.col("is_distressed"))
        t = L.materialize(t)
        m = L.fit_model("logistic", t.where("split = 'train'"), FEATURES)
        one = L.score(m, t.where("split = 'test'"), ["y"]).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return M.rank_metrics(out, ["rule"])
