"""Queries J*: evaluation of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import EVAL_THRESHOLDS, LAB_COST_FN, LAB_COST_FP
from ..operators import metrics as M
from .profiles import auc_sql
from .registry import query
from .views import SQL, scores_long

SQL["f_dist"] = (["f_long"], "SELECT system, p, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM f_long GROUP BY system, p")
SQL["f_lad"] = (["f_dist"], """SELECT system, p, n1, n0, sum(n1) OVER (PARTITION BY system ORDER BY p DESC) AS tp, sum(n0) OVER (PARTITION BY system ORDER BY p DESC) AS fp,
  sum(n1) OVER (PARTITION BY system) AS pos, sum(n0) OVER (PARTITION BY system) AS neg FROM f_dist""")
SQL["f_thr"] = (["f_long"], "SELECT system, t AS threshold, " + ", ".join(
    f"CAST(sum(CASE WHEN (p >= t) = {h} AND y = {y} THEN 1 ELSE 0 END) AS DOUBLE) AS {n}" for n, h, y in (("tp", "true", 1), ("fp", "true", 0), ("fn", "false", 1), ("tn", "false", 0)))
    + " FROM f_long, (SELECT unnest([3e-1, 35e-2, 4e-1, 5e-1, 6e-1, 656e-3]) AS t) GROUP BY system, t")


def z(a, b):
    return f"coalesce(({a}) / nullif({b}, 0), 0)"


E = {
    "accuracy": "(tp + tn) / (tp + fp + fn + tn)", "precision": z("tp", "tp + fp"), "recall": z("tp", "tp + fn"), "f1": z("2*tp", "2*tp + fp + fn"),
    "macro_f1": f"({z('2*tp', '2*tp + fp + fn')} + {z('2*tn', '2*tn + fp + fn')}) / 2",
    "weighted_f1": f"((tp+fn)*{z('2*tp', '2*tp + fp + fn')} + (tn+fp)*{z('2*tn', '2*tn + fp + fn')}) / (tp + fp + fn + tn)",
    "specificity": "tn / nullif(tn + fp, 0)", "npv": "tn / nullif(tn + fn, 0)",
    "mcc": z("tp*tn - fp*fn", "sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))"), "expected_cost": "5*fn + fp",
    "macro_precision": f"({z('tp', 'tp + fp')} + {z('tn', 'tn + fn')}) / 2", "macro_recall": f"({z('tp', 'tp + fn')} + {z('tn', 'tn + fp')}) / 2",
    "weighted_precision": f"((tp+fn)*{z('tp', 'tp + fp')} + (tn+fp)*{z('tn', 'tn + fn')}) / (tp + fp + fn + tn)",
    "weighted_recall": f"((tp+fn)*{z('tp', 'tp + fn')} + (tn+fp)*{z('tn', 'tn + fp')}) / (tp + fp + fn + tn)",
    "fbeta": z("5*tp", "5*tp + 4*fn + fp"), "balanced_accuracy": f"({z('tp', 'tp + fn')} + {z('tn', 'tn + fp')}) / 2",
    "fpr": "fp / nullif(tn + fp, 0)", "majority_baseline_pct": "1e2 * greatest(tp + fn, tn + fp) / (tp + fp + fn + tn)",
}
I4 = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("tp", "fp", "fn", "tn"))


def exprs(names):
    return ", ".join(
        "CAST(tp + fp AS BIGINT) AS n_predicted" if n == "n_predicted"
        else "CAST((tp + tn) / (tp + fp + fn + tn) > greatest(tp + fn, tn + fp) / (tp + fp + fn + tn) AS BIGINT) AS better_than_majority" if n == "better_than_majority"
        else f"round({E[n]}, 6) AS {n}" for n in names)


@query("j1_metrics_at_threshold", f"SELECT system, threshold, {I4}, {exprs(M.MAIN_METRICS)} FROM f_thr", ["f_thr"])
def j1(spark, sf):
    return M.metrics_at(scores_long(spark, sf), EVAL_THRESHOLDS, ["system"])


@query("j2_lab_metrics", f"SELECT system, threshold, {I4}, {exprs(M.LAB_METRICS)} FROM f_thr WHERE threshold = 5e-1", ["f_thr"])
def j2(spark, sf):
    return M.metrics_at(scores_long(spark, sf), [0.5], ["system"], M.LAB_METRICS, mcc_mode="truth")


SQL["f_pa"] = (["f_scores"], "SELECT y, p_a AS p FROM f_scores")
SQL["f_grid"] = (["f_pa"], "SELECT DISTINCT q AS threshold FROM (SELECT unnest(quantile_cont(p, list_transform(range(0, 1001), lambda k: k / 1e3))) AS q FROM f_pa UNION ALL SELECT unnest([0e0, 5e-1, 1e0]))")
SQL["f_scan"] = (["f_pa", "f_grid"], "SELECT threshold, CAST(count(CASE WHEN y = 1 THEN 1 END) AS DOUBLE) AS tp, CAST(count(CASE WHEN y = 0 THEN 1 END) AS DOUBLE) AS fp, (SELECT sum(y) FROM f_pa) - count(CASE WHEN y = 1 THEN 1 END) AS fn, (SELECT sum(1 - y) FROM f_pa) - count(CASE WHEN y = 0 THEN 1 END) AS tn FROM f_grid LEFT JOIN f_pa ON p >= threshold GROUP BY threshold")


def one_system(spark, sf):
    return scores_long(spark, sf).where("system = 'p_a'").select("y", "p")


@query("j3_scan_counts", "SELECT round(threshold, 6) AS p, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM f_scan", ["f_scan"])
def j3(spark, sf):
    s = one_system(spark, sf)
    return M.scan_counts(s, M.candidate_grid(s))


_PT = f"round(p, 6) AS threshold, round({E['precision']}, 6) AS precision, round({E['recall']}, 6) AS recall, round({E['f1']}, 6) AS f1"
_LADX = "(SELECT *, pos - tp AS fn, neg - fp AS tn FROM f_lad)"


@query("j4_pr_curve", f"SELECT system, {_PT} FROM {_LADX}", ["f_lad"])
def j4(spark, sf):
    return M.pr_points(M.ladder(scores_long(spark, sf), ["system"]), ["system"])


@query("j5_average_precision", f"SELECT system, round(ap, 6) AS average_precision, n AS n_points FROM ({auc_sql('f_long', 'system')}) JOIN (SELECT system, count(*) AS n FROM f_dist GROUP BY system) USING (system)", ["f_dist"])
def j5(spark, sf):
    lad = M.ladder(scores_long(spark, sf), ["system"])
    return lad.groupBy("system").agg(M.ap_agg().alias("average_precision"), F.count(F.lit(1)).alias("n_points"))


def _best(src, by, order, mode, extra=""):
    return f"SELECT {by} '{mode}' AS mode, {_PT}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn{extra} FROM (SELECT *, row_number() OVER (PARTITION BY {by or '1,'} 1 ORDER BY {order}) AS k FROM {src}) WHERE k = 1"


@query("j6_best_f1_point", _best(_LADX, "system,", f"{E['f1']} DESC, p", "best_f1"), ["f_lad"])
def j6(spark, sf):
    return M.best_f1(M.ladder(scores_long(spark, sf), ["system"]), ["system"])


SQL["f_edge"] = (["f_lad"], """SELECT system, p, tp, fp, pos - tp AS fn, neg - fp AS tn FROM f_lad UNION ALL
  SELECT system, e, sum(CASE WHEN p >= e THEN n1 ELSE 0 END), sum(CASE WHEN p >= e THEN n0 ELSE 0 END), sum(CASE WHEN p < e THEN n1 ELSE 0 END), sum(CASE WHEN p < e THEN n0 ELSE 0 END) FROM f_lad, (SELECT unnest([0e0, 1e0]) AS e) GROUP BY system, e""")


@query("j7_cost_optimal", _best("f_edge", "system,", "5*fn + fp, p", "best_cost", ", round(5*fn + fp, 6) AS expected_cost"), ["f_edge"])
def j7(spark, sf):
    lad = M.ladder(scores_long(spark, sf), ["system"])
    return M.best_cost(M.with_edges(lad, [0.0, 1.0], ["system"]), ["system"])


@query("j8_candidate_grid", "SELECT round(threshold, 6) AS threshold FROM f_grid", ["f_grid"])
def j8(spark, sf):
    return M.candidate_grid(one_system(spark, sf))


_SC = "(SELECT threshold AS p, tp, fp, fn, tn FROM f_scan)"


@query("j9_best_f1_on_grid", _best(_SC, "", f"{E['f1']} DESC, p", "best_f1"), ["f_scan"])
def j9(spark, sf):
    s = one_system(spark, sf)
    return M.best_f1(M.scan_counts(s, M.candidate_grid(s)))


@query("j10_best_cost_on_grid", _best(_SC, "", "10*fn + fp, p", "best_cost", ", round(10*fn + fp, 6) AS expected_cost"), ["f_scan"])
def j10(spark, sf):
    s = one_system(spark, sf)
    return M.best_cost(M.scan_counts(s, M.candidate_grid(s)), cost_fn=LAB_COST_FN, cost_fp=LAB_COST_FP)


def _minp(t):
    ok = f"CAST({E['precision']} >= {t} AS BIGINT)"
    return f"{ok} DESC, CASE WHEN {ok} = 1 THEN {E['recall']} ELSE {E['precision']} END DESC, p", f", {ok} AS target_met"


@query("j11_min_precision", f"SELECT 6 AS target, * FROM ({_best(_SC, '', _minp('6e-1')[0], 'min_precision', _minp('6e-1')[1])}) UNION ALL SELECT 20, * FROM ({_best(_SC, '', _minp('2e0')[0], 'min_precision', _minp('2e0')[1])})".replace("SELECT 6 AS", "SELECT CAST(6 AS BIGINT) AS"), ["f_scan"])
def j11(spark, sf):
    s = one_system(spark, sf)
    c = M.scan_counts(s, M.candidate_grid(s))
    return M.min_precision(c, (), 0.6).withColumn("target", F.lit(6)).unionByName(M.min_precision(c, (), 2.0).withColumn("target", F.lit(20)))


def _modes(src, by, half):
    sel = f"{by} mode, threshold, precision, recall, f1, tp, fp, fn"
    parts = [_best(src, by, f"{E['f1']} DESC, p", "best_f1"), _best(src, by, "10*fn + fp, p", "best_cost"), _best(src, by, _minp("5e-1")[0], "min_precision"),
             f"SELECT {by} 'fixed_0.5' AS mode, {_PT}, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM {half}"]
    return " UNION ALL ".join(f"SELECT {sel} FROM ({p})" for p in parts)


@query("j12_four_modes_on_grid", _modes(_SC, "", "(SELECT threshold AS p, tp, fp, fn FROM f_thr WHERE system = 'p_a' AND threshold = 5e-1)"), ["f_scan", "f_thr"])
def j12(spark, sf):
    s = one_system(spark, sf)
    return M.threshold_modes(M.scan_counts(s, M.candidate_grid(s)), M.counts_at(s, [0.5]), (), LAB_COST_FN, LAB_COST_FP)


SQL["f_edge2"] = (["f_lad"], SQL["f_edge"][1].replace("[0e0, 1e0]", "[5e-1, 1e0]"))


@query("j13_four_modes_on_pr_points", _modes("f_edge2", "system,", "(SELECT system, threshold AS p, tp, fp, fn FROM f_thr WHERE threshold = 5e-1)"), ["f_edge2", "f_thr"])
def j13(spark, sf):
    s = scores_long(spark, sf)
    lad = M.ladder(s, ["system"])
    return M.threshold_modes(M.with_edges(lad, [0.5, 1.0], ["system"]), M.counts_at(s, [0.5], ["system"]), ["system"], LAB_COST_FN, LAB_COST_FP)


@query("j14_full_evaluation", f"""SELECT system, n, round(observed, 6) AS observed, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision, round(brier, 6) AS brier, b.threshold AS best_f1_threshold, b.f1 AS best_f1, b.precision AS best_f1_precision, b.recall AS best_f1_recall,
  c.threshold AS cost_threshold, c.expected_cost, CAST(t.tp AS BIGINT) AS op_tp, CAST(t.fp AS BIGINT) AS op_fp, CAST(t.fn AS BIGINT) AS op_fn, CAST(t.tn AS BIGINT) AS op_tn, op_precision, op_recall, op_f1, op_mcc
  FROM ({auc_sql('f_long', 'system')}) JOIN (SELECT system, count(*) AS n, avg(y) AS observed, avg((p - y) * (p - y)) AS brier FROM f_long GROUP BY system) USING (system)
  JOIN ({_best(_LADX, 'system,', E['f1'] + ' DESC, p', 'best_f1')}) b USING (system) JOIN ({_best('f_edge', 'system,', '5*fn + fp, p', 'best_cost', ', round(5*fn + fp, 6) AS expected_cost')}) c USING (system)
  JOIN (SELECT *, round({E['precision']}, 6) AS op_precision, round({E['recall']}, 6) AS op_recall, round({E['f1']}, 6) AS op_f1, round({E['mcc']}, 6) AS op_mcc FROM f_thr WHERE threshold = 4e-1) t USING (system)""", ["f_edge", "f_thr"])
def j14(spark, sf):
    return M.evaluate(scores_long(spark, sf), ["system"], operating=0.4)


@query("j15_confusion_matrix", "SELECT system, CAST(y AS BIGINT) AS y, CAST(p >= 5e-1 AS BIGINT) AS pred, count(*) AS n FROM f_long GROUP BY 1, 2, 3", ["f_long"])
def j15(spark, sf):
    return scores_long(spark, sf).groupBy("system", "y", (F.col("p") >= 0.5).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("j16_confusion_counts", f"SELECT system, {I4} FROM f_thr WHERE threshold = 5e-1", ["f_thr"])
def j16(spark, sf):
    return M.confusion(scores_long(spark, sf), 0.5, ["system"])


@query("j17_recount_at_user_threshold", f"SELECT system, {I4} FROM f_thr WHERE threshold = 35e-2", ["f_thr"])
def j17(spark, sf):
    return M.confusion(scores_long(spark, sf), 0.35, ["system"])


@query("j18_expected_cost", "SELECT system, threshold, round(5*fn + fp, 6) AS expected_cost FROM f_thr", ["f_thr"])
def j18(spark, sf):
    return M.metrics_at(scores_long(spark, sf), EVAL_THRESHOLDS, ["system"], ["expected_cost"]).select("system", "threshold", "expected_cost")


@query("j19_accuracy_diagnostic", f"SELECT system, {exprs(['accuracy', 'majority_baseline_pct', 'better_than_majority'])} FROM f_thr WHERE threshold = 5e-1", ["f_thr"])
def j19(spark, sf):
    names = ["accuracy", "majority_baseline_pct", "better_than_majority"]
    return M.metrics_at(scores_long(spark, sf), [0.5], ["system"], names).select("system", *names)


@query("j20_fbeta", f"SELECT system, threshold, {exprs(['fbeta'])} FROM f_thr", ["f_thr"])
def j20(spark, sf):
    return M.metrics_at(scores_long(spark, sf), EVAL_THRESHOLDS, ["system"], ["fbeta"]).select("system", "threshold", "fbeta")


@query("j21_curve_areas", """SELECT system, round(sum(n0 * (tp + tp - n1) / 2) / (max(pos) * max(neg)), 6) AS auroc_trapezoid,
  round(sum(n1 * (tp / (tp + fp) + coalesce((tp - n1) / nullif(tp + fp - n1 - n0, 0), 1)) / 2) / max(pos), 6) AS pr_trapezoid FROM f_lad GROUP BY system""", ["f_lad"])
def j21(spark, sf):
    lad = M.ladder(scores_long(spark, sf), ["system"])
    return lad.groupBy("system").agg(M.roc_trapezoid_agg().alias("auroc_trapezoid"), M.pr_trapezoid_agg().alias("pr_trapezoid"))


@query("j21_roc_curve", "SELECT system, round(p, 6) AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM f_lad", ["f_lad"])
def j21b(spark, sf):
    return M.roc_points(M.ladder(scores_long(spark, sf), ["system"]), ["system"])


SWEEP = [round(0.05 + 0.01 * i, 2) for i in range(91)]


@query("j22_threshold_sweep", f"SELECT system, threshold, {exprs(['precision', 'recall', 'f1', 'expected_cost'])} FROM (SELECT system, t AS threshold, " + ", ".join(
    f"CAST(sum(CASE WHEN (p >= t) = {h} AND y = {y} THEN 1 ELSE 0 END) AS DOUBLE) AS {n}" for n, h, y in (("tp", "true", 1), ("fp", "true", 0), ("fn", "false", 1), ("tn", "false", 0)))
    + f" FROM f_long, (SELECT unnest([{', '.join(f'{t * 100:.0f}e-2' for t in SWEEP)}]) AS t) GROUP BY system, t)", ["f_long"])
def j22(spark, sf):
    names = ["precision", "recall", "f1", "expected_cost"]
    return M.metrics_at(scores_long(spark, sf), SWEEP, ["system"], names).select("system", "threshold", *names)


_REL = "SELECT system, CAST(least(7, floor(p * 8)) AS BIGINT) AS bin, avg(p) AS mean_p, avg(y) AS observed, count(*) AS n FROM f_long GROUP BY 1, 2"


@query("j23_reliability_bins", f"SELECT system, bin, round(mean_p, 6) AS mean_p, round(observed, 6) AS observed, n FROM ({_REL})", ["f_long"])
def j23(spark, sf):
    return M.reliability(scores_long(spark, sf), ["system"])


@query("j24_calibration_error", f"SELECT system, round(sum(abs(observed - mean_p) * n) / sum(n), 6) AS ece FROM ({_REL}) GROUP BY system", ["f_long"])
def j24(spark, sf):
    return M.calibration_error(M.reliability(scores_long(spark, sf), ["system"]), ["system"])


@query("j25_calibration_per_split", """SELECT system, half, round(sum(abs(o - m) * n) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier, CAST(sum(n) AS BIGINT) AS n FROM (SELECT system, CASE WHEN year(d) < 1996 THEN 'early' ELSE 'late' END AS half,
  least(7, floor(p * 8)) AS bin, avg(p) AS m, avg(y) AS o, count(*) AS n, sum((p - y) * (p - y)) AS b FROM f_long GROUP BY 1, 2, 3) GROUP BY 1, 2""", ["f_long"])
def j25(spark, sf):
    s = scores_long(spark, sf).withColumn("half", F.when(F.year("d") < 1996, "early").otherwise("late"))
    by = ["system", "half"]
    return M.calibration_error(M.reliability(s, by), by).join(M.brier(s, by).select(*by, "brier", "n"), by)


@query("j26_threshold_or_default", f"SELECT threshold FROM ({_best(_LADX, 'system,', E['f1'] + ' DESC, p', 'best_f1')}) WHERE system = 'p_a' UNION ALL SELECT 5e-1", ["f_lad"])
def j26(spark, sf):
    best = M.best_f1(M.ladder(scores_long(spark, sf), ["system"]), ["system"])
    return M.threshold_or_default(best.where("system = 'p_a'")).union(M.threshold_or_default(best.where("system = 'none'")))


@query("j27_metric_block", f"SELECT system, round(auroc, 6) AS auroc, round(ap, 6) AS average_precision, {exprs(['precision', 'recall', 'f1', 'mcc'])} FROM ({auc_sql('f_long', 'system')}) JOIN (SELECT * FROM f_thr WHERE threshold = 5e-1) USING (system)", ["f_thr"])
def j27(spark, sf):
    s = scores_long(spark, sf)
    names = ["precision", "recall", "f1", "mcc"]
    return M.rank_metrics(s, ["system"]).join(M.metrics_at(s, [0.5], ["system"], names).select("system", *names), "system")


@query("j28_per_class_report", f"SELECT system, CAST(1 AS BIGINT) AS cls, round({z('tp', 'tp + fp')}, 6) AS precision, round({z('tp', 'tp + fn')}, 6) AS recall, round({E['f1']}, 6) AS f1, CAST(tp + fn AS BIGINT) AS support FROM f_thr WHERE threshold = 5e-1 UNION ALL SELECT system, 0, round({z('tn', 'tn + fn')}, 6), round({z('tn', 'tn + fp')}, 6), round({z('2*tn', '2*tn + fp + fn')}, 6), CAST(tn + fp AS BIGINT) FROM f_thr WHERE threshold = 5e-1", ["f_thr"])
def j28(spark, sf):
    return M.per_class(M.confusion(scores_long(spark, sf), 0.5, ["system"]), ["system"])


def _half(h):
    return auc_sql(f"(SELECT * FROM f_long WHERE (year(d) < 1996) = {h})", "system")


@query("j29_overfit_table", f"SELECT system, round(a.auroc, 6) AS auroc_train, round(b.auroc, 6) AS auroc_val, round(a.auroc - b.auroc, 6) AS auroc_gap, round(a.ap, 6) AS average_precision_train, round(b.ap, 6) AS average_precision_val, round(a.ap - b.ap, 6) AS average_precision_gap FROM ({_half('true')}) a JOIN ({_half('false')}) b USING (system)", ["f_long"])
def j29(spark, sf):
    s = scores_long(spark, sf)
    return M.overfit_table(M.rank_metrics(s.where(F.year("d") < 1996), ["system"]), M.rank_metrics(s.where(F.year("d") >= 1996), ["system"]),
                           ["auroc", "average_precision"], "system")


@query("j30_metric_by_name", f"SELECT 'pr_auc' AS metric, system, round(ap, 6) AS value FROM ({auc_sql('f_long', 'system')}) UNION ALL SELECT 'mcc', system, round({E['mcc']}, 6) FROM f_thr WHERE threshold = 5e-1 UNION ALL SELECT 'fbeta', system, round({E['fbeta']}, 6) FROM f_thr WHERE threshold = 5e-1", ["f_thr"])
def j30(spark, sf):
    s = scores_long(spark, sf)
    out = None
    for m in ("pr_auc", "mcc", "fbeta"):
        one = M.metric_scalar(s, m, 0.5, ["system"]).withColumn("metric", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


@query("j31_fold_metrics", f"SELECT system, fold, {exprs(['precision', 'recall', 'f1', 'fpr', 'balanced_accuracy'])} FROM (SELECT system, grp % 5 AS fold, " + ", ".join(
    f"CAST(sum(CASE WHEN (p >= 5e-1) = {h} AND y = {y} THEN 1 ELSE 0 END) AS DOUBLE) AS {n}" for n, h, y in (("tp", "true", 1), ("fp", "true", 0), ("fn", "false", 1), ("tn", "false", 0)))
    + " FROM f_long GROUP BY 1, 2)", ["f_long"])
def j31(spark, sf):
    names = ["precision", "recall", "f1", "fpr", "balanced_accuracy"]
    s = scores_long(spark, sf).withColumn("fold", F.col("grp") % 5)
    return M.with_metrics(M.confusion(s, 0.5, ["system", "fold"]), names).select("system", "fold", *names)
