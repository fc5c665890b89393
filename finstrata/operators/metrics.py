"""Score evaluation: confusion counts, threshold ladders, curves, threshold choice, calibration.

Everything starts from one pre-aggregation to (group, score) rows, so ties and hot scores collapse before any shuffle
that needs an order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import COST_FN, COST_FP, FBETA, PRECISION_TARGET
from ..functions.ordered import position, quantile_grid, running_totals, scalar


def _d(c: Column) -> Column:
    return c.cast("double")


def safe(num: Column, den: Column) -> Column:
    """num / den with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(_d(num), _d(den)), F.lit(0.0))


def score_counts(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    n = F.sum(w) if w else F.count(F.lit(1))
    pos = F.sum(F.when(F.col(y) == 1, F.col(w) if w else 1).otherwise(0))
    return df.groupBy(*by, F.col(p).cast("double").alias("p")).agg(n.alias("n"), pos.alias("n_pos"))


def ladder(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    """Per distinct score the confusion counts of 'predict positive when score >= p'."""
    return ladder_of_counts(score_counts(df, by, p, y, w), by)


def ladder_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``ladder`` over ``score_counts``, which it reads more than once: land them where scores are dear."""
    t = running_totals(counts, "p", ["n", "n_pos"], by)
    tp = F.col("n_pos_tot") - F.col("n_pos_cum") + F.col("n_pos")
    k = F.col("n_tot") - F.col("n_cum") + F.col("n")
    neg_cum = F.col("n_cum") - F.col("n_pos_cum")
    return t.select(
        *by, "p", "n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"), tp.alias("tp"), (k - tp).alias("fp"),
        (F.col("n_pos_tot") - tp).alias("fn"), (F.col("n_tot") - F.col("n_pos_tot") - (k - tp)).alias("tn"),
        F.col("n_pos_tot").alias("pos"), (F.col("n_tot") - F.col("n_pos_tot")).alias("neg"),
        (neg_cum - (F.col("n") - F.col("n_pos"))).alias("neg_below"),
    )


def auroc_agg() -> Column:
    """Over ladder rows; NULL when only one class is present."""
    area = F.sum(_d(F.col("n_pos")) * (F.col("neg_below") + F.col("n_neg") / 2.0))
    return F.try_divide(area, _d(F.max("pos")) * F.max("neg"))


def ap_agg() -> Column:
    """Step-wise average precision over ladder rows (not the trapezoid area)."""
    step = _d(F.col("n_pos")) * F.try_divide(_d(F.col("tp")), _d(F.col("tp") + F.col("fp")))
    return F.try_divide(F.sum(step), _d(F.max("pos")))


def pr_trapezoid_agg() -> Column:
    """Trapezoid area under the precision-recall curve, ending in the point (0, 1)."""
    tp, fp = F.col("tp"), F.col("fp")
    prec = F.try_divide(_d(tp), _d(tp + fp))
    after = F.coalesce(F.try_divide(_d(tp - F.col("n_pos")), _d(tp + fp - F.col("n_pos") - F.col("n_neg"))), F.lit(1.0))
    return F.try_divide(F.sum(_d(F.col("n_pos")) * (prec + after) / 2.0), _d(F.max("pos")))


def roc_trapezoid_agg() -> Column:
    """Trapezoid area under the ROC curve; equals the rank form."""
    tp_next = F.col("tp") - F.col("n_pos")
    return F.try_divide(F.sum(_d(F.col("n_neg")) * (F.col("tp") + tp_next) / 2.0), _d(F.max("pos")) * F.max("neg"))


def rank_metrics(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y", w: str | None = None) -> DataFrame:
    return ladder(df, by, p, y, w).groupBy(*by).agg(auroc_agg().alias("auroc"), ap_agg().alias("average_precision"))


# ---- metrics from counts -------------------------------------------------------------------------------

def count_columns(p: str, y: str, threshold: Column | float, w: Column | None = None) -> list[Column]:
    """tp, fp, fn, tn aggregates at a threshold."""
    one = F.lit(1) if w is None else w
    hit = F.col(p) >= threshold
    c = lambda cond: F.sum(F.when(cond, one).otherwise(0))
    return [
        c(hit & (F.col(y) == 1)).alias("tp"), c(hit & (F.col(y) != 1)).alias("fp"),
        c(~hit & (F.col(y) == 1)).alias("fn"), c(~hit & (F.col(y) != 1)).alias("tn"),
    ]


def counts_at(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    """(by, threshold, tp, fp, fn, tn): distinct scores meet a short literal list, then partial sums combine."""
    sc = score_counts(df, by, p, y)
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    x = sc.select(*by, "p", "n", "n_pos", F.explode(grid).alias("threshold"))
    hit, neg = F.col("p") >= F.col("threshold"), F.col("n") - F.col("n_pos")
    s = lambda cond, v: F.sum(F.when(cond, v).otherwise(0))
    return x.groupBy(*by, "threshold").agg(
        s(hit, F.col("n_pos")).alias("tp"), s(hit, neg).alias("fp"), s(~hit, F.col("n_pos")).alias("fn"), s(~hit, neg).alias("tn"))


def metric_exprs(mcc_mode: str = "predictions", cost_fn: float = COST_FN, cost_fp: float = COST_FP, beta: float = FBETA) -> dict[str, Column]:
    """Every thresholded metric as an expression over tp, fp, fn, tn (and pos_rate-free)."""
    tp, fp, fn, tn = (_d(F.col(c)) for c in ("tp", "fp", "fn", "tn"))
    n, pos, neg = tp + fp + fn + tn, tp + fn, fp + tn
    prec, rec = safe(tp, tp + fp), safe(tp, tp + fn)
    prec0, rec0 = safe(tn, tn + fn), safe(tn, tn + fp)
    f1, f1_0 = safe(2 * tp, 2 * tp + fp + fn), safe(2 * tn, 2 * tn + fp + fn)
    mcc = safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    if mcc_mode == "truth":
        mcc = F.when((pos > 0) & (neg > 0), mcc)
    b2 = beta * beta
    return {
        "accuracy": F.try_divide(tp + tn, n), "precision": prec, "recall": rec, "f1": f1,
        "macro_precision": (prec + prec0) / 2, "macro_recall": (rec + rec0) / 2, "macro_f1": (f1 + f1_0) / 2,
        "weighted_precision": F.try_divide(pos * prec + neg * prec0, n), "weighted_recall": F.try_divide(pos * rec + neg * rec0, n),
        "weighted_f1": F.try_divide(pos * f1 + neg * f1_0, n), "fbeta": safe((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp),
        "specificity": F.try_divide(tn, neg), "fpr": F.try_divide(fp, neg), "npv": F.try_divide(tn, tn + fn), "mcc": mcc,
        "balanced_accuracy": F.when((pos > 0) & (neg > 0), (rec + rec0) / 2), "n_predicted": (F.col("tp") + F.col("fp")),
        "expected_cost": cost_fn * fn + cost_fp * fp, "majority_baseline_pct": F.try_divide(100.0 * F.greatest(pos, neg), n),
        "better_than_majority": (F.try_divide(tp + tn, n) > F.try_divide(F.greatest(pos, neg), n)).cast("int"),
    }


MAIN_METRICS = ["accuracy", "precision", "recall", "f1", "macro_f1", "weighted_f1", "specificity", "npv", "mcc", "n_predicted", "expected_cost"]
LAB_METRICS = ["precision", "recall", "f1", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall",
               "weighted_f1", "fbeta", "balanced_accuracy", "fpr", "specificity", "mcc", "accuracy", "majority_baseline_pct", "better_than_majority"]


def with_metrics(counts: DataFrame, names: Sequence[str] = tuple(MAIN_METRICS), **options) -> DataFrame:
    e = metric_exprs(**options)
    return counts.select("*", *[e[n].alias(n) for n in names])


def metrics_at(df: DataFrame, thresholds: Sequence[float], by: Sequence[str] = (), names: Sequence[str] = tuple(MAIN_METRICS), **options) -> DataFrame:
    return with_metrics(counts_at(df, thresholds, by), names, **options)


def brier(df: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2.0)).alias("brier"), F.avg(F.col(y).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*count_columns("p", "y", threshold))


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    tp, fp, fn, tn = (_d(F.col(c)) for c in ("tp", "fp", "fn", "tn"))
    row = lambda k, a, b, c: F.struct(
        F.lit(k).alias("cls"), safe(a, a + b).alias("precision"), safe(a, a + c).alias("recall"),
        safe(2 * a, 2 * a + b + c).alias("f1"), (a + c).cast("bigint").alias("support"))
    return counts.select(*by, F.explode(F.array(row(1, tp, fp, fn), row(0, tn, fn, fp))).alias("r")).select(*by, "r.*")


# ---- threshold choice ----------------------------------------------------------------------------------

def _f1() -> Column:
    return safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def _prec() -> Column:
    return safe(F.col("tp"), F.col("tp") + F.col("fp"))


def _rec() -> Column:
    return safe(F.col("tp"), F.col("tp") + F.col("fn"))


def pr_points(lad: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return lad.select(*by, F.col("p").alias("threshold"), _prec().alias("precision"), _rec().alias("recall"), _f1().alias("f1"))


def roc_points(lad: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return lad.select(*by, F.col("p").alias("threshold"), F.try_divide(_d(F.col("fp")), _d(F.col("neg"))).alias("fpr"),
                      F.try_divide(_d(F.col("tp")), _d(F.col("pos"))).alias("tpr"))


def with_edges(lad: DataFrame, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Candidate thresholds: the scores plus fixed edges, with their counts."""
    cols = [*by, "p", "tp", "fp", "fn", "tn"]
    at = lambda e, c: F.sum(F.when(F.col("p") >= e, F.col(c)).otherwise(0))
    sums = lad.groupBy(*by).agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"), *[
        x for i, e in enumerate(edges) for x in (at(e, "n_pos").alias(f"t{i}"), at(e, "n_neg").alias(f"f{i}"))])
    rows = [F.struct(F.lit(float(e)).alias("p"), F.col(f"t{i}").alias("tp"), F.col(f"f{i}").alias("fp"),
                     (F.col("pos") - F.col(f"t{i}")).alias("fn"), (F.col("neg") - F.col(f"f{i}")).alias("tn")) for i, e in enumerate(edges)]
    extra = sums.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")
    return lad.select(*cols).unionByName(extra.select(*cols))


def _pick(cands: DataFrame, by: Sequence[str], best: Column, mode: str, extra: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    row = F.struct(F.col("p").alias("threshold"), _prec().alias("precision"), _rec().alias("recall"), _f1().alias("f1"), "tp", "fp", "fn",
                   *[c.alias(n) for n, c in extra])
    got = cands.groupBy(*by).agg(F.max_by(row, best).alias("r"))
    return got.select(*by, F.lit(mode).alias("mode"), "r.*")


def best_f1(cands: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Highest F1, lowest threshold among equals."""
    return _pick(cands, by, F.struct(_f1(), -F.col("p")), "best_f1")


def best_cost(cands: DataFrame, by: Sequence[str] = (), cost_fn: float = COST_FN, cost_fp: float = COST_FP) -> DataFrame:
    cost = cost_fn * F.col("fn") + cost_fp * F.col("fp")
    return _pick(cands, by, F.struct(-cost, -F.col("p")), "best_cost", [("expected_cost", cost)])


def min_precision(cands: DataFrame, by: Sequence[str] = (), target: float = PRECISION_TARGET) -> DataFrame:
    """Most recall among thresholds that reach the precision target; otherwise the most precise one."""
    ok = _prec() >= target
    order = F.struct(ok.cast("int"), F.when(ok, _rec()).otherwise(_prec()), -F.col("p"))
    return _pick(cands, by, order, "min_precision", [("target_met", ok.cast("int"))])


def threshold_modes(cands: DataFrame, fixed: DataFrame, by: Sequence[str] = (), cost_fn: float = COST_FN, cost_fp: float = COST_FP,
                    target: float = PRECISION_TARGET) -> DataFrame:
    """Four modes side by side; ``fixed`` holds the counts at 0.5."""
    cols = [*by, "mode", "threshold", "precision", "recall", "f1", "tp", "fp", "fn"]
    half = fixed.select(*by, F.lit("fixed_0.5").alias("mode"), F.lit(0.5).alias("threshold"), _prec().alias("precision"),
                        _rec().alias("recall"), _f1().alias("f1"), "tp", "fp", "fn")
    out = best_f1(cands, by).select(*cols)
    for part in (best_cost(cands, by, cost_fn, cost_fp), min_precision(cands, by, target), half):
        out = out.unionByName(part.select(*cols))
    return out


def candidate_grid(df: DataFrame, steps: int = 1000, p: str = "p") -> DataFrame:
    """Quantile grid plus 0, 0.5 and 1, distinct."""
    fixed = df.sparkSession.createDataFrame([(0.0,), (0.5,), (1.0,)], "threshold double")
    return quantile_grid(df, p, steps).select(F.col("q").alias("threshold")).union(fixed).distinct()


def scan_counts(df: DataFrame, grid: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Counts for every threshold of a grid in one pass: each score is placed between grid points, the cells
    combine map-side, and only grid-size rows are accumulated in order."""
    sc = score_counts(df, (), p, y)
    arr = scalar(grid.agg(F.sort_array(F.collect_list("threshold")).alias("g")))
    cell = sc.withColumn("_g", arr).withColumn("k", position(F.col("p"), F.col("_g"), strict=False)).groupBy("k").agg(
        F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))
    numbered = grid.select("threshold", F.row_number().over(W.orderBy("threshold")).alias("k"))
    total = sc.agg(F.struct(F.sum("n").alias("n"), F.sum("n_pos").alias("pos")).alias("t"))
    up = W.orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, 0)
    t = numbered.join(cell, "k", "left").select(
        "threshold", F.sum(F.coalesce("n_pos", F.lit(0))).over(up).alias("tp"), F.sum(F.coalesce("n", F.lit(0))).over(up).alias("hits"),
        scalar(total).alias("t"))
    return t.select(
        F.col("threshold").alias("p"), "tp", (F.col("hits") - F.col("tp")).alias("fp"), (F.col("t.pos") - F.col("tp")).alias("fn"),
        (F.col("t.n") - F.col("t.pos") - F.col("hits") + F.col("tp")).alias("tn"))


def evaluate(df: DataFrame, by: Sequence[str] = (), operating: float | None = None, cost_fn: float = COST_FN, cost_fp: float = COST_FP) -> DataFrame:
    """One row per group: size, base rate, AUROC, AP, Brier, best F1 point, cost-optimal point."""
    if not by:
        return evaluate(df.withColumn("_all", F.lit(1)), ["_all"], operating, cost_fn, cost_fp).drop("_all")
    by = list(by)
    lad = ladder(df, by)
    f1row = F.max_by(F.struct(F.col("p").alias("t"), _f1().alias("f1"), _prec().alias("prec"), _rec().alias("rec")), F.struct(_f1(), -F.col("p")))
    core = lad.groupBy(*by).agg(auroc_agg().alias("auroc"), ap_agg().alias("average_precision"), f1row.alias("b"))
    cost = best_cost(with_edges(lad, [0.0, 1.0], by), by, cost_fn, cost_fp).select(
        *by, F.col("threshold").alias("cost_threshold"), "expected_cost")
    base = brier(df, by)
    out = core.join(cost, by).join(base, by).select(
        *by, "n", "observed", "auroc", "average_precision", "brier", F.col("b.t").alias("best_f1_threshold"), F.col("b.f1").alias("best_f1"),
        F.col("b.prec").alias("best_f1_precision"), F.col("b.rec").alias("best_f1_recall"), "cost_threshold", "expected_cost")
    if operating is not None:
        op = with_metrics(confusion(df, operating, by), ["precision", "recall", "f1", "mcc"])
        out = out.join(op.select(*by, *[F.col(c).alias(f"op_{c}") for c in ("tp", "fp", "fn", "tn", "precision", "recall", "f1", "mcc")]), by)
    return out


def reliability(df: DataFrame, by: Sequence[str] = (), bins: int = 8) -> DataFrame:
    """Equal-width bins: mean score, observed rate, size."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)))
    return df.groupBy(*by, b.cast("bigint").alias("bin")).agg(
        F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


def calibration_error(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return bins.groupBy(*by).agg((F.sum(F.abs(F.col("observed") - F.col("mean_p")) * F.col("n")) / F.sum("n")).alias("ece"))


METRIC_REGISTRY: dict[str, Callable[[DataFrame, Sequence[str], float], DataFrame]] = {
    "roc_auc": lambda df, by, t: rank_metrics(df, by).select(*by, F.col("auroc").alias("value")),
    "pr_auc": lambda df, by, t: rank_metrics(df, by).select(*by, F.col("average_precision").alias("value")),
    "brier": lambda df, by, t: brier(df, by).select(*by, F.col("brier").alias("value")),
    **{m: (lambda df, by, t, m=m: with_metrics(confusion(df, t, by), [m], mcc_mode="truth").select(*by, F.col(m).alias("value")))
       for m in ("f1", "macro_f1", "weighted_f1", "fbeta", "balanced_accuracy", "mcc", "precision", "recall", "accuracy", "fpr")},
}


def metric_scalar(df: DataFrame, metric: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    if metric not in METRIC_REGISTRY:
        raise KeyError(f"unknown metric {metric!r}; known: {sorted(METRIC_REGISTRY)}")
    return METRIC_REGISTRY[metric](df, by, threshold)


def overfit_table(train: DataFrame, validation: DataFrame, metrics: Sequence[str], key: str = "model") -> DataFrame:
    v = validation.select(key, *[F.col(m).alias(f"{m}_val") for m in metrics])
    return train.select(key, *[F.col(m).alias(f"{m}_train") for m in metrics]).join(v, key).select(
        key, *[c for m in metrics for c in (F.col(f"{m}_train"), F.col(f"{m}_val"), (F.col(f"{m}_train") - F.col(f"{m}_val")).alias(f"{m}_gap"))])


def threshold_or_default(chosen: DataFrame, default: float = 0.5) -> DataFrame:
    """A single chosen threshold, or the default when none was found."""
    return chosen.agg(F.coalesce(F.max("threshold"), F.lit(default)).alias("threshold"))

