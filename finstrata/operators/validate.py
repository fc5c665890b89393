"""Validation designs: group folds, leave-one-group-out, walk-forward, stratified folds, search, ablation."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, functions as F

from ..constants import FEATURE_GROUPS, SEED
from ..functions.draws import with_pair_uniform
from ..functions.ordered import hash_rank, running_totals
from ..sources.writers import content_fingerprint
from .metrics import best_f1, confusion, ladder, rank_metrics, with_edges, with_metrics
from .models import fit_model, fit_technique, materialize, score

# ---- folds ----------------------------------------------------------------------------------------------------


def fill_lightest(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each fold receives when every group goes to the lightest fold (ties: lower fold).

    Fold f would take its j-th group at load L_f + j*size, so the winners are the ``count`` smallest of those keys; the cut is
    found by bisection instead of one step per group.
    """
    k = len(loads)
    taken = lambda level: [max(0, (level - load) // size + 1) if level >= load else 0 for load in loads]
    lo, hi = min(loads) - 1, max(loads) + size * (count + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(taken(mid)) <= count else (lo, mid - 1)
    q = taken(lo)
    left = count - sum(q)
    for f in sorted(range(k), key=lambda f: (loads[f] + q[f] * size, f))[:left]:
        q[f] += 1
    return q


def group_folds(df: DataFrame, group: str, k: int = 4) -> DataFrame:
    """(group, fold): largest groups first, each to the lightest fold.

    Groups of one size are interchangeable, so only the number of groups per distinct size reaches the driver; which group of a
    size goes where follows its place in a hash order.
    """
    sizes = materialize(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")))  # read three times; what it counts may be a long plan
    classes = [(int(r["n"]), int(r["c"])) for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("n").desc()).collect()]
    k = max(2, min(k, sum(c for _, c in classes)))
    loads = [0] * k
    bounds = []
    for size, count in classes:
        q = fill_lightest(loads, size, count)
        end = 0
        for f in range(k):
            loads[f] += q[f] * size
            if q[f]:
                bounds.append((size, f, end + 1, end + q[f]))
                end += q[f]
    table = df.sparkSession.createDataFrame(bounds, "n long, fold int, lo long, hi long")
    placed = hash_rank(with_pair_uniform(sizes, "_u", F.lit(3), F.pmod(F.xxhash64(group), F.lit(2147483647)), SEED), F.col("_u"), group, ["n"], "pos")
    return placed.join(table, "n").where(F.col("pos").between(F.col("lo"), F.col("hi"))).select(group, "fold")


def stratified_folds(df: DataFrame, k: int = 5, seed: int = SEED, y: str = "y", key: str = "id") -> DataFrame:
    """Add ``fold``: rows of each class dealt out in hash order."""
    t = hash_rank(with_pair_uniform(df, "_u", F.lit(1), F.col(key), seed), F.col("_u"), key, [y], "_pos")
    return t.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_pos", "_u")


def stratified_holdout(df: DataFrame, test_size: float = 0.2, seed: int = SEED, y: str = "y", key: str = "id") -> DataFrame:
    """Add ``part``: the first round(n * (1 - test_size)) rows of each class in hash order train."""
    t = hash_rank(with_pair_uniform(df, "_u", F.lit(2), F.col(key), seed), F.col("_u"), key, [y], "_pos")
    sizes = {int(r[y]): int(r["n"]) for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = F.lit(0)
    for c, n in sizes.items():
        cut = F.when(F.col(y) == c, F.lit(round(n * (1 - test_size)))).otherwise(cut)
    return t.withColumn("part", F.when(F.col("_pos") <= cut, "train").otherwise("test")).drop("_pos", "_u")


def walk_forward_cuts(samples: DataFrame, n_folds: int = 4) -> list[dict]:
    """Cut and stop dates per fold: the target end at position k*n/(n_folds+1) in time order."""
    dates = samples.groupBy("target_period_end").agg(F.count(F.lit(1)).alias("n"))
    t = running_totals(dates, "target_period_end", ["n"])
    n = samples.count()
    want = {k: min(k * n // (n_folds + 1), n - 1) for k in range(1, n_folds + 1)}
    at = lambda i: F.min(F.when((F.col("n_cum") > i), F.col("target_period_end")))
    row = t.agg(*[at(i).alias(f"c{k}") for k, i in want.items()]).first()
    return [{"fold": k, "cut": row[f"c{k}"], "stop": row[f"c{k + 1}"] if k < n_folds else None} for k in want]


def walk_forward(samples: DataFrame, n_folds: int = 4, purge_days: int = 90) -> DataFrame:
    """(samples, fold, cut, role): train rows end before the cut and were published ``purge_days`` before it.

    The folds are a short literal list, exploded per row instead of joined.
    """
    folds = walk_forward_cuts(samples, n_folds)
    arr = F.array(*[F.struct(F.lit(f["fold"]).alias("fold"), F.lit(f["cut"]).alias("cut"), F.lit(f["stop"]).cast("date").alias("stop")) for f in folds])
    t = samples.withColumn("_f", F.explode(arr)).select(*samples.columns, "_f.fold", "_f.cut", "_f.stop")
    before = F.col("target_period_end") < F.col("cut")
    train = before & (F.col("label_available_on") <= F.date_sub(F.col("cut"), purge_days))
    test = ~before & (F.col("stop").isNull() | (F.col("target_period_end") < F.col("stop")))
    return t.withColumn("role", F.when(train, "train").when(test, "test")).where("role is not null").drop("stop")


def walk_forward_summary(members: DataFrame, min_train: int = 60) -> DataFrame:
    n = lambda r: F.count(F.when(F.col("role") == r, 1))
    end = lambda fn: fn(F.when(F.col("role") == "test", F.col("target_period_end")))
    return members.groupBy("fold", "cut").agg(n("train").alias("n_train"), n("test").alias("n_test"), end(F.min).alias("test_from"), end(F.max).alias("test_to")).withColumn(
        "skipped", ((F.col("n_train") < min_train) | (F.col("n_test") == 0)).cast("int"))


# ---- evaluation loops ---------------------------------------------------------------------------------------------

#: Models that are fitted at the same time: a fit is many short jobs, which leave a cluster idle in between.
PARALLEL = 4


def at_once(run: Callable, items: Sequence) -> list:
    """Results of independent fits in the order of ``items``; the fits run as concurrent Spark jobs."""
    with ThreadPoolExecutor(PARALLEL) as pool:
        return list(pool.map(run, items))


def _usable(train: DataFrame, test: DataFrame, min_test: int) -> bool:
    return train.select("y").distinct().count() > 1 and test.count() >= min_test


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], Transformer], keep: Sequence[str], fold: str = "fold", min_test: int = 4) -> DataFrame:
    """Scores of every row from the model that did not see its fold; degenerate folds are left out.

    Folds are few (parameter k), rows never leave the executors. One pass counts the classes of all folds.
    """
    sizes = {(r[fold], r["y"]): r["n"] for r in df.groupBy(fold, "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    folds = []
    for k in sorted({f for f, _ in sizes}):
        if len({y for f, y in sizes if f is not None and f != k}) > 1 and sum(n for (f, _), n in sizes.items() if f == k) >= min_test:
            folds.append(k)
    one = lambda k: materialize(score(fit(df.where(F.col(fold) != k)), df.where(F.col(fold) == k), [*keep, fold, "y"]))  # metrics read scores several times
    parts = at_once(one, folds)
    if not parts:
        raise ValueError("no fold with both classes and enough test rows")
    return reduce(DataFrame.unionByName, parts)


def pooled_and_fold(oof: DataFrame, fold: str = "fold", by: Sequence[str] = ()) -> DataFrame:
    """AUROC and AP pooled over all folds and per fold."""
    per = rank_metrics(oof, [*by, fold]).select(*by, F.concat(F.lit("fold_"), F.col(fold).cast("string")).alias("scope"), "auroc", "average_precision")
    pooled = rank_metrics(oof.withColumn("_p", F.lit("pooled")), [*by, "_p"]).select(*by, F.col("_p").alias("scope"), "auroc", "average_precision")
    return pooled.unionByName(per)


def grouped_cv(df: DataFrame, names: Sequence[str], cols: Sequence[str], group: str = "entity", k: int = 4, options: dict | None = None) -> DataFrame:
    """Out-of-fold scores of several families with whole groups held out: (model, keys, fold, y, p)."""
    t = materialize(df.join(group_folds(df, group, k), group))
    out = None
    for name in names:
        one = out_of_fold(t, lambda tr, n=name: fit_model(n, tr, cols, **(options or {}).get(n, {})), ["id", group]).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def leave_one_group_out(df: DataFrame, groups: Sequence, name: str, cols: Sequence[str], group: str = "entity", min_test: int = 4, **options) -> DataFrame:
    """Train on the train rows of all other groups, test on the later rows of the group held out: scores per group.

    One model per listed group is the definition of this design, so the list is a parameter of the caller.
    """
    t = materialize(df)
    out = None
    for g in groups:
        train = t.where((F.col("split") == "train") & (F.col(group) != g))
        test = t.where(F.col("split").isin("validation", "test") & (F.col(group) == g))
        if not _usable(train, test, min_test):
            continue
        one = score(fit_model(name, train, cols, **options), test, [F.col(group).alias("held_out"), "id", "y"])
        out = one if out is None else out.unionByName(one)
    return out


def group_metrics(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    n = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"), F.avg("y").alias("observed"), (F.min("y") == F.max("y")).cast("int").alias("single_class"))
    return n.join(rank_metrics(scores, by), list(by))


def walk_forward_metrics(df: DataFrame, names: Sequence[str], cols: Sequence[str], n_folds: int = 4, purge_days: int = 90, min_train: int = 60, options: dict | None = None) -> DataFrame:
    m = materialize(walk_forward(df, n_folds, purge_days))
    ok = [r["fold"] for r in walk_forward_summary(m, min_train).where("skipped = 0").select("fold").collect()]
    out = None
    for f in sorted(ok):
        train, test = m.where((F.col("fold") == f) & (F.col("role") == "train")), m.where((F.col("fold") == f) & (F.col("role") == "test"))
        if not _usable(train, test, 4):
            continue
        for name in names:
            one = score(fit_model(name, train, cols, **(options or {}).get(name, {})), test, [F.lit(name).alias("model"), "fold", "y"])
            out = one if out is None else out.unionByName(one)
    return group_metrics(out, ["model", "fold"])


def summarize(metrics: DataFrame, by: str = "model") -> DataFrame:
    return metrics.groupBy(by).agg(F.avg("auroc").alias("mean_auroc"), F.min("auroc").alias("worst_auroc"), F.avg("average_precision").alias("mean_ap"), F.count("auroc").alias("n_folds"))


def untouched(before: DataFrame, after: DataFrame, cols: Sequence[str]) -> DataFrame:
    """1 when two tables hold the same rows, by an order-independent content hash."""
    a, b = content_fingerprint(before, cols), content_fingerprint(after, cols)
    return a.select((F.col("fingerprint") == b.select("fingerprint").scalar()).cast("int").alias("same"), "n_rows")


def evaluate_techniques(df: DataFrame, keys: Sequence[str], k: int = 3, threshold: float = 0.5, go_on: bool = False,
                        tuner: Callable[[DataFrame], float] | None = None, **params) -> DataFrame:
    """Out-of-fold metrics of imbalance techniques on (id, x, y): samplers see only the training folds. ``tuner`` picks each technique's
    threshold from its out-of-fold scores (y, p). With ``go_on`` a technique that fails is reported with its error instead of ending the run."""
    from .models import TECHNIQUES, vectorized

    t = materialize(vectorized(stratified_folds(df, k)))
    out = None
    for key in keys:
        try:
            oof = out_of_fold(t, lambda tr, key=key: fit_technique(key, tr, **params), ["id"]).withColumn("technique", F.lit(key))
            oof = materialize(oof) if tuner else oof
            at = float(tuner(oof.select("y", "p"))) if tuner else threshold
            m = group_metrics(oof, ["technique"]).join(
                with_metrics(confusion(oof, at, ["technique"]), ["precision", "recall", "f1", "fpr", "balanced_accuracy"], mcc_mode="truth"), "technique")
            one = m.withColumn("family", F.lit(TECHNIQUES[key][0])).withColumn("status", F.lit("ok"))
            one = one.withColumn("threshold", F.lit(at)) if tuner else one
        except Exception as e:  # noqa: BLE001
            if not go_on:
                raise
            one = df.sparkSession.createDataFrame([(key, TECHNIQUES.get(key, ("unknown",))[0], f"error: {type(e).__name__}: {str(e)[:200]}")], "technique string, family string, status string")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def best_f1_threshold(scores: DataFrame) -> float:
    """The score at which predicting positive has the best F1: a tuner for the evaluations."""
    return best_f1(with_edges(ladder(scores), [0.5])).first()["threshold"]


def evaluate_on_holdout(train: DataFrame, test: DataFrame, key: str, tuner: Callable[[DataFrame], float], k: int = 5, **params) -> DataFrame:
    """The whole evaluation of one technique: threshold tuned on out-of-fold scores, refit on all training rows, test rows scored once.

    Three leak checks come with the metrics: the sampler left the test rows as they were, no test id is among the training ids, and the fitted
    model scored every test row once. Seconds of fitting and scoring are the driver's wall clock.
    """
    from .models import vectorized

    train, test = train.select("id", "x", "y"), test.select("id", "x", "y")
    before = content_fingerprint(test, ["id", "y"]).first()["fingerprint"]
    oof = materialize(out_of_fold(materialize(vectorized(stratified_folds(train, k))), lambda tr: fit_technique(key, tr, **params), ["id"]))
    at = float(tuner(oof.select("y", "p")))
    began = time.monotonic()
    model = fit_technique(key, train, **params)
    fitted = time.monotonic()
    scored = materialize(score(model, vectorized(test), ["id", "y"]).withColumn("technique", F.lit(key)))
    done = time.monotonic()
    after = content_fingerprint(test, ["id", "y"]).first()["fingerprint"]
    seen = scored.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).first()
    m = group_metrics(scored, ["technique"]).join(with_metrics(confusion(scored, at, ["technique"]), ["precision", "recall", "f1", "fpr", "balanced_accuracy"], mcc_mode="truth"), "technique")
    return m.withColumns({
        "threshold": F.lit(at), "fit_seconds": F.lit(fitted - began), "score_seconds": F.lit(done - fitted),
        "test_untouched": F.lit(int(before == after)), "ids_disjoint": F.lit(int(train.join(test, "id", "left_semi").isEmpty())),
        "scored_once": F.lit(int(seen["n"] == seen["ids"] == test.count())),
    })


# ---- search ------------------------------------------------------------------------------------------------------------

# ---- fixed values: search spaces per family --------------------------------------------------------------
#: Names are Spark's: regParam stands for the strength of the penalty, a depth of 30 (Spark's largest) for none; the network has no penalty in Spark.
SEARCH_SPACES: dict[str, dict[str, tuple]] = {
    "logistic": {"regParam": ("loguniform", 0.001, 10.0), "weights": ("choice", ("none", "balanced")), "maxIter": ("choice", (1000, 2000))},
    "random_forest": {
        "maxDepth": ("choice", (3, 4, 6, 8, 30)), "minInstancesPerNode": ("int", 1, 5), "numTrees": ("choice", (200, 300, 500, 800)),
        "featureSubsetStrategy": ("choice", ("sqrt", "log2", "0.5")),
    },
    "gradient_boosting": {
        "stepSize": ("loguniform", 0.01, 0.2), "maxDepth": ("int", 2, 5), "maxIter": ("choice", (200, 300, 400, 600)), "l2": ("loguniform", 0.001, 10.0),
    },
    "mlp": {"hidden": ("choice", (16, 32, 64)), "stepSize": ("loguniform", 0.0001, 0.01), "maxIter": ("choice", (1000, 3000))},
}


#: How a value is drawn from each kind of range.
DRAWS: dict[str, Callable[..., object]] = {
    "loguniform": lambda rng, low, high: low * (high / low) ** rng.random(),
    "float": lambda rng, low, high: low + (high - low) * rng.random(),
    "int": lambda rng, low, high: rng.randrange(low, high + 1),
    "choice": lambda rng, options: options[rng.randrange(len(options))],
}


@dataclass(frozen=True)
class Trial:
    """One configuration. Trials are the same if their values agree to six digits."""

    params: tuple[tuple[str, object], ...]

    @classmethod
    def draw(cls, space: dict[str, tuple], rng: random.Random) -> Trial:
        unknown = {kind for kind, *_ in space.values()} - DRAWS.keys()
        if unknown:
            raise ValueError(f"no such range: {sorted(unknown)}; known: {sorted(DRAWS)}")
        return cls(tuple((name, DRAWS[kind](rng, *limits)) for name, (kind, *limits) in space.items()))

    @classmethod
    def of(cls, params: dict) -> Trial:
        return cls(tuple(params.items()))

    @property
    def name(self) -> str:
        shown = {k: float(f"{v:.6f}") if isinstance(v, float) else v for k, v in self.params}
        return json.dumps(shown, sort_keys=True)


def cross_group_ap(df: DataFrame, name: str, params: dict, cols: Sequence[str], fold: str = "fold", **options) -> dict:
    """Mean and spread of AP over folds of whole groups; ``df`` already carries the fold."""
    oof = out_of_fold(df, lambda tr: fit_model(name, tr, cols, **params, **options), ["id"], fold)
    r = rank_metrics(oof, [fold]).where("auroc is not null").agg(
        F.avg("average_precision").alias("ap"), F.stddev_samp("average_precision").alias("sd"), F.avg("auroc").alias("auroc"), F.count(F.lit(1)).alias("n")).first()
    return {"cv_average_precision": r["ap"], "cv_ap_std": r["sd"] or 0.0, "cv_auroc": r["auroc"], "n_folds": r["n"]}


def random_search(df: DataFrame, name: str, cols: Sequence[str], n_trials: int = 40, group: str = "entity", k: int = 4, seed: int = SEED,
                  space: dict | None = None, parallel: int = 2, base: dict | None = None) -> DataFrame:
    """Ledger of distinct random configurations, best first. Trials run as concurrent Spark jobs over one folded table."""
    rng, trials = random.Random(seed), {}
    for _ in range(n_trials):
        trial = Trial.draw(space or SEARCH_SPACES[name], rng)
        trials.setdefault(trial.name, dict(trial.params))
    t = materialize(df.join(group_folds(df, group, k), group))
    run = lambda item: (name, item[0], *cross_group_ap(t, name, {**(base or {}), **item[1]}, cols).values())
    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(run, trials.items()))
    led = df.sparkSession.createDataFrame(rows, "model string, params string, cv_average_precision double, cv_ap_std double, cv_auroc double, n_folds long")
    return led.orderBy(F.col("cv_average_precision").desc_nulls_last(), "params")


def grid_search(df: DataFrame, name: str, cols: Sequence[str], grid: dict[str, Sequence], group: str = "entity", k: int = 4, parallel: int = 2, base: dict | None = None) -> DataFrame:
    """Every configuration of a small grid, plus the default one as reference."""
    configs: list[dict] = [{}]
    for key, values in grid.items():
        configs = [{**c, key: v} for c in configs for v in values]
    t = materialize(df.join(group_folds(df, group, k), group))
    named = [("default", {})] + [(Trial.of(c).name, c) for c in configs]
    run = lambda item: (name, item[0], *cross_group_ap(t, name, {**(base or {}), **item[1]}, cols).values())
    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(run, named))
    led = df.sparkSession.createDataFrame(rows, "model string, params string, cv_average_precision double, cv_ap_std double, cv_auroc double, n_folds long")
    return led.orderBy(F.col("cv_average_precision").desc_nulls_last(), "params")


def compare_search(search: DataFrame, grid: DataFrame) -> DataFrame:
    best = lambda d, a: d.groupBy("model").agg(F.max("cv_average_precision").alias(a))
    return best(search, "search_ap").join(best(grid, "grid_ap"), "model").withColumn("delta", F.col("search_ap") - F.col("grid_ap"))


def nested_cv(df: DataFrame, name: str, cols: Sequence[str], grid: dict[str, Sequence], group: str = "entity", outer: int = 3, inner: int = 2, base: dict | None = None) -> DataFrame:
    """The configuration of each outer fold is chosen by inner folds on its training groups only."""
    t = materialize(df.join(group_folds(df, group, outer).withColumnRenamed("fold", "outer"), group))
    out = None
    for o in range(outer):
        train, test = t.where(F.col("outer") != o), t.where(F.col("outer") == o)
        if not _usable(train, test, 4):
            continue
        led = grid_search(train, name, cols, grid, group, inner, base=base)
        best = next(r["params"] for r in led.collect() if r["params"] != "default")
        one = materialize(score(fit_model(name, train, cols, **{**(base or {}), **json.loads(best)}), test, ["id", "y", F.lit(o).alias("fold"), F.lit(best).alias("params")]))
        out = one if out is None else out.unionByName(one)
    return out


def ablation_variants(cols: Sequence[str], low_coverage: Sequence[str] = ()) -> dict[str, list[str]]:
    """Column sets: all, all but each feature group, all but the low-coverage columns."""
    out = {"all": list(cols)}
    for g, names in FEATURE_GROUPS.items():
        rest = [c for c in cols if c not in names]
        if rest and len(rest) < len(cols):
            out[f"minus_{g}"] = rest
    if low_coverage:
        out["minus_low_coverage"] = [c for c in cols if c not in low_coverage]
    return out


def ablation(train: DataFrame, test: DataFrame, variants: dict[str, Sequence[str]], name: str = "random_forest", **options) -> DataFrame:
    a, b = materialize(train), materialize(test)
    out = None
    for v, cols in variants.items():
        one = score(fit_model(name, a, cols, **options), b, [F.lit(v).alias("variant"), "id", "y"])
        out = one if out is None else out.unionByName(one)
    return group_metrics(out, ["variant"])


def learning_curve(df: DataFrame, name: str, cols: Sequence[str], fractions: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), group: str = "entity", k: int = 4, seed: int = SEED, **options) -> DataFrame:
    """Out-of-fold quality for growing shares of the training rows (nested by hash order)."""
    t = with_pair_uniform(df.join(group_folds(df, group, k), group), "_u", F.lit(9), F.col("id"), seed)
    t = materialize(t)
    out = None
    for f in fractions:
        one = out_of_fold(t, lambda tr, f=f: fit_model(name, tr.where(F.col("_u") < f), cols, **options), ["id"]).withColumn("fraction", F.lit(float(f)))
        out = one if out is None else out.unionByName(one)
    return group_metrics(out, ["fraction"])


