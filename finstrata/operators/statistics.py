"""Descriptive statistics, association, correlation, drift, missingness.

Quantiles, ranks, AUC, KS and PSI all start from one row per distinct (feature, value), so that no feature's values are
gathered in one task however many rows there are. Tables with one row per feature are bounded by the columns of the input: they are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import MIN_PAIRS
from ..functions.ordered import at_least_quantile, bucket_count, quantile_agg, quantile_columns, running_totals, with_position
from ..functions.tails import chi2_one_df, student_two_sided, two_sample_ks_p
from ..session import ship
from ..sources.landing import land


def normalized_entropy(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Shannon entropy of ``key`` within each group over its maximum."""
    c = df.groupBy(*by, key).agg(F.count(F.lit(1)).cast("double").alias("c"))
    # sum p log p from sums of c and c log c, so each group needs one partial aggregate only
    t, cl = F.sum("c"), F.sum(F.col("c") * F.log2("c"))
    bits = F.log2(t) - cl / t
    k = F.count(F.lit(1))
    return c.groupBy(*by).agg(F.when(k > 1, bits / F.log2(k.cast("double"))).otherwise(0.0).alias("e"))


def bh_of_result(df: DataFrame, p: str, tie: str, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg over a result table with one row per column of the data (tens of rows): a plain window."""
    by_p = W.orderBy(F.col(p).asc_nulls_last(), tie)
    back = W.orderBy("_rk").rowsBetween(0, W.unboundedFollowing)
    t = df.withColumn("_rk", F.row_number().over(by_p)).withColumn("_m", F.count(p).over(W.partitionBy()))
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rk")).over(back))
    return t.withColumn(out, F.when(F.col(p).isNotNull(), q)).drop("_rk", "_m")


def benjamini_hochberg(df: DataFrame, p: str, tie: str, out: str = "q") -> DataFrame:
    """q = running minimum of p*m/rank from the largest p down; missing p stays missing.

    Ranks are positions over all tests: computed with running totals per distinct p. The running minimum is taken per
    bucket of ranks and completed with the minimum over later buckets, so the table of tests can be large.
    """
    known = df.where(F.col(p).isNotNull())
    counts = known.groupBy(p).agg(F.count(F.lit(1)).alias("n"))
    t = running_totals(counts, p, ["n"])
    # among equal p values the highest rank gives the smallest p*m/rank, and the running minimum spreads it to all
    t = t.select(p, F.least(F.lit(1.0), F.col(p) * F.col("n_tot") / F.col("n_cum")).alias("_v"), F.col("n_cum").alias("_r"), F.col("n_tot").alias("_m"))
    t = t.withColumn("_b", F.floor(F.col("_r") * bucket_count(df) / F.col("_m")))
    later = W.orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    tail = t.groupBy("_b").agg(F.min("_v").alias("_bm")).select("_b", F.min("_bm").over(later).alias("_tail"))
    own = W.partitionBy("_b").orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0)
    q = t.withColumn("_q", F.min("_v").over(own)).join(tail, "_b").select(p, F.least("_q", F.coalesce("_tail", F.lit(1.0))).alias(out))
    return df.join(q, p, "left").select(*df.columns, out)


# ---- per-column profile -----------------------------------------------------------------------------

def _landed_counts(counts: DataFrame) -> DataFrame:
    """One row per distinct value, written once: bounds, bucket totals, ordered values and bins then read it, not the rows it was counted from."""
    return land(counts, "value-counts")


def column_profile(long: DataFrame, key: str = "feature", value: str = "value") -> DataFrame:
    """Size, missing, distinct, spread, tails and outliers of every column of a long (key, value) table.

    Skewness and kurtosis are bias-corrected (Spark's are the population ones).
    """
    known = long.where(F.col(value).isNotNull())
    m = long.groupBy(key).agg(  # aggregates skip NULL, so one pass gives size and moments
        F.count(F.lit(1)).alias("n"), F.count(value).alias("m"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"),
        F.sum((F.col(value) == 0).cast("int")).alias("n_zero"), F.sum((F.col(value) < 0).cast("int")).alias("n_neg"))
    counts = _landed_counts(known.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")))
    # distinct count, top share and all quantiles in one pass over the ordered distinct values
    q = running_totals(counts, value, ["n"], [key], few=True).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("top_n"),
        *[quantile_agg(p, value).alias(a) for a, p in {"p1": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}.items()])
    # outliers need the quartiles, so they are a second look at the distinct values, not at the rows
    stats = land(m.join(q, key, "left"), "profile-stats")  # a row per column
    iqr = F.col("q3") - F.col("q1")
    fence = stats.select(key, "mean", "std", (F.col("q1") - 1.5 * iqr).alias("lo"), (F.col("q3") + 1.5 * iqr).alias("hi"))
    v = F.col(value)
    out = counts.join(F.broadcast(fence), key).groupBy(key).agg(
        F.sum(F.when((v < F.col("lo")) | (v > F.col("hi")), F.col("n")).otherwise(0)).alias("iqr_outlier_n"),
        F.sum(F.when((F.col("std") > 0) & (F.abs(v - F.col("mean")) / F.col("std") > 3.0), F.col("n")).otherwise(0)).alias("z3_n"))
    k = F.col("m").cast("double")
    spread = F.col("std") > 0
    return stats.join(out, key, "left").select(
        key, "n", (F.col("n") - F.col("m")).alias("n_missing"), (100.0 * (F.col("n") - F.col("m")) / F.col("n")).alias("missing_pct"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        (F.col("n_unique") == 1).cast("int").alias("is_constant"),
        ((F.col("n_unique") > 1) & (F.col("top_n") / k >= 0.95)).cast("int").alias("is_near_constant"),
        F.round(F.col("top_n") / k, 4).alias("top_value_share"), "mean", F.coalesce("std", F.when(k == 1, 0.0)).alias("std"),
        "min", "p1", "q1", "median", "q3", "p99", "max",
        F.when((k >= 3) & spread, F.col("g1") * F.sqrt(k * (k - 1)) / (k - 2)).alias("skew"),
        F.when((k >= 4) & spread, ((k + 1) * F.col("g2") + 6) * (k - 1) / ((k - 2) * (k - 3))).alias("kurtosis_excess"),
        (100.0 * F.col("n_zero") / k).alias("zero_pct"), (100.0 * F.col("n_neg") / k).alias("negative_pct"),
        "iqr_outlier_n", (100.0 * F.col("iqr_outlier_n") / k).alias("iqr_outlier_pct"), (100.0 * F.col("z3_n") / k).alias("z3_outlier_pct"))


def quality_flags(profile: DataFrame, key: str = "feature") -> DataFrame:
    """(flag, feature) rows."""
    flags = {
        "constant": F.col("is_constant") == 1, "near_constant": F.col("is_near_constant") == 1, "missing_gt_20pct": F.col("missing_pct") > 20,
        "heavy_tail": (F.abs(F.coalesce("skew", F.lit(0.0))) > 5) | (F.coalesce("kurtosis_excess", F.lit(0.0)) > 20),
        "many_outliers": F.coalesce("iqr_outlier_pct", F.lit(0.0)) > 5,
    }
    hit = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    return profile.select(key, F.explode(hit).alias("flag"))


# ---- association with a label -----------------------------------------------------------------------

def target_association(long: DataFrame, key: str = "feature", value: str = "value", y: str = "y", min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Per feature: AUC, rank-biserial effect, direction, point-biserial r with p and q, lift of the top decile."""
    known = long.where(F.col(value).isNotNull())
    counts = _landed_counts(known.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos")))
    t = running_totals(counts, value, ["n", "n_pos"], [key], few=True)
    neg = F.col("n") - F.col("n_pos")
    below = (F.col("n_cum") - F.col("n_pos_cum")) - neg
    top = at_least_quantile(0.9)
    auc = t.groupBy(key).agg(
        F.try_divide(F.sum(F.col("n_pos").cast("double") * (below + neg / 2.0)),
                     F.max("n_pos_tot").cast("double") * (F.max("n_tot") - F.max("n_pos_tot"))).alias("auc"),
        (F.sum(F.when(top, F.col("n_pos"))) / F.sum(F.when(top, F.col("n")))).alias("_top"))
    r = known.groupBy(key).agg(F.count(F.lit(1)).alias("n_pairs"), F.corr(value, y).alias("r"), F.avg(y).alias("base"), F.stddev_samp(value).alias("_sd"))
    j = r.join(auc, key, "left")
    ok = (F.col("n_pairs") >= min_pairs) & (F.col("_sd") > 0) & (F.col("base") > 0) & (F.col("base") < 1)
    df = F.col("n_pairs") - 2.0
    j = j.select(
        key, "n_pairs", F.when(ok, F.col("auc")).alias("auc"), F.when(ok, 2 * F.col("auc") - 1).alias("effect"),
        F.when(ok, F.when(F.col("auc") > 0.5, "high").otherwise("low")).alias("direction"), F.when(ok, F.col("r")).alias("r"),
        F.when(ok, F.col("_top") / F.col("base")).alias("lift_top_decile"),
        F.when(ok, F.col("r") * F.sqrt(df / (1.0 - F.col("r") * F.col("r")))).alias("t"), df.alias("dof"))
    j = j.withColumn("p_value", student_two_sided(F.col("t"), F.col("dof").cast("double"))).drop("dof")
    return bh_of_result(j, "p_value", key, "q_value")


def mutual_information(long: DataFrame, bins: int = 20, key: str = "feature", value: str = "value", y: str = "y") -> DataFrame:
    """Plug-in mutual information (nats) with the label over quantile bins; a binned estimator, not a kNN one."""
    known = long.where(F.col(value).isNotNull())
    counts = _landed_counts(known.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_pos")))
    t = running_totals(counts, value, ["n"], [key], few=True)
    b = F.least(F.lit(bins - 1), F.floor((F.col("n_cum") - F.col("n")) * bins / F.col("n_tot")))
    cells = land(t.groupBy(key, b.alias("b")).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("p")), "bins")  # ``bins`` rows per column
    tot = cells.groupBy(key).agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    j = cells.join(tot, key)
    term = lambda c, m: F.when(c > 0, c / F.col("all_n") * F.ln(c * F.col("all_n") / (F.col("n") * m))).otherwise(0.0)
    p, q = F.col("p").cast("double"), (F.col("n") - F.col("p")).cast("double")
    return j.groupBy(key).agg(F.sum(term(p, F.col("all_p")) + term(q, F.col("all_n") - F.col("all_p"))).alias("mi"))


# ---- correlation --------------------------------------------------------------------------------------

def _pairs(arrays: DataFrame, names: Sequence[str], arr: str = "v") -> DataFrame:
    """(i, j, a, b) of every pair of columns, generated per row and folded by a partial aggregate at once."""
    ij = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(len(names)) for j in range(i + 1, len(names))])
    t = arrays.select(F.col(arr), F.explode(ij).alias("ij"))
    a, b = F.get(F.col(arr), F.col("ij.i")), F.get(F.col(arr), F.col("ij.j"))
    return t.select("ij.i", "ij.j", a.alias("a"), b.alias("b")).where("a is not null and b is not null")


def _named(pairs: DataFrame, names: Sequence[str]) -> DataFrame:
    lit = F.array(*[F.lit(n) for n in names])
    return pairs.withColumn("a", F.get(lit, F.col("i"))).withColumn("b", F.get(lit, F.col("j"))).drop("i", "j")


def _correlate(arrays: DataFrame, k: int, min_pairs: int, arr: str = "v") -> DataFrame:
    """(i, j, n, r) of every pair of columns of an array column, over rows where both are known.

    Columns are centred and scaled first, from one aggregate; then each Arrow batch is two matrices, values with 0 for missing and a 0/1 mask,
    and all sums that a correlation needs are products of them. A task returns one row per pair, whatever its rows.
    """
    ship(arrays.sparkSession)
    one = lambda fn: F.array(*[fn(F.get(F.col(arr), F.lit(i))) for i in range(k)])
    scale = arrays.agg(one(F.avg).alias("m"), one(F.stddev_pop).alias("s")).first()
    mean = np.array([x if x is not None else 0.0 for x in scale["m"]])
    sd = np.array([x if x else 1.0 for x in scale["s"]])
    i, j = np.triu_indices(k, 1)
    names = ["n", "sa", "sb", "saa", "sbb", "sab"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(i)))
        for batch in batches:
            flat = batch[arr].flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
            known = ~np.isnan(x)
            m, z = known.astype(float), np.where(known, (x - mean) / sd, 0.0)
            by_other, squares = z.T @ m, (z * z).T @ m
            total += np.stack([(m.T @ m)[i, j], by_other[i, j], by_other[j, i], squares[i, j], squares[j, i], (z.T @ z)[i, j]])
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, total)], names=["i", "j", *names])

    parts = arrays.select(arr).mapInArrow(sums, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    g = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    spread = lambda x: F.col("n") * F.col(f"s{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}")
    varies = lambda x: spread(x) > 1e-12 * F.col("n") * F.greatest(F.col(f"s{x}{x}"), F.lit(1e-12))  # noqa: E731  rounding is not variation
    r = (F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(spread("a") * spread("b"))
    ok = (F.col("n") >= min_pairs) & varies("a") & varies("b")
    return g.where("n > 0").select("i", "j", F.col("n").cast("bigint").alias("n"), F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def pearson(df: DataFrame, names: Sequence[str], min_pairs: int = MIN_PAIRS) -> DataFrame:
    """(a, b, n, r) over rows where both columns are known."""
    arrays = df.select(F.array(*[F.col(n).cast("double") for n in names]).alias("v"))
    return _named(_correlate(arrays, len(names), min_pairs), names)


def rank_arrays(df: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Each column replaced by its mid-ranks over its own known rows, as one array per row."""
    order = F.array(*[F.lit(n) for n in names])
    long = df.unpivot([F.col(i) for i in ids], [F.col(n).cast("double").alias(n) for n in names], "_f", "_v").where("_v is not null")
    counts = long.groupBy("_f", "_v").agg(F.count(F.lit(1)).alias("n"))
    t = running_totals(counts, "_v", ["n"], ["_f"], few=True).select("_f", "_v", (F.col("n_cum") - (F.col("n") - 1) / 2.0).alias("rank"))
    ranked = long.join(t, ["_f", "_v"])
    cell = F.map_from_entries(F.collect_list(F.struct("_f", "rank")))
    per = ranked.groupBy(*ids).agg(cell.alias("m"))
    return per.select(*ids, F.transform(order, lambda n: F.try_element_at("m", n)).alias("v"))


def spearman(df: DataFrame, ids: Sequence[str], names: Sequence[str], min_pairs: int = MIN_PAIRS) -> DataFrame:
    return _named(_correlate(rank_arrays(df, ids, names), len(names), min_pairs), names)


def correlation_report(p: DataFrame, s: DataFrame, limit: int = 20) -> DataFrame:
    """Strongest pairs first: a top-k report with both coefficients."""
    j = p.select("a", "b", F.col("r").alias("pearson")).join(s.select("a", "b", F.col("r").alias("spearman")), ["a", "b"])
    j = j.where("pearson is not null").withColumn("abs_r", F.round(F.abs("pearson"), 4))
    return j.orderBy(F.col("abs_r").desc(), "a", "b").limit(limit)


def outlier_driven(p: DataFrame, s: DataFrame, gap: float = 0.3) -> DataFrame:
    j = p.select("a", "b", F.col("r").alias("pearson")).join(s.select("a", "b", F.col("r").alias("spearman")), ["a", "b"])
    return j.withColumn("gap", F.abs(F.col("pearson") - F.col("spearman"))).where(F.col("gap") > gap)


def correlation_clusters(p: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Connected columns over |r| >= threshold. The graph has one node per column (at most k(k-1)/2 edges, whatever
    the number of rows), so its edges are read to the driver and merged there."""
    edges = [(r["a"], r["b"]) for r in p.where(F.abs("r") >= threshold).select("a", "b").collect()]
    groups: list[set[str]] = []
    for a, b in edges:
        touching = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in touching] + [set().union({a, b}, *touching)]
    rows = [(min(g), n, len(g)) for g in groups for n in sorted(g)]
    return p.sparkSession.createDataFrame(rows, "cluster string, feature string, size long")


def median_fill(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Missing values of every column replaced by its median (0 when nothing is known)."""
    long = df.unpivot([], [F.col(n).cast("double").alias(n) for n in names], "feature", "value")
    med = quantile_columns(long, "value", {"median": 0.5}, ["feature"], few=True)
    m = med.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("m")).scalar()
    rest = [c for c in df.columns if c not in names]
    return df.withColumn("_m", m).select(*rest, *[
        F.coalesce(F.col(n).cast("double"), F.try_element_at("_m", F.lit(n)), F.lit(0.0)).alias(n) for n in names])


def correlation_matrix(filled: DataFrame, names: Sequence[str]) -> np.ndarray:
    """k x k Pearson matrix of complete columns. Sums of products per pair are distributed; only k*k numbers return."""
    arrays = filled.select(F.array(*[F.col(n).cast("double") for n in names]).alias("v"))
    out = np.eye(len(names))
    for r in _correlate(arrays, len(names), 2).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["r"] if r["r"] is not None else 0.0
    return out


def effective_dimensionality(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Participation ratio, components for 95 % of variance and top share, from the spectrum of the k x k matrix."""
    filled = land(median_fill(df, names), "filled")  # read three times, and each would compute the medians again
    sd = filled.agg(*[F.stddev_samp(n).alias(n) for n in names]).first()
    corr = correlation_matrix(filled, names)
    for i, n in enumerate(names):
        if not sd[n]:
            corr[i, :] = corr[:, i] = 0.0
    lam = np.clip(np.sort(np.linalg.eigvalsh(corr))[::-1], 0.0, None)
    total = float(lam.sum())
    row = (len(names), None, None, None)
    if total > 0:
        cum = np.cumsum(lam) / total
        row = (len(names), float(total**2 / (lam**2).sum()), int(np.searchsorted(cum, 0.95) + 1), float(100 * lam[0] / total))
    return df.sparkSession.createDataFrame([row], "n_columns long, participation_ratio double, n_components_95 long, top_share_pct double")


def variance_inflation(df: DataFrame, names: Sequence[str], min_known: int = MIN_PAIRS) -> DataFrame:
    """1 / (1 - R^2) of each median-filled column on the others, from the k x k correlation matrix (R^2 capped below 1)."""
    stats = df.agg(*[F.count(n).alias(f"c_{n}") for n in names], *[F.stddev_samp(F.col(n).cast("double")).alias(f"s_{n}") for n in names]).first()
    keep = [n for n in names if stats[f"c_{n}"] >= min_known and (stats[f"s_{n}"] or 0) > 0]
    corr = correlation_matrix(land(median_fill(df.select(*keep), keep), "filled"), keep)
    rows = []
    for i, n in enumerate(keep):
        rest = [j for j in range(len(keep)) if j != i]
        r = corr[rest, i]
        explained = float(r @ np.linalg.pinv(corr[np.ix_(rest, rest)]) @ r) if rest else 0.0
        rows.append((n, 1.0 / max(1e-9, 1.0 - explained)))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


# ---- drift ---------------------------------------------------------------------------------------------

def _drift_core(long: DataFrame, is_ref: str, key: str, value: str, bins: int) -> DataFrame:
    """(key, ks, psi, sizes): one ordered pass over distinct values gives KS and the reference bin edges, a second
    unordered one counts the bins. Bins are open at both ends; PSI is NULL for too few values or edges."""
    known = long.where(F.col(value).isNotNull())
    counts = _landed_counts(known.groupBy(key, value).agg(F.sum(is_ref).alias("n"), F.sum(1 - F.col(is_ref)).alias("w")))
    t = running_totals(counts, value, ["n", "w"], [key], few=True)
    share = lambda c: F.try_divide(F.col(f"{c}_cum").cast("double"), F.col(f"{c}_tot"))
    edges = F.array_sort(F.array_distinct(F.array_compact(F.array(*[quantile_agg(i / bins, value) for i in range(bins + 1)]))))
    core = t.groupBy(key).agg(F.max(F.abs(share("n") - share("w"))).alias("ks"), F.max("n_tot").alias("n_r"), F.max("w_tot").alias("n_c"), edges.alias("e"))
    core = land(core, "drift-edges")  # a row per column
    cells = counts.join(F.broadcast(core.where(F.size("e") >= 3).select(key, "n_r", "n_c", F.slice("e", 2, F.size("e") - 2).alias("_inner"))), key)
    # bin k holds edges[k] <= v < edges[k+1]
    cells = with_position(cells, "b", F.col(value), "_inner", bins - 1, strict=False).groupBy(key, "b").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("n_r").alias("n_r"), F.max("n_c").alias("n_c"))
    eps = F.lit(1e-6)
    r, c = F.greatest(F.col("n") / F.col("n_r"), eps), F.greatest(F.col("w") / F.col("n_c"), eps)
    # a bin without rows on either side contributes nothing: both shares are eps
    s = cells.groupBy(key).agg(F.sum((c - r) * F.ln(c / r)).alias("_psi"))
    enough = (F.col("n_r") >= bins) & (F.col("n_c") >= bins)
    return core.join(s, key, "left").select(key, "ks", F.when(enough, F.col("_psi")).alias("psi"))


def psi(long: DataFrame, is_ref: str = "is_ref", key: str = "feature", value: str = "value", bins: int = 10) -> DataFrame:
    """Population stability on reference quantile bins."""
    return _drift_core(long, is_ref, key, value, bins).select(key, "psi")


def drift_table(long: DataFrame, is_ref: str = "is_ref", key: str = "feature", value: str = "value", exact_up_to: int = 10_000) -> DataFrame:
    """Two-sample KS with its p, standardized mean difference, PSI, BH q and drift flag per feature. The p-value is exact while neither sample
    holds more than ``exact_up_to`` rows, asymptotic beyond (0: always)."""
    known = long.where(F.col(value).isNotNull())
    at = lambda fn, v: fn(F.when(F.col(is_ref) == v, F.col(value)))
    m = known.groupBy(key).agg(
        at(F.count, 1).alias("n_ref"), at(F.count, 0).alias("n_new"), at(F.avg, 1).alias("mean_ref"), at(F.avg, 0).alias("mean_new"),
        at(F.var_samp, 1).alias("_v1"), at(F.var_samp, 0).alias("_v0"))
    j = m.join(_drift_core(long, is_ref, key, value, 10), key, "left")
    ok = (F.col("n_ref") >= 3) & (F.col("n_new") >= 3)
    sd = F.sqrt((F.col("_v1") + F.col("_v0")) / 2.0)
    j = j.select(key, "n_ref", "n_new", "mean_ref", "mean_new", F.when(ok, F.col("ks")).alias("ks"),
                 two_sample_ks_p(F.when(ok, F.col("ks")), F.col("n_ref"), F.col("n_new"), exact_up_to).alias("ks_p"),
                 F.when(ok & (sd > 0), (F.col("mean_new") - F.col("mean_ref")) / sd).alias("smd"), F.when(ok, F.col("psi")).alias("psi"))
    j = bh_of_result(j, "ks_p", key, "q_value")
    hit = (F.coalesce("ks", F.lit(0.0)) >= 0.30) | (F.abs(F.coalesce("smd", F.lit(0.0))) >= 0.50)
    return j.withColumn("drifted", hit.cast("int"))


# ---- missingness -----------------------------------------------------------------------------------------

def missing_by_split(df: DataFrame, names: Sequence[str], split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(*[(100.0 * (F.count(F.lit(1)) - F.count(n)) / F.count(F.lit(1))).alias(n) for n in names]).unpivot(
        [split], list(names), "feature", "missing_pct")


def missing_informativeness(long: DataFrame, key: str = "feature", value: str = "value", y: str = "y", floor: int = 5) -> DataFrame:
    """Label rate when missing against present, chi-square with continuity correction, BH q."""
    miss = F.col(value).isNull()
    n = lambda c: F.sum(c.cast("bigint"))
    t = long.groupBy(key).agg(n(miss & (F.col(y) == 1)).alias("a"), n(miss & (F.col(y) == 0)).alias("b"),
                              n(~miss & (F.col(y) == 1)).alias("c"), n(~miss & (F.col(y) == 0)).alias("d"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    tot = a + b + c + d
    diff = F.abs(a * d - b * c)
    # the correction moves every cell by at most a half, and never past its expected value
    num = F.pow(diff - F.least(diff, tot / 2.0), 2.0) * tot
    chi = F.try_divide(num, (a + b) * (c + d) * (a + c) * (b + d))
    ok = (a + b >= floor) & (c + d >= floor)
    r = t.select(key, (F.col("a") + F.col("b")).alias("n_missing"), (F.col("c") + F.col("d")).alias("n_present"),
                 F.when(ok, 100.0 * a / (a + b)).alias("rate_missing_pct"), F.when(ok, 100.0 * c / (c + d)).alias("rate_present_pct"),
                 F.when(ok, F.coalesce(chi, F.lit(0.0))).alias("chi2"))
    r = r.withColumn("delta_pct", F.col("rate_missing_pct") - F.col("rate_present_pct")).withColumn("p_value", chi2_one_df(F.col("chi2")))
    return bh_of_result(r, "p_value", key, "q_value")


def co_missing(df: DataFrame, names: Sequence[str], limit: int = 15) -> DataFrame:
    """Pairs of columns missing together: overlap and Jaccard, largest first (a top-k report)."""
    arr = df.select(F.array(*[F.col(n).isNull().cast("int") for n in names]).alias("v"))
    g = _pairs(arr, names).where("a = 1 or b = 1").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("n_both"), F.count(F.lit(1)).alias("n_union"))
    g = _named(g.where("n_both > 0"), names).select("a", "b", "n_both", (F.col("n_both") / F.col("n_union")).alias("jaccard"))
    return g.orderBy(F.col("n_both").desc(), "a", "b").limit(limit)


def missing_patterns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns that are missing in exactly the same rows: two columns match when their union equals their overlap."""
    arr = df.select(F.array(*[F.col(n).isNull().cast("int") for n in names]).alias("v"))
    g = _pairs(arr, names).groupBy("i", "j").agg(F.sum((F.col("a") != F.col("b")).cast("int")).alias("n_diff"))
    return _named(g.where("n_diff = 0"), names).select("a", "b")


def missing_density(df: DataFrame, names: Sequence[str]) -> DataFrame:
    k = sum((F.col(n).isNull().cast("int") for n in names[1:]), F.col(names[0]).isNull().cast("int"))
    return df.select(k.alias("k")).agg(F.avg("k").alias("mean_missing"), F.max("k").alias("max_missing"),
                                       F.avg((F.col("k") > 0.5 * len(names)).cast("double")).alias("share_gt_half"))


# ---- findings --------------------------------------------------------------------------------------------

def findings(tables: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """Threshold rules over result tables: finding name -> (table, condition, key); emits what fired."""
    out = None
    for name, (df, cond, key) in tables.items():
        one = df.where(cond).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(key.cast("string"))), ",").alias("items"))
        one = one.select(F.lit(name).alias("finding"), "n", "items")
        out = one if out is None else out.unionByName(one)
    return out


def system_agreement(scores: DataFrame, systems: Sequence[str], ids: Sequence[str] = ("row_id",)) -> DataFrame:
    """Spearman correlation of every pair of systems over common rows; ``scores`` is (ids, system, p)."""
    wide = scores.groupBy(*ids).agg(*[F.max(F.when(F.col("system") == s, F.col("p"))).alias(s) for s in systems])
    return spearman(wide, ids, systems)


def ranking_agreement(a: DataFrame, b: DataFrame, key: str = "feature", value: str = "value", top: int = 15) -> DataFrame:
    """Spearman of two rankings and the Jaccard of their leading items (tables with one row per feature)."""
    j = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key)
    r = spearman(j, [key], ["va", "vb"], min_pairs=2).select(F.col("r").alias("spearman"))
    lead = lambda c: j.orderBy(F.col(c).desc(), key).limit(top).select(F.col(key).alias("item"))
    hits = lead("va").unionByName(lead("vb")).groupBy("item").agg(F.count(F.lit(1)).alias("k"))
    share = hits.agg((F.sum((F.col("k") == 2).cast("int")) / F.count(F.lit(1))).alias("top_jaccard"))
    return r.select("spearman", share.scalar().alias("top_jaccard"))
