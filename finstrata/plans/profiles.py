"""Queries F4-F9, G4-G14, H*, I*: balance, profiles, joins by shape, set operations, label sequences."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..constants import FEATURES, FEATURE_GROUPS
from ..functions.panel import entity_rows, rows_so_far
from ..functions.scalars import finite
from ..operators import features as X
from ..operators import metrics as M
from ..operators import profiles as P
from ..operators import samples as S
from ..operators import statistics as K
from . import samples  # noqa: F401  (names views that the SQL here reads)
from .features import WE, samples2
from .registry import query
from .views import SQL, panel, scores, scores_long


def _balance(n, p, key=""):
    q = f"({n} - {p})"
    lo = f"least({p}, {q})"
    ent = f"(0e0 - CASE WHEN {p} > 0 THEN {p} / CAST({n} AS DOUBLE) * log2({p} / CAST({n} AS DOUBLE)) ELSE 0 END - CASE WHEN {q} > 0 THEN {q} / CAST({n} AS DOUBLE) * log2({q} / CAST({n} AS DOUBLE)) ELSE 0 END)"
    pct = f"1e2 * {lo} / {n}"
    return f"""{n} AS n, CAST({p} AS BIGINT) AS positive, CAST({q} AS BIGINT) AS negative, round(1e2 * {p} / {n}, 6) AS positive_pct, CAST(CASE WHEN {p} >= {q} THEN 0 ELSE 1 END AS BIGINT) AS minority_class,
  round({pct}, 6) AS minority_pct, round(greatest({p}, {q}) / nullif(CAST({lo} AS DOUBLE), 0), 6) AS imbalance_ratio,
  CASE WHEN {lo} = 0 THEN 'single_class' WHEN {pct} >= 40 THEN 'balanced' WHEN {pct} >= 20 THEN 'slightly_imbalanced' ELSE 'severely_imbalanced' END AS level,
  round({ent}, 6) AS entropy_bits, round(CASE WHEN {lo} > 0 THEN {ent} ELSE 0e0 END, 6) AS entropy_normalized,
  round(1 - pow({p} / CAST({n} AS DOUBLE), 2) - pow({q} / CAST({n} AS DOUBLE), 2), 6) AS gini, round(1e2 * greatest({p}, {q}) / {n}, 6) AS majority_baseline_pct"""


_B = _balance("n", "p")


@query("h1_class_balance", f"SELECT split, {_B} FROM (SELECT split, count(*) AS n, sum(is_distressed) AS p FROM f_split GROUP BY split)", ["f_split"])
def h1(spark, sf):
    return P.class_balance(samples2(spark, sf), "is_distressed", ["split"])


@query("h2_label_distribution", f"SELECT {_B} FROM (SELECT count(*) AS n, sum(is_distressed) AS p FROM f_split)", ["f_split"])
def h2(spark, sf):
    return P.class_balance(samples2(spark, sf), "is_distressed")


_CNT = "SELECT entity, CAST(count(*) AS DOUBLE) AS n, CAST(sum(is_distressed) AS DOUBLE) AS p FROM f_split GROUP BY entity"


def _counts(spark, sf):
    c = samples2(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("is_distressed").alias("p"))
    return c.withColumn("q", F.col("n") - F.col("p"))


@query("h3_entropy_bits", f"SELECT entity, round(0e0 - CASE WHEN p > 0 THEN p/n*log2(p/n) ELSE 0 END - CASE WHEN n > p THEN (n-p)/n*log2((n-p)/n) ELSE 0 END, 6) AS bits FROM ({_CNT})", ["f_split"])
def h3(spark, sf):
    return _counts(spark, sf).select("entity", P.entropy_bits([F.col("p"), F.col("q")]).alias("bits"))


@query("h4_normalized_entropy", "SELECT fiscal_year, round(sum(-c/t*log2(c/t)) / CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 1 END, 6) + 0 AS e FROM (SELECT CAST(target_fiscal_year AS BIGINT) AS fiscal_year, target_fiscal_quarter, CAST(count(*) AS DOUBLE) AS c, sum(count(*)) OVER (PARTITION BY target_fiscal_year) AS t FROM f_split GROUP BY target_fiscal_year, target_fiscal_quarter) GROUP BY 1".replace("-c/t", "-1e0*c/t"), ["f_split"])
def h4(spark, sf):
    return K.normalized_entropy(samples2(spark, sf).withColumnRenamed("target_fiscal_year", "fiscal_year").select("fiscal_year", "target_fiscal_quarter"), ["fiscal_year"], "target_fiscal_quarter")


@query("h5_gini_impurity", f"SELECT entity, round(1 - pow(p/n, 2) - pow((n-p)/n, 2), 6) AS gini FROM ({_CNT})", ["f_split"])
def h5(spark, sf):
    return _counts(spark, sf).select("entity", P.gini([F.col("p"), F.col("q")]).alias("gini"))


@query("h6_imbalance_ratio", f"SELECT entity, round(greatest(p, n-p) / nullif(least(p, n-p), 0), 6) AS ir, round((n-p) / nullif(p, 0), 6) AS neg_per_pos FROM ({_CNT})", ["f_split"])
def h6(spark, sf):
    c = _counts(spark, sf)
    return c.select("entity", P.imbalance_ratio(F.col("p"), F.col("q")).alias("ir"), F.try_divide(F.col("q").cast("double"), F.col("p")).alias("neg_per_pos"))


@query("h7_effective_number", "SELECT split, round(pow(sum(c), 2) / sum(c * c), 6) AS effective_n, count(*) AS n_groups FROM (SELECT split, entity, CAST(count(*) AS DOUBLE) AS c FROM f_split GROUP BY 1, 2) GROUP BY split", ["f_split"])
def h7(spark, sf):
    return P.effective_number(samples2(spark, sf), "entity", ["split"])


@query("h8_imbalance_level", f"SELECT level, count(*) AS n FROM (SELECT {_B} FROM (SELECT entity, count(*) AS n, sum(is_distressed) AS p FROM f_split GROUP BY entity)) GROUP BY level", ["f_split"])
def h8(spark, sf):
    return P.class_balance(samples2(spark, sf), "is_distressed", ["entity"]).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("h9_multi_axis_profile", f"""SELECT axis, key, {_B} FROM (SELECT CASE WHEN grouping(split) = 0 THEN 'split' WHEN grouping(entity) = 0 THEN 'entity' WHEN grouping(year) = 0 THEN 'year' WHEN grouping(quarter) = 0 THEN 'quarter' ELSE 'overall' END AS axis,
  coalesce(split, CAST(entity AS VARCHAR), CAST(year AS VARCHAR), quarter, 'all') AS key, count(*) AS n, sum(is_distressed) AS p FROM (SELECT *, year(target_period_end) AS year, concat('Q', quarter(target_period_end)) AS quarter FROM f_split)
  GROUP BY GROUPING SETS ((split), (entity), (year), (quarter), ()))""", ["f_split"])
def h9(spark, sf):
    s = samples2(spark, sf).select("split", "entity", F.year("target_period_end").alias("year"),
                                   F.concat(F.lit("Q"), F.quarter("target_period_end")).alias("quarter"), "is_distressed")
    return P.label_profile(s, ["split", "entity", "year", "quarter"])


@query("h10_label_shares", "SELECT entity, count(*) AS n, round(avg(is_distressed), 6) AS share, CASE WHEN avg(is_distressed) = 1 THEN 'all_one' WHEN avg(is_distressed) = 0 THEN 'all_zero' ELSE 'mixed' END AS kind FROM f_split GROUP BY entity", ["f_split"])
def h10(spark, sf):
    return P.label_shares(samples2(spark, sf))


PERIODS = [f"{y}Q{q}" for y in range(1993, 1998) for q in range(1, 5)]


@query("h11_label_matrix", "SELECT entity, " + ", ".join(f"CAST(max(CASE WHEN sample_id = concat(entity, '-{p}') THEN is_distressed END) AS BIGINT) AS \"{p}\"" for p in PERIODS) + " FROM f_split GROUP BY entity", ["f_split"])
def h11(spark, sf):
    s = samples2(spark, sf).withColumn("period", F.concat("target_fiscal_year", F.lit("Q"), "target_fiscal_quarter"))
    return P.label_matrix(s, PERIODS)


@query("h12_label_counts_per_split", "SELECT split, count(*) AS total, CAST(sum(is_distressed) AS BIGINT) AS distressed FROM f_split GROUP BY split", ["f_split"])
def h12(spark, sf):
    return samples2(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("total"), F.sum("is_distressed").alias("distressed"))


@query("h13_history_length_stats", "SELECT count(*) AS n, min(n_history) AS min_len, max(n_history) AS max_len, round(quantile_cont(n_history, 5e-1), 6) AS median_len, CAST(sum(CAST(n_history < 5 AS INT)) AS BIGINT) AS n_below, round(avg(CAST(n_history < 5 AS INT)), 6) AS share_below FROM f_split", ["f_split"])
def h13(spark, sf):
    return P.history_length_stats(samples2(spark, sf))


SQL["f_prior"] = (["f_split"], "SELECT entity, avg(is_distressed) AS prior, count(*) AS n_train FROM f_split WHERE split = 'train' GROUP BY entity")


@query("h14_entity_prior", "SELECT entity, round(prior, 6) AS prior, n_train FROM f_prior", ["f_prior"])
def h14(spark, sf):
    return P.entity_prior(samples2(spark, sf))


@query("h15_published_bounds", """SELECT split, max(seen) AS max_published, min(as_of) AS min_as_of FROM (SELECT split, as_of, max(as_of) OVER (PARTITION BY entity ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM f_split) GROUP BY split""", ["f_split"])
def h15(spark, sf):
    return P.published_bounds(samples2(spark, sf).withColumn("available_on", F.col("as_of")))


@query("h16_lab_distribution", f"SELECT {_B} FROM (SELECT count(*) AS n, sum(y) AS p FROM f_vec)", ["f_vec"])
def h16(spark, sf):
    from .views import vectors
    return P.class_balance(vectors(spark, sf), "y")


@query("h17_positive_rate", "SELECT system, round(avg(y), 6) AS rate FROM f_long GROUP BY system", ["f_long"])
def h17(spark, sf):
    return scores_long(spark, sf).groupBy("system").agg(F.avg("y").alias("rate"))


SQL["f_segment"] = (["f_scores"], "SELECT *, CAST(grp % 5 AS BIGINT) AS seg FROM f_scores")


@query("h18_group_stats", """SELECT seg AS segment, count(*) AS n, round(avg(p_a), 6) AS p_a, round(avg(p_b), 6) AS p_b, round(avg(p_a) - (SELECT avg(p_a) FROM f_segment WHERE seg = 0), 6) + 0 AS p_a_delta,
  round(avg(p_b) - (SELECT avg(p_b) FROM f_segment WHERE seg = 0), 6) + 0 AS p_b_delta FROM f_segment GROUP BY seg""", ["f_segment"])
def h18(spark, sf):
    return P.group_stats(scores(spark, sf).withColumn("segment", F.col("grp") % 5), "segment", ["p_a", "p_b"], 0)


@query("h19_method_group_summary", "SELECT CASE WHEN seg < 2 THEN 'weights' ELSE 'sampling' END AS method_group, count(*) AS n, round(avg(p_a), 6) AS mean_a, round(avg(p_b), 6) AS mean_b FROM f_segment GROUP BY 1", ["f_segment"])
def h19(spark, sf):
    g = F.when(F.col("grp") % 5 < 2, "weights").otherwise("sampling")
    return scores(spark, sf).groupBy(g.alias("method_group")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_a").alias("mean_a"), F.avg("p_b").alias("mean_b"))


BOX = ["current_ratio_latest", "debt_to_assets_latest", "net_margin_latest", "ocf_to_sales_latest", "quick_ratio_latest", "cash_to_assets_latest"]


def sample_features(spark, sf, extra=()):
    """Features of every sample with its label, split and id; one pass over the panel."""
    p = S.stress_label(panel(spark, sf), 2)
    nxt = lambda c: F.lead(c).over(entity_rows())
    p = p.select("*", nxt("label").alias("is_distressed"), nxt("period_end").alias("target_period_end"), *[e for e in extra])
    t = X.feature_table(p, ["is_distressed", "target_period_end"]).where(F.col("target_period_end").isNotNull())
    return S.time_split(t)


SQL["f_sf"] = (["f_split", "f_feat"], "SELECT s.sample_id, s.split, s.is_distressed, s.target_period_end, f.* FROM f_split s JOIN f_feat f USING (entity, period_end)")


@query("h20_class_range_overlap", " UNION ALL ".join(
    f"SELECT '{b}' AS feature, round((least(h0, h1) - greatest(l0, l1)) / nullif(greatest(h0, h1) - least(l0, l1), 0), 6) AS overlap FROM (SELECT min(CASE WHEN is_distressed = 0 THEN {b} END) AS l0, max(CASE WHEN is_distressed = 0 THEN {b} END) AS h0, min(CASE WHEN is_distressed = 1 THEN {b} END) AS l1, max(CASE WHEN is_distressed = 1 THEN {b} END) AS h1 FROM f_sf)" for b in BOX), ["f_sf"])
def h20(spark, sf):
    return P.range_overlap(sample_features(spark, sf), BOX)


@query("h21_labels_in_order", "SELECT entity, string_agg(CAST(is_distressed AS VARCHAR), '' ORDER BY target_period_end) AS labels FROM f_split GROUP BY entity", ["f_split"])
def h21(spark, sf):
    seq = F.array_sort(F.collect_list(F.struct("target_period_end", "is_distressed")))
    return samples2(spark, sf).groupBy("entity").agg(seq.alias("s")).select(
        "entity", F.array_join(F.transform("s", lambda x: x["is_distressed"].cast("string")), "").alias("labels"))


@query("h22_prior_band", "SELECT entity, CASE WHEN prior >= 95e-2 THEN 'leak' WHEN prior <= 1e-1 THEN 'reverse_leak' ELSE 'mixed' END AS band, n_train FROM f_prior", ["f_prior"])
def h22(spark, sf):
    return P.entity_prior(samples2(spark, sf)).select("entity", P.prior_band(F.col("prior")).alias("band"), "n_train")


_SYS = "SELECT system, avg(y) AS rate, avg(p) AS mean_p FROM f_long GROUP BY system"


@query("h23_headline_union", f"SELECT system, 'in_domain' AS source, round(mean_p, 6) AS value FROM ({_SYS}) UNION ALL SELECT concat(system, '_cross'), 'cross_group', round(mean_p, 6) FROM (SELECT system, avg(m) AS mean_p FROM (SELECT system, grp, avg(p) AS m FROM f_long GROUP BY 1, 2) GROUP BY 1)", ["f_long"])
def h23(spark, sf):
    s = scores_long(spark, sf)
    a = s.groupBy("system").agg(F.avg("p").alias("value"))
    b = s.groupBy("system", "grp").agg(F.avg("p").alias("m")).groupBy(F.concat("system", F.lit("_cross")).alias("system")).agg(F.avg("m").alias("value"))
    return P.union_sources({"in_domain": a, "cross_group": b})


@query("h24_systems_without_duplicates", f"SELECT system, 'significance' AS source, round(mean_p, 6) AS value FROM ({_SYS}) WHERE system = 'p_a' UNION ALL SELECT system, 'baselines', round(rate, 6) FROM ({_SYS}) WHERE system <> 'p_a'", ["f_long"])
def h24(spark, sf):
    s = scores_long(spark, sf)
    first = s.where("system = 'p_a'").groupBy("system").agg(F.avg("p").alias("value"))
    return P.union_sources({"significance": first, "baselines": s.groupBy("system").agg(F.avg("y").alias("value"))})


@query("h25_top_k", "SELECT entity, period_end, round(z, 6) AS z FROM f_z WHERE z IS NOT NULL ORDER BY z DESC, entity * 100000 + CAST(period_end - DATE '1990-01-01' AS BIGINT) LIMIT 15", ["f_z"])
def h25(spark, sf):
    from ..functions.scalars import altman_z
    t = panel(spark, sf).select("entity", "period_end", altman_z().alias("z")).withColumn(
        "tie", F.col("entity") * 100000 + F.datediff("period_end", F.lit("1990-01-01").cast("date")))
    return P.top(t, "z", 15, "tie").drop("tie")


SQL["f_tech"] = (["f_segment"], "SELECT concat('t', seg) AS technique, avg(p_a * y) AS pr_auc, avg(p_b * y) AS f1, avg(abs(p_a - p_b)) AS fpr FROM f_segment GROUP BY seg")


def techniques(spark, sf):
    s = scores(spark, sf)
    return s.groupBy(F.concat(F.lit("t"), (F.col("grp") % 5).cast("string")).alias("technique")).agg(
        F.avg(F.col("p_a") * F.col("y")).alias("pr_auc"), F.avg(F.col("p_b") * F.col("y")).alias("f1"), F.avg(F.abs(F.col("p_a") - F.col("p_b"))).alias("fpr"))


@query("h26_ranking_table", "SELECT technique, round(pr_auc, 6) AS pr_auc, row_number() OVER (ORDER BY pr_auc DESC, technique) AS rank, round(pr_auc - (SELECT pr_auc FROM f_tech WHERE technique = 't0'), 6) + 0 AS delta FROM f_tech", ["f_tech"])
def h26(spark, sf):
    return P.ranking_table(techniques(spark, sf), "pr_auc", "technique", "t0")


@query("h27_best_and_worst", " UNION ALL ".join(f"SELECT '{m}' AS metric, max_by(technique, {m}) AS best, round(max({m}), 6) AS best_value, min_by(technique, {m}) AS worst, round(min({m}), 6) AS worst_value FROM f_tech" for m in ("pr_auc", "f1", "fpr")), ["f_tech"])
def h27(spark, sf):
    return P.extremes(techniques(spark, sf), "technique", ["pr_auc", "f1", "fpr"])


@query("h28_model_selection", "SELECT technique, round(pr_auc, 6) AS pr_auc FROM f_tech ORDER BY coalesce(pr_auc, -1) DESC, coalesce(f1, -1) DESC, coalesce(fpr, -1), technique LIMIT 1", ["f_tech"])
def h28(spark, sf):
    return P.select_model(techniques(spark, sf), [("pr_auc", True), ("f1", True), ("fpr", False)], "technique").select("technique", "pr_auc")


@query("h29_pool_of_splits", "SELECT count(*) AS n, CAST(sum(is_distressed) AS BIGINT) AS positives FROM f_split WHERE split IN ('train', 'validation')", ["f_split"])
def h29(spark, sf):
    s = samples2(spark, sf)
    pool = s.where("split = 'train'").unionByName(s.where("split = 'validation'"))
    return pool.agg(F.count(F.lit(1)).alias("n"), F.sum("is_distressed").alias("positives"))


def with_periods(spark, sf):
    p = S.stress_label(panel(spark, sf), 2)
    p = p.withColumn("periods", F.collect_list("period_end").over(rows_so_far())).withColumn("is_distressed", F.lead("label").over(entity_rows()))
    return S.time_split(S.make_samples(p, ["periods", "is_distressed"]))


SQL["f_hist"] = (["f_split", "f_panel"], "SELECT s.split, s.entity, p.period_end AS period FROM f_split s JOIN f_panel p ON p.entity = s.entity AND p.period_end <= s.period_end")


@query("h30_split_overlap", """SELECT (SELECT count(*) FROM (SELECT entity, period FROM f_hist WHERE split = 'train' INTERSECT SELECT entity, period FROM f_hist WHERE split = 'test')) AS n_shared,
  (SELECT count(DISTINCT (entity, period)) FROM f_hist WHERE split = 'test') AS n_test_periods,
  (SELECT count(*) FROM (SELECT entity, target_period_end FROM f_split WHERE split = 'test' INTERSECT SELECT entity, period FROM f_hist WHERE split = 'train')) AS test_targets_in_train,
  (SELECT count(*) FROM (SELECT entity, target_period_end FROM f_split WHERE split = 'train' INTERSECT SELECT entity, period FROM f_hist WHERE split = 'test')) AS train_targets_in_test""", ["f_hist"])
def h30(spark, sf):
    return P.split_overlap(with_periods(spark, sf))


@query("h31_ids_not_derivable", "SELECT sample_id FROM (SELECT sample_id FROM f_samples UNION ALL SELECT replace(sample_id, 'Q4', 'Q5') FROM f_samples WHERE sample_id LIKE '%Q4') EXCEPT SELECT sample_id FROM f_samples", ["f_samples"])
def h31(spark, sf):
    ids = S.make_samples(panel(spark, sf)).select("sample_id")
    stored = ids.unionByName(ids.where(F.col("sample_id").endswith("Q4")).select(F.replace("sample_id", F.lit("Q4"), F.lit("Q5")).alias("sample_id")))
    return stored.exceptAll(ids).distinct()


DUP = ["gross_margin_latest", "distress_quarters_in_window", "negative_ni_streak"]


@query("h32_duplicate_feature_rows", """SELECT CAST(sum(r) AS BIGINT) AS n_ref_rows, CAST(sum(w) AS BIGINT) AS n_new_rows, CAST(sum(CASE WHEN r > 0 THEN w ELSE 0 END) AS BIGINT) AS n_new_in_ref,
  CAST(sum(greatest(r - 1, 0)) AS BIGINT) AS dup_in_ref, CAST(sum(greatest(w - 1, 0)) AS BIGINT) AS dup_in_new FROM (SELECT count(CASE WHEN split = 'train' THEN 1 END) AS r, count(CASE WHEN split = 'test' THEN 1 END) AS w
  FROM f_sf WHERE split IN ('train', 'test') GROUP BY round(gross_margin_latest, 1), round(distress_quarters_in_window, 1), round(negative_ni_streak, 1))""", ["f_sf"])
def h32(spark, sf):
    t = sample_features(spark, sf).select("split", *[F.round(c, 1).alias(c) for c in DUP])
    return P.duplicate_rows(t, DUP)


@query("h33_row_keys", "SELECT count(DISTINCT (round(gross_margin_latest, 6), round(distress_quarters_in_window, 6), round(negative_ni_streak, 6))) AS n_keys, count(*) AS n FROM f_sf", ["f_sf"])
def h33(spark, sf):
    return sample_features(spark, sf).agg(F.countDistinct(P.row_key(DUP)).alias("n_keys"), F.count(F.lit(1)).alias("n"))


@query("h34_balance_identity", """SELECT count(*) AS n, CAST(sum(CAST(rel > 5e-3 AS INT)) AS BIGINT) AS n_off, round(max(rel), 6) AS worst FROM (SELECT abs(liabilities - (total_assets - stockholders_equity)) / nullif(CAST(abs(total_assets) AS DOUBLE), 0) AS rel
  FROM (SELECT * REPLACE (CASE WHEN entity % 5 = 0 AND fiscal_quarter = 4 THEN liabilities + liabilities // 10 ELSE liabilities END AS liabilities) FROM f_panel) WHERE liabilities IS NOT NULL)""", ["f_panel"])
def h34(spark, sf):
    p = panel(spark, sf).withColumn("liabilities", F.when((F.col("entity") % 5 == 0) & (F.col("fiscal_quarter") == 4),
                                                          F.col("liabilities") + F.expr("liabilities div 10")).otherwise(F.col("liabilities")))
    return P.balance_identity(p)


@query("h35_speedup_vs_baseline", "SELECT technique, round(fpr / (SELECT fpr FROM f_tech WHERE technique = 't0'), 6) AS speedup FROM f_tech", ["f_tech"])
def h35(spark, sf):
    t = techniques(spark, sf)
    return t.select("technique", (F.col("fpr") / t.where("technique = 't0'").select("fpr").scalar()).alias("speedup"))


@query("h36_technique_deltas", "SELECT round(max(CASE WHEN technique = 't1' THEN pr_auc END) - max(CASE WHEN technique = 't2' THEN pr_auc END), 6) AS pr_auc_delta, round(max(CASE WHEN technique = 't1' THEN f1 END) - max(CASE WHEN technique = 't2' THEN f1 END), 6) AS f1_delta FROM f_tech", ["f_tech"])
def h36(spark, sf):
    t = techniques(spark, sf)
    at = lambda k, c: F.max(F.when(F.col("technique") == k, F.col(c)))
    return t.agg(*[(at("t1", c) - at("t2", c)).alias(f"{c}_delta") for c in ("pr_auc", "f1")])


@query("h37_hybrid_vs_best_parent", "SELECT 't4' AS child, max_by(technique, pr_auc) AS best_parent, round((SELECT pr_auc FROM f_tech WHERE technique = 't4') - max(pr_auc), 6) AS delta FROM f_tech WHERE technique IN ('t1', 't2', 't3')", ["f_tech"])
def h37(spark, sf):
    t = techniques(spark, sf)
    parents = t.where(F.col("technique").isin("t1", "t2", "t3"))
    child = t.where("technique = 't4'").select("pr_auc").scalar()
    return parents.agg(F.max_by("technique", "pr_auc").alias("best_parent"), F.max("pr_auc").alias("m")).select(
        F.lit("t4").alias("child"), "best_parent", (child - F.col("m")).alias("delta"))


@query("h38_vs_baseline", "SELECT t.technique, round(t.pr_auc - b.pr_auc, 6) + 0 AS pr_auc_delta, round(t.f1 - b.f1, 6) + 0 AS f1_delta, CAST(t.pr_auc > b.pr_auc AND t.f1 > b.f1 AS BIGINT) AS wins FROM f_tech t JOIN f_tech b ON b.technique = 't0'", ["f_tech"])
def h38(spark, sf):
    t = techniques(spark, sf)
    base = t.where("technique = 't0'").select(F.struct("pr_auc", "f1").alias("b")).scalar()
    t = t.withColumn("b", base)
    d1, d2 = F.col("pr_auc") - F.col("b.pr_auc"), F.col("f1") - F.col("b.f1")
    return t.select("technique", d1.alias("pr_auc_delta"), d2.alias("f1_delta"), ((d1 > 0) & (d2 > 0)).cast("int").alias("wins"))


# ---- predicates and joins by shape -------------------------------------------------------------------

@query("f4_finite_mask", "SELECT count(*) AS n, count(receivables_to_sales_latest) AS n_finite FROM f_feat", ["f_feat"])
def f4(spark, sf):
    t = X.feature_table(panel(spark, sf))
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum(finite(F.col("receivables_to_sales_latest")).cast("int")).alias("n_finite"))


@query("f5_min_pairs_guard", "SELECT entity, count(liabilities) AS n_pairs FROM f_panel GROUP BY entity HAVING count(liabilities) >= 14", ["f_panel"])
def f5(spark, sf):
    return panel(spark, sf).groupBy("entity").agg(F.count("liabilities").alias("n_pairs")).where("n_pairs >= 14")


@query("f7_low_coverage_features", " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS feature, round(count({n}) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM f_feat) WHERE coverage < 9e-1" for n in FEATURES), ["f_feat"])
def f7(spark, sf):
    return X.low_coverage(X.feature_table(panel(spark, sf)), FEATURES, 0.9)


@query("f8_misclassified", "SELECT row_id, CAST(y AS BIGINT) AS y, CAST(p_a >= 5e-1 AS BIGINT) AS predicted FROM f_scores WHERE CAST(p_a >= 5e-1 AS INT) <> y", ["f_scores"])
def f8(spark, sf):
    s = scores(spark, sf).withColumn("predicted", (F.col("p_a") >= 0.5).cast("int"))
    return s.where("predicted <> y").select("row_id", "y", "predicted")


_AUC = """SELECT {by} CASE WHEN sum(n1) > 0 AND sum(n0) > 0 THEN sum(n1 * (below + n0 / 2e0)) / (sum(n1) * sum(n0)) END AS auroc, sum(CASE WHEN n1 > 0 THEN n1 * tp / CAST(tp + fp AS DOUBLE) ELSE 0 END) / nullif(CAST(sum(n1) AS DOUBLE), 0) AS ap FROM (
  SELECT *, coalesce(sum(n0) OVER (PARTITION BY {part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(n1) OVER (PARTITION BY {part} ORDER BY p DESC) AS tp, sum(n0) OVER (PARTITION BY {part} ORDER BY p DESC) AS fp FROM (SELECT {by} p, CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM {src} GROUP BY {by} p)) GROUP BY {grp}"""


def auc_sql(src, *by):
    b = "".join(f"{x}, " for x in by)
    return _AUC.format(by=b, part=", ".join(by) or "1", src=src, grp=", ".join(by) if by else "()")


@query("f9_single_class_guard", f"SELECT g, round(auroc, 6) AS auroc FROM ({auc_sql('(SELECT grp % 200 AS g, y, p_a AS p FROM f_scores)', 'g')})", ["f_scores"])
def f9(spark, sf):
    s = scores(spark, sf).select((F.col("grp") % 200).alias("g"), "y", F.col("p_a").alias("p"))
    return M.rank_metrics(s, ["g"]).select("g", "auroc")


@query("g4_prior_lookup_default", "SELECT sample_id, round(coalesce(prior, 5e-1), 6) AS prior FROM f_split LEFT JOIN (SELECT * FROM f_prior WHERE entity % 4 <> 0) USING (entity) WHERE split = 'test'", ["f_split", "f_prior"])
def g4(spark, sf):
    s = samples2(spark, sf)
    return P.with_prior(s.where("split = 'test'"), P.entity_prior(s).where("entity % 4 <> 0")).select("sample_id", "prior")


@query("g5_prior_lookup_global_mean", "SELECT sample_id, round(coalesce(prior, (SELECT avg(is_distressed) FROM f_split WHERE split = 'train')), 6) AS prior FROM f_split LEFT JOIN (SELECT * FROM f_prior WHERE entity % 4 <> 0) USING (entity) WHERE split = 'test'", ["f_split", "f_prior"])
def g5(spark, sf):
    s = samples2(spark, sf)
    mean = s.where("split = 'train'").agg(F.avg("is_distressed").alias("m")).scalar()
    return P.with_prior(s.where("split = 'test'"), P.entity_prior(s).where("entity % 4 <> 0"), mean).select("sample_id", "prior")


@query("g6_split_reconciliation", """SELECT sample_id, e.split AS expected, coalesce(s.split, 'none') AS stored FROM f_split e LEFT JOIN (SELECT sample_id, split FROM f_split WHERE entity % 6 <> 0) s USING (sample_id) WHERE e.split IS DISTINCT FROM s.split
  UNION ALL SELECT concat(sample_id, 'x'), 'none', split FROM f_split WHERE entity = 1""", ["f_split"])
def g6(spark, sf):
    from ..operators.audit import split_reconciliation
    good = samples2(spark, sf).select("sample_id", "entity", "split")
    extra = good.where("entity = 1").withColumn("sample_id", F.concat("sample_id", F.lit("x")))
    return split_reconciliation(good, good.where("entity % 6 <> 0").unionByName(extra)).where("expected <> stored")


@query("g7_label_set_equality", """SELECT coalesce(a.y, -1) AS old_label, coalesce(b.y, -1) AS rule_label, count(*) AS n FROM (SELECT sample_id, CAST(is_distressed AS BIGINT) AS y FROM f_split WHERE entity % 6 <> 0) a
  FULL JOIN (SELECT sample_id, CAST(is_distressed AS BIGINT) AS y FROM f_split WHERE entity % 7 <> 0) b USING (sample_id) GROUP BY 1, 2""", ["f_split"])
def g7(spark, sf):
    s = samples2(spark, sf)
    a = s.where("entity % 6 <> 0").select("sample_id", F.col("is_distressed").alias("a"))
    b = s.where("entity % 7 <> 0").select("sample_id", F.col("is_distressed").alias("b"))
    return a.join(b, "sample_id", "full").groupBy(F.coalesce("a", F.lit(-1)).alias("old_label"), F.coalesce("b", F.lit(-1)).alias("rule_label")).agg(F.count(F.lit(1)).alias("n"))


@query("g9_scores_by_threshold_grid", "SELECT system, t AS threshold, " + ", ".join(f"CAST(sum(CASE WHEN (p >= t) = {h} AND y = {y} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, h, y in (("tp", "true", 1), ("fp", "true", 0), ("fn", "false", 1), ("tn", "false", 0)))
       + " FROM f_long, (SELECT unnest([3e-1, 35e-2, 4e-1, 5e-1, 6e-1, 656e-3]) AS t) GROUP BY system, t", ["f_long"])
def g9(spark, sf):
    from ..constants import EVAL_THRESHOLDS
    return M.counts_at(scores_long(spark, sf), EVAL_THRESHOLDS, ["system"])


@query("g13_error_enrichment", "SELECT s.row_id, c.c_mktsegment, CAST(s.y AS BIGINT) AS y FROM f_scores s JOIN customer c ON s.grp = c.c_custkey WHERE CAST(s.p_b >= 5e-1 AS INT) <> s.y", ["f_scores"])
def g13(spark, sf):
    from .views import table
    wrong = scores(spark, sf).where((F.col("p_b") >= 0.5).cast("int") != F.col("y"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("grp"), "c_mktsegment")
    return wrong.join(c, "grp").select("row_id", "c_mktsegment", "y")


@query("g14_grid_reference_lookup", "SELECT t.technique, round(t.pr_auc, 6) AS search_value, round(r.f1, 6) AS grid_value FROM f_tech t LEFT JOIN (SELECT * FROM f_tech WHERE technique <> 't3') r USING (technique)", ["f_tech"])
def g14(spark, sf):
    t = techniques(spark, sf)
    ref = t.where("technique <> 't3'").select("technique", F.col("f1").alias("grid_value"))
    return t.select("technique", F.col("pr_auc").alias("search_value")).join(ref, "technique", "left")


# ---- sequences ------------------------------------------------------------------------------------------

_LAGGED = "SELECT *, lag(is_distressed) OVER w AS prev, row_number() OVER w - row_number() OVER (PARTITION BY entity, is_distressed ORDER BY target_period_end) AS island FROM f_split WINDOW w AS (PARTITION BY entity ORDER BY target_period_end)"


@query("i1_label_flips", f"SELECT entity, CAST(coalesce(sum(CAST(is_distressed <> prev AS INT)), 0) AS BIGINT) AS n_switches FROM ({_LAGGED}) GROUP BY entity", ["f_split"])
def i1(spark, sf):
    return P.label_sequences(samples2(spark, sf)).select("entity", "n_switches")


@query("i2_longest_runs", f"SELECT entity, coalesce(max(CASE WHEN y = 1 THEN run END), 0) AS max_run_one, coalesce(max(CASE WHEN y = 0 THEN run END), 0) AS max_run_zero, min(lo) AS first_target, max(hi) AS last_target FROM (SELECT entity, is_distressed AS y, island, count(*) AS run, min(target_period_end) AS lo, max(target_period_end) AS hi FROM ({_LAGGED}) GROUP BY 1, 2, 3) GROUP BY entity", ["f_split"])
def i2(spark, sf):
    return P.label_sequences(samples2(spark, sf)).drop("n_switches")


@query("i3_transitions", f"""SELECT n00, n01, n10, n11, round(n11 / nullif(CAST(n10 + n11 AS DOUBLE), 0), 6) AS p_one_given_one, round(n01 / nullif(CAST(n00 + n01 AS DOUBLE), 0), 6) AS p_one_given_zero, round(1e2 * (n00 + n11) / (n00 + n01 + n10 + n11), 6) AS persistence_pct FROM (
  SELECT count(CASE WHEN prev = 0 AND is_distressed = 0 THEN 1 END) AS n00, count(CASE WHEN prev = 0 AND is_distressed = 1 THEN 1 END) AS n01, count(CASE WHEN prev = 1 AND is_distressed = 0 THEN 1 END) AS n10, count(CASE WHEN prev = 1 AND is_distressed = 1 THEN 1 END) AS n11 FROM ({_LAGGED}))""", ["f_split"])
def i3(spark, sf):
    return P.transitions(samples2(spark, sf))


@query("i4_history_jaccard", "SELECT count(*) AS n_pairs, round(avg(j), 6) AS mean_j, round(quantile_cont(j, 5e-1), 6) AS median_j, round(min(j), 6) AS min_j FROM (SELECT (n_history - 1) / CAST(n_history AS DOUBLE) AS j FROM f_samples WHERE n_history > 1)", ["f_samples"])
def i4(spark, sf):
    return P.history_jaccard(with_periods(spark, sf))


@query("i5_label_availability", "SELECT count(*) AS n, CAST(sum(CAST(g <= 0 AS INT)) AS BIGINT) AS n_not_after, min(g) AS min_gap, round(quantile_cont(g, 5e-1), 6) AS median_gap FROM (SELECT label_available_on - target_period_end AS g FROM f_split)", ["f_split"])
def i5(spark, sf):
    return P.label_availability(samples2(spark, sf))


@query("i6_fiscal_continuity", f"""SELECT entity, period_end, CAST(CASE WHEN py IS NULL THEN 1 WHEN fiscal_year = CASE WHEN pq = 4 THEN py + 1 ELSE py END AND fiscal_quarter = CASE WHEN pq = 4 THEN 1 ELSE pq + 1 END THEN 1 ELSE 0 END AS BIGINT) AS label_ok,
  CAST(coalesce(period_end > pe, true) AS BIGINT) AS end_ok FROM (SELECT *, lag(fiscal_year) OVER {WE} AS py, lag(fiscal_quarter) OVER {WE} AS pq, lag(period_end) OVER {WE} AS pe FROM f_panel WHERE (entity + fiscal_year * 4 + fiscal_quarter) % 9 <> 0)""", ["f_panel"])
def i6(spark, sf):
    return P.fiscal_continuity(panel(spark, sf).where("(entity + fiscal_year * 4 + fiscal_quarter) % 9 <> 0"))


@query("i7_benjamini_hochberg", """SELECT key, round(p, 6) AS p, round(q, 6) AS q FROM (SELECT *, CASE WHEN p IS NOT NULL THEN least(1e0, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM (
  SELECT key, p, row_number() OVER (ORDER BY p NULLS LAST, key) AS rk, count(p) OVER () AS m FROM (SELECT o_custkey AS key, CASE WHEN o_custkey % 13 <> 0 THEN min(((o_orderkey * 7919) % 1000) / 13e3) END AS p FROM orders GROUP BY 1)))""")
def i7(spark, sf):
    s = scores(spark, sf).groupBy(F.col("grp").alias("key")).agg(F.min(F.col("p_b") / 13.0).alias("p"))
    return K.benjamini_hochberg(s.withColumn("p", F.when(F.col("key") % 13 != 0, F.col("p"))), "p", "key")


@query("i8_mid_ranks", "SELECT system, round(p, 6) AS p, n, round(r, 6) AS mid_rank FROM (SELECT system, p, count(*) AS n, sum(count(*)) OVER (PARTITION BY system ORDER BY p) - (count(*) - 1) / 2e0 AS r FROM f_long GROUP BY system, p)", ["f_long"])
def i8(spark, sf):
    from ..functions.ordered import mid_ranks
    return mid_ranks(scores_long(spark, sf), "p", ["system"]).select("system", "p", "n", "mid_rank")
