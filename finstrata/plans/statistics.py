"""Queries K*, N5-N7, N33-N36: descriptive statistics, drift, missingness, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FEATURE_GROUPS, FEATURES, N_BOOT
from ..functions.draws import poisson_bounds
from ..operators import features as X
from ..operators import inference as N
from ..operators import samples as S
from ..operators import statistics as K
from ..sources.landing import land
from .profiles import auc_sql, sample_features
from .metrics import E
from .registry import query
from .views import SQL, panel, scores, scores_long, sql_pair, sql_uniform

LATEST = FEATURE_GROUPS["ratios_latest"]


def labelled_features(spark, sf):
    """Features of every panel row with the row's own two-signal label and its year; landed, since statistics read it in several passes."""
    return land(X.feature_table(S.stress_label(panel(spark, sf), 2), ["label", "fiscal_year"]), "labelled-features")


def long_features(spark, sf, names=FEATURES):
    t = labelled_features(spark, sf)
    return X.unpivot_features(t, ["label", "fiscal_year"], names).withColumnRenamed("label", "y")


SQL["f_lf"] = (["f_feat", "f_lab"], "SELECT f.*, l.label2 AS y, l.fiscal_year FROM f_feat f JOIN f_lab l USING (entity, period_end)")
SQL["f_longf"] = (["f_lf"], "SELECT entity, period_end, y, fiscal_year, feature, value FROM f_lf UNPIVOT INCLUDE NULLS (value FOR feature IN (" + ", ".join(FEATURES) + "))")

_PROFILE = """SELECT feature, count(*) AS n, count(*) - count(value) AS n_missing, 1e2 * (count(*) - count(value)) / count(*) AS missing_pct, count(DISTINCT value) AS n_unique,
  avg(value) AS mean, CASE WHEN count(value) = 1 THEN 0e0 ELSE stddev_samp(value) END AS std, min(value) AS min, quantile_cont(value, 1e-2) AS p1, quantile_cont(value, 25e-2) AS q1, quantile_cont(value, 5e-1) AS median, quantile_cont(value, 75e-2) AS q3,
  quantile_cont(value, 99e-2) AS p99, max(value) AS max, skewness(value) AS skew, kurtosis(value) AS kurt, count(value) AS m,
  1e2 * count(CASE WHEN value = 0 THEN 1 END) / nullif(count(value), 0) AS zero_pct, 1e2 * count(CASE WHEN value < 0 THEN 1 END) / nullif(count(value), 0) AS negative_pct FROM f_longf GROUP BY feature"""
SQL["f_prof"] = (["f_longf"], f"""SELECT p.*, t.top_n, o.iqr_n, o.z3_n FROM ({_PROFILE}) p
  LEFT JOIN (SELECT feature, max(c) AS top_n FROM (SELECT feature, value, count(*) AS c FROM f_longf WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1) t USING (feature)
  LEFT JOIN (SELECT l.feature, count(CASE WHEN value < q1 - 15e-1*(q3-q1) OR value > q3 + 15e-1*(q3-q1) THEN 1 END) AS iqr_n, count(CASE WHEN std > 0 AND abs(value - mean) / std > 3 THEN 1 END) AS z3_n FROM f_longf l JOIN ({_PROFILE}) q USING (feature) WHERE value IS NOT NULL GROUP BY 1) o USING (feature)""")
_R = lambda *cs: ", ".join(f"round({c}, 4) AS {c}" for c in cs)


@query("k1_column_profile", f"""SELECT feature, n, n_missing, {_R('missing_pct')}, n_unique, CAST(n_unique = 1 AS BIGINT) AS is_constant, CAST(n_unique > 1 AND top_n / CAST(m AS DOUBLE) >= 95e-2 AS BIGINT) AS is_near_constant,
  round(top_n / CAST(m AS DOUBLE), 4) AS top_value_share, {_R('mean', 'std', 'min', 'p1', 'q1', 'median', 'q3', 'p99', 'max')}, round(CASE WHEN std > 0 THEN skew END, 4) AS skew, round(CASE WHEN std > 0 THEN kurt END, 4) AS kurtosis_excess,
  {_R('zero_pct', 'negative_pct')}, iqr_n AS iqr_outlier_n, round(1e2 * iqr_n / m, 4) AS iqr_outlier_pct, round(1e2 * z3_n / m, 4) AS z3_outlier_pct FROM f_prof""", ["f_prof"], digits=4)
def k1(spark, sf):
    return K.column_profile(long_features(spark, sf))


@query("k2_quality_flags", """SELECT feature, 'missing_gt_20pct' AS flag FROM f_prof WHERE missing_pct > 20 UNION ALL SELECT feature, 'heavy_tail' FROM f_prof WHERE abs(coalesce(skew, 0)) > 5 OR coalesce(kurt, 0) > 20
  UNION ALL SELECT feature, 'many_outliers' FROM f_prof WHERE 1e2 * iqr_n / m > 5 UNION ALL SELECT feature, 'constant' FROM f_prof WHERE n_unique = 1 UNION ALL SELECT feature, 'near_constant' FROM f_prof WHERE n_unique > 1 AND top_n / CAST(m AS DOUBLE) >= 95e-2""", ["f_prof"])
def k2(spark, sf):
    return K.quality_flags(K.column_profile(long_features(spark, sf)))


def _tail(expr, width, f):
    return f"list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * ({f}))) * ({width}) / 6e3"


def sql_normal_p(z):
    """Two-sided normal tail by Simpson integration of the density over [0, |z|]."""
    return f"greatest(0e0, 1e0 - {_tail(z, f'abs({z})', f'exp(-pow(abs({z}) * k / 2e3, 2) / 2e0)')} * sqrt(2e0 / pi()))"


def sql_student_p(t, v):
    lo = f"atan(abs({t}) / sqrt({v}))"
    area = _tail(t, f"(pi() / 2 - {lo})", f"pow(greatest(0e0, cos({lo} + (pi() / 2 - {lo}) * k / 2e3)), {v} - 1)")
    return f"least(1e0, 2e0 * exp(lgamma(({v} + 1) / 2e0) - lgamma({v} / 2e0)) / sqrt(pi()) * {area})"


SQL["f_assoc"] = (["f_longf"], f"""SELECT *, CASE WHEN r IS NOT NULL THEN {sql_student_p('t', 'v')} END AS p_value FROM (SELECT *, r * sqrt(v / (1 - r * r)) AS t FROM (
  SELECT feature, n_pairs, auroc AS auc, 2 * auroc - 1 AS effect, r, top / base AS lift, CAST(n_pairs - 2 AS DOUBLE) AS v FROM ({auc_sql('(SELECT feature, y, value AS p FROM f_longf WHERE value IS NOT NULL)', 'feature')})
  JOIN (SELECT feature, count(value) AS n_pairs, corr(value, CASE WHEN value IS NOT NULL THEN y END) AS r, avg(CASE WHEN value IS NOT NULL THEN y END) AS base FROM f_longf GROUP BY 1) USING (feature)
  JOIN (SELECT feature, avg(y) AS top FROM f_longf JOIN (SELECT feature, quantile_cont(value, 9e-1) AS cut FROM f_longf GROUP BY 1) USING (feature) WHERE value >= cut GROUP BY 1) USING (feature)))""")


def _bh(src, p, key):
    return f"SELECT *, CASE WHEN {p} IS NOT NULL THEN least(1e0, min({p} * m_ / rk_) OVER (ORDER BY rk_ ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q_value FROM (SELECT *, row_number() OVER (ORDER BY {p} NULLS LAST, {key}) AS rk_, count({p}) OVER () AS m_ FROM {src})"


@query("k3_target_association", f"""SELECT feature, n_pairs, round(auc, 5) AS auc, round(effect, 5) AS effect, CASE WHEN auc > 5e-1 THEN 'high' ELSE 'low' END AS direction, round(r, 5) AS r, round(lift, 5) AS lift_top_decile, round(p_value, 5) AS p_value, round(q_value, 5) AS q_value
  FROM ({_bh('f_assoc', 'p_value', 'feature')})""", ["f_assoc"], digits=5)
def k3(spark, sf):
    return K.target_association(long_features(spark, sf)).drop("t")


@query("k3_mutual_information", """SELECT feature, round(sum(CASE WHEN p > 0 THEN p / nn * ln(p * nn / (n * pp)) ELSE 0 END + CASE WHEN n - p > 0 THEN (n - p) / nn * ln((n - p) * nn / (n * (nn - pp))) ELSE 0 END), 5) AS mi FROM (
  SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(p) OVER (PARTITION BY feature) AS pp FROM (SELECT feature, least(19, (rk - 1) * 20 // cnt) AS b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS p FROM (
  SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY value) AS rk, count(*) OVER (PARTITION BY feature) AS cnt FROM f_longf WHERE value IS NOT NULL) GROUP BY 1, 2)) GROUP BY feature""", ["f_longf"], digits=5)
def k3b(spark, sf):
    return K.mutual_information(long_features(spark, sf))


SQL["f_pos"] = ([], "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(FEATURES)) + ") AS t(pos, feature)")


def _corr_sql(src, names):
    inlist = ", ".join(f"'{n}'" for n in names)
    return f"""SELECT x.feature AS a, z.feature AS b, count(*) AS n, CASE WHEN count(*) >= 30 AND stddev_samp(x.value) > 0 AND stddev_samp(z.value) > 0 THEN corr(x.value, z.value) END AS r FROM (SELECT * FROM {src} JOIN f_pos USING (feature) WHERE value IS NOT NULL AND feature IN ({inlist})) x
  JOIN (SELECT * FROM {src} JOIN f_pos USING (feature) WHERE value IS NOT NULL AND feature IN ({inlist})) z ON x.entity = z.entity AND x.period_end = z.period_end AND x.pos < z.pos GROUP BY 1, 2"""


SQL["f_rank"] = (["f_longf"], "SELECT entity, period_end, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2e0 AS value FROM f_longf WHERE value IS NOT NULL")
SQL["f_pear"] = (["f_longf", "f_pos"], _corr_sql("f_longf", LATEST))
SQL["f_pear47"] = (["f_longf", "f_pos"], _corr_sql("f_longf", FEATURES))
SQL["f_spear"] = (["f_rank", "f_pos"], _corr_sql("f_rank", LATEST))


def _p(spark, sf, names=LATEST):
    return K.pearson(labelled_features(spark, sf), names)


def _s(spark, sf):
    return K.spearman(labelled_features(spark, sf), ["entity", "period_end"], LATEST)


@query("k4_pearson", "SELECT a, b, n, round(r, 5) AS r FROM f_pear47", ["f_pear47"], digits=5)
def k4(spark, sf):
    return _p(spark, sf, FEATURES)


@query("k4_spearman", "SELECT a, b, n, round(r, 5) AS r FROM f_spear", ["f_spear"], digits=5)
def k4b(spark, sf):
    return _s(spark, sf)


@query("k5_strongest_pairs", "SELECT a, b, round(p.r, 5) AS pearson, round(s.r, 5) AS spearman, round(abs(p.r), 4) AS abs_r FROM f_pear p JOIN f_spear s USING (a, b) WHERE p.r IS NOT NULL ORDER BY abs_r DESC, a, b LIMIT 20", ["f_pear", "f_spear"], digits=5)
def k5(spark, sf):
    return K.correlation_report(_p(spark, sf), _s(spark, sf))


@query("k6_correlation_clusters", """WITH e AS (SELECT a, b FROM f_pear47 WHERE abs(r) >= 9e-1 UNION SELECT b, a FROM f_pear47 WHERE abs(r) >= 9e-1), c(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, c.label FROM c JOIN e ON e.a = c.node)
  SELECT cluster, node AS feature, count(*) OVER (PARTITION BY cluster) AS size FROM (SELECT node, min(label) AS cluster FROM c GROUP BY node)""", ["f_pear47"])
def k6(spark, sf):
    return K.correlation_clusters(_p(spark, sf, FEATURES))


@query("k7_effective_dimensionality")
def k7(spark, sf):
    return K.effective_dimensionality(labelled_features(spark, sf), FEATURES)


@query("k8_outlier_driven_pairs", "SELECT a, b, round(p.r, 5) AS pearson, round(s.r, 5) AS spearman, round(abs(p.r - s.r), 5) AS gap FROM f_pear p JOIN f_spear s USING (a, b) WHERE abs(p.r - s.r) > 1e-1", ["f_pear", "f_spear"], digits=5)
def k8(spark, sf):
    return K.outlier_driven(_p(spark, sf), _s(spark, sf), 0.1)


@query("k9_variance_inflation")
def k9(spark, sf):
    return K.variance_inflation(labelled_features(spark, sf), FEATURES)


def drift_long(spark, sf):
    return long_features(spark, sf).withColumn("is_ref", (F.col("fiscal_year") < 1996).cast("int"))


SQL["f_dl"] = (["f_longf"], "SELECT feature, value, CAST(fiscal_year < 1996 AS INT) AS is_ref FROM f_longf WHERE value IS NOT NULL")
SQL["f_edges"] = (["f_dl"], "SELECT feature, list_sort(list_distinct(quantile_cont(value, [0e0, 1e-1, 2e-1, 3e-1, 4e-1, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1, 1e0]))) AS e FROM f_dl WHERE is_ref = 1 GROUP BY 1")
SQL["f_psi"] = (["f_edges"], """SELECT feature, CASE WHEN max(rn) >= 10 AND max(wn) >= 10 THEN sum((greatest(w, 1e-6) - greatest(r, 1e-6)) * ln(greatest(w, 1e-6) / greatest(r, 1e-6))) END AS psi FROM (SELECT feature, b, max(rn) AS rn, max(wn) AS wn,
  count(CASE WHEN is_ref = 1 THEN 1 END) / CAST(max(rn) AS DOUBLE) AS r, count(CASE WHEN is_ref = 0 THEN 1 END) / CAST(max(wn) AS DOUBLE) AS w FROM (SELECT feature, is_ref, len(list_filter(e[2:len(e)-1], lambda x: x <= value)) AS b,
  sum(is_ref) OVER (PARTITION BY feature) AS rn, sum(1 - is_ref) OVER (PARTITION BY feature) AS wn, len(e) AS k FROM f_dl JOIN f_edges USING (feature)) WHERE k >= 3 GROUP BY 1, 2) GROUP BY 1""")


@query("k10_psi", "SELECT DISTINCT d.feature, round(psi, 5) AS psi FROM f_dl d LEFT JOIN f_psi USING (feature)", ["f_psi"], digits=5)
def k10(spark, sf):
    return K.psi(drift_long(spark, sf))


_KS = """SELECT feature, max(abs(cr / nullif(rn, 0) - cw / nullif(wn, 0))) AS ks FROM (SELECT feature, value, sum(sum(is_ref)) OVER w / 1e0 AS cr, sum(sum(1 - is_ref)) OVER w / 1e0 AS cw, sum(sum(is_ref)) OVER (PARTITION BY feature) AS rn, sum(sum(1 - is_ref)) OVER (PARTITION BY feature) AS wn
  FROM f_dl GROUP BY feature, value WINDOW w AS (PARTITION BY feature ORDER BY value)) GROUP BY 1"""
SQL["f_drift"] = (["f_dl", "f_psi"], f"""SELECT *, CASE WHEN x IS NULL THEN NULL WHEN x < 2e-1 THEN 1e0 ELSE greatest(0e0, least(1e0, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1e0 ELSE -1e0 END * exp(-2e0 * k * k * x * x))))) END AS ks_p FROM (SELECT m.*, ks, psi,
  (mean_new - mean_ref) / nullif(sqrt((v1 + v0) / 2), 0) AS smd, ks * sqrt(CAST(n_ref AS DOUBLE) * n_new / (n_ref + n_new)) AS x FROM (SELECT feature, count(CASE WHEN is_ref = 1 THEN 1 END) AS n_ref, count(CASE WHEN is_ref = 0 THEN 1 END) AS n_new, avg(CASE WHEN is_ref = 1 THEN value END) AS mean_ref, avg(CASE WHEN is_ref = 0 THEN value END) AS mean_new,
  var_samp(CASE WHEN is_ref = 1 THEN value END) AS v1, var_samp(CASE WHEN is_ref = 0 THEN value END) AS v0 FROM f_dl GROUP BY 1) m JOIN ({_KS}) USING (feature) LEFT JOIN f_psi USING (feature))""")


@query("k11_drift_table", f"SELECT feature, n_ref, n_new, round(mean_ref, 5) AS mean_ref, round(mean_new, 5) AS mean_new, round(ks, 5) AS ks, round(ks_p, 5) AS ks_p, round(smd, 5) AS smd, round(psi, 5) AS psi, round(q_value, 5) AS q_value, CAST(coalesce(ks, 0) >= 3e-1 OR coalesce(abs(smd), 0) >= 5e-1 AS BIGINT) AS drifted FROM ({_bh('f_drift', 'ks_p', 'feature')})", ["f_drift"], digits=5)
def k11(spark, sf):
    """Asymptotic p-values, as the SQL beside it."""
    return K.drift_table(drift_long(spark, sf), exact_up_to=0)


@query("k11_drift_exact_p")
def k11b(spark, sf):
    """Exact p-values wherever the samples are small enough: a count of lattice paths, which SQL has no form for."""
    return K.drift_table(drift_long(spark, sf))


@query("k12_missing_by_split", " UNION ALL ".join(f"SELECT split, '{n}' AS feature, round(1e2 * (count(*) - count({n})) / count(*), 6) AS missing_pct FROM f_sf GROUP BY split" for n in FEATURES), ["f_sf"])
def k12(spark, sf):
    return K.missing_by_split(sample_features(spark, sf), FEATURES)


SQL["f_miss"] = (["f_longf"], """SELECT feature, count(CASE WHEN value IS NULL AND y = 1 THEN 1 END) / 1e0 AS a, count(CASE WHEN value IS NULL AND y = 0 THEN 1 END) / 1e0 AS b, count(CASE WHEN value IS NOT NULL AND y = 1 THEN 1 END) / 1e0 AS c, count(CASE WHEN value IS NOT NULL AND y = 0 THEN 1 END) / 1e0 AS d FROM f_longf GROUP BY 1""")
SQL["f_miss2"] = (["f_miss"], f"""SELECT *, CASE WHEN chi2 IS NOT NULL THEN {sql_normal_p('sqrt(chi2)')} END AS p_value FROM (SELECT *, CASE WHEN a + b >= 5 AND c + d >= 5 THEN coalesce(pow(abs(a*d - b*c) - least(abs(a*d - b*c), (a+b+c+d)/2), 2) * (a+b+c+d) / nullif((a+b)*(c+d)*(a+c)*(b+d), 0), 0) END AS chi2 FROM f_miss)""")


@query("k12_missing_informativeness", f"""SELECT feature, CAST(a + b AS BIGINT) AS n_missing, CAST(c + d AS BIGINT) AS n_present, round(CASE WHEN chi2 IS NOT NULL THEN 1e2 * a / (a + b) END, 5) AS rate_missing_pct, round(CASE WHEN chi2 IS NOT NULL THEN 1e2 * c / (c + d) END, 5) AS rate_present_pct, round(chi2, 5) AS chi2,
  round(CASE WHEN chi2 IS NOT NULL THEN 1e2 * a / (a + b) - 1e2 * c / (c + d) END, 5) AS delta_pct, round(p_value, 5) AS p_value, round(q_value, 5) AS q_value FROM ({_bh('f_miss2', 'p_value', 'feature')})""", ["f_miss2"], digits=5)
def k12b(spark, sf):
    return K.missing_informativeness(long_features(spark, sf))


@query("k12_co_missing", """SELECT x.feature AS a, z.feature AS b, count(CASE WHEN x.value IS NULL AND z.value IS NULL THEN 1 END) AS n_both, round(count(CASE WHEN x.value IS NULL AND z.value IS NULL THEN 1 END) / CAST(count(CASE WHEN x.value IS NULL OR z.value IS NULL THEN 1 END) AS DOUBLE), 6) AS jaccard FROM (SELECT * FROM f_longf JOIN f_pos USING (feature)) x
  JOIN (SELECT * FROM f_longf JOIN f_pos USING (feature)) z ON x.entity = z.entity AND x.period_end = z.period_end AND x.pos < z.pos GROUP BY 1, 2 HAVING n_both > 0 ORDER BY n_both DESC, a, b LIMIT 15""", ["f_longf", "f_pos"])
def k12c(spark, sf):
    return K.co_missing(labelled_features(spark, sf), FEATURES)


@query("k12_missing_patterns", """SELECT x.feature AS a, z.feature AS b FROM (SELECT * FROM f_longf JOIN f_pos USING (feature)) x JOIN (SELECT * FROM f_longf JOIN f_pos USING (feature)) z ON x.entity = z.entity AND x.period_end = z.period_end AND x.pos < z.pos
  GROUP BY 1, 2 HAVING sum(CAST((x.value IS NULL) <> (z.value IS NULL) AS INT)) = 0""", ["f_longf", "f_pos"])
def k12d(spark, sf):
    return K.missing_patterns(labelled_features(spark, sf), FEATURES)


@query("k12_missing_density", f"SELECT round(avg(k), 6) AS mean_missing, CAST(max(k) AS BIGINT) AS max_missing, round(avg(CAST(k > 5e-1 * {len(FEATURES)} AS INT)), 6) AS share_gt_half FROM (SELECT entity, period_end, sum(CAST(value IS NULL AS INT)) AS k FROM f_longf GROUP BY 1, 2)", ["f_longf"])
def k12e(spark, sf):
    return K.missing_density(labelled_features(spark, sf), FEATURES)


FILL = ["net_margin_latest", "receivables_to_sales_latest", "revenue_yoy_growth", "net_income_yoy_growth"]


@query("k13_median_fill", "SELECT entity, period_end, " + ", ".join(f"round(coalesce({c}, (SELECT quantile_cont({c}, 5e-1) FROM f_feat), 0), 6) AS {c}" for c in FILL) + " FROM f_feat", ["f_feat"])
def k13(spark, sf):
    return K.median_fill(labelled_features(spark, sf).select("entity", "period_end", *FILL), FILL)


@query("k14_threshold_findings", """SELECT 'heavy_tail' AS finding, count(*) AS n, coalesce(string_agg(feature, ',' ORDER BY feature), '') AS items FROM f_prof WHERE abs(coalesce(skew, 0)) > 5 OR coalesce(kurt, 0) > 20
  UNION ALL SELECT 'missing_gt_20pct', count(*), coalesce(string_agg(feature, ',' ORDER BY feature), '') FROM f_prof WHERE missing_pct > 20 UNION ALL SELECT 'psi_gt_0_2', count(*), coalesce(string_agg(feature, ',' ORDER BY feature), '') FROM f_psi WHERE psi > 2e-1""", ["f_prof", "f_psi"])
def k14(spark, sf):
    prof = K.column_profile(long_features(spark, sf))
    f = F.col("feature")
    return K.findings({
        "heavy_tail": (prof, (F.abs(F.coalesce("skew", F.lit(0.0))) > 5) | (F.coalesce("kurtosis_excess", F.lit(0.0)) > 20), f),
        "missing_gt_20pct": (prof, F.col("missing_pct") > 20, f), "psi_gt_0_2": (K.psi(drift_long(spark, sf)), F.col("psi") > 0.2, f)})


@query("k15_basic_findings", """SELECT 'skewed' AS finding, count(*) AS n, coalesce(string_agg(feature, ',' ORDER BY feature), '') AS items FROM f_prof WHERE abs(skew) > 1 UNION ALL SELECT 'outliers', count(*), coalesce(string_agg(feature, ',' ORDER BY feature), '') FROM f_prof WHERE 1e2 * iqr_n / m > 5
  UNION ALL SELECT 'collinear', count(*), coalesce(string_agg(DISTINCT concat(a, '~', b), ',' ORDER BY concat(a, '~', b)), '') FROM f_pear WHERE abs(r) >= 8e-1""", ["f_prof", "f_pear"])
def k15(spark, sf):
    prof = K.column_profile(long_features(spark, sf))
    f = F.col("feature")
    return K.findings({
        "skewed": (prof, F.abs("skew") > 1, f), "outliers": (prof, F.col("iqr_outlier_pct") > 5, f),
        "collinear": (_p(spark, sf), F.abs("r") >= 0.8, F.concat("a", F.lit("~"), "b"))})


_RK = lambda p: f"rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2e0"


@query("k18_deep_profile_job")
def k18(spark, sf):
    """The whole exploration over one materialized feature table: profile, association, drift and missingness side by side."""
    long = long_features(spark, sf)
    prof = K.column_profile(long).select("feature", "n", "missing_pct", "skew", "iqr_outlier_pct")
    assoc = K.target_association(long).select("feature", "auc", F.col("q_value").alias("auc_q"))
    drift = K.drift_table(long.withColumn("is_ref", (F.col("fiscal_year") < 1996).cast("int"))).select("feature", "ks", "psi", "drifted")
    return prof.join(assoc, "feature", "left").join(drift, "feature", "left")


@query("g10_system_pairs", "SELECT 'p_a' AS a, 'p_b' AS b, CAST(y AS BIGINT) AS y, count(*) AS n_pairs, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT y, p_a, p_b, count(*) AS n FROM f_scores GROUP BY 1, 2, 3) GROUP BY y", ["f_scores"])
def g10(spark, sf):
    t = N.system_pairs(scores(spark, sf), ["p_a", "p_b"])
    return t.groupBy("a", "b", "y").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("n").alias("n_rows"))


@query("g11_column_pairs", "SELECT a, b, n FROM f_pear47", ["f_pear47"])
def g11(spark, sf):
    return K.pearson(labelled_features(spark, sf), FEATURES).select("a", "b", "n")


@query("k16_system_agreement", f"SELECT 'p_a' AS a, 'p_b' AS b, count(*) AS n, round(corr(ra, rb), 6) AS r FROM (SELECT {_RK('p_a')} AS ra, {_RK('p_b')} AS rb FROM f_scores)", ["f_scores"])
def k16(spark, sf):
    return K.system_agreement(scores_long(spark, sf), ["p_a", "p_b"])


SQL["f_imp"] = (["f_feat"], " UNION ALL ".join(f"SELECT '{n}' AS feature, stddev_samp({n}) AS va, count({n}) + avg({n}) / 1e6 AS vb FROM f_feat" for n in FEATURES))


@query("k17_ranking_agreement", f"""SELECT round((SELECT corr(ra, rb) FROM (SELECT {_RK('va')} AS ra, {_RK('vb')} AS rb FROM f_imp)), 6) AS spearman, round((SELECT count(*) FROM ((SELECT feature FROM f_imp ORDER BY va DESC, feature LIMIT 15) INTERSECT (SELECT feature FROM f_imp ORDER BY vb DESC, feature LIMIT 15)))
  / CAST((SELECT count(*) FROM ((SELECT feature FROM f_imp ORDER BY va DESC, feature LIMIT 15) UNION (SELECT feature FROM f_imp ORDER BY vb DESC, feature LIMIT 15))) AS DOUBLE), 6) AS top_jaccard""", ["f_imp"])
def k17(spark, sf):
    g = long_features(spark, sf).groupBy("feature").agg(F.stddev_samp("value").alias("va"), (F.count("value") + F.avg("value") / 1e6).alias("vb"))
    return K.ranking_agreement(g.select("feature", F.col("va").alias("value")), g.select("feature", F.col("vb").alias("value")))


# ---- inference ---------------------------------------------------------------------------------------------

SQL["f_place"] = (["f_dist"], """SELECT system, p, (sum(n0) OVER (PARTITION BY system ORDER BY p) - n0 / 2) / sum(n0) OVER (PARTITION BY system) AS v10,
  (sum(n1) OVER (PARTITION BY system ORDER BY p DESC) - n1 / 2) / sum(n1) OVER (PARTITION BY system) AS v01 FROM f_dist""")
SQL["f_delong"] = (["f_scores", "f_place"], """SELECT *, CASE WHEN var > 1e-18 THEN sqrt(var) END AS se FROM (SELECT avg(CASE WHEN y = 1 THEN xa END) AS auc_a, avg(CASE WHEN y = 1 THEN xb END) AS auc_b,
  var_samp(CASE WHEN y = 1 THEN xa - xb END) / count(CASE WHEN y = 1 THEN 1 END) + var_samp(CASE WHEN y = 0 THEN xa - xb END) / count(CASE WHEN y = 0 THEN 1 END) AS var FROM (
  SELECT s.y, CASE WHEN s.y = 1 THEN a.v10 ELSE a.v01 END AS xa, CASE WHEN s.y = 1 THEN b.v10 ELSE b.v01 END AS xb FROM f_scores s JOIN f_place a ON a.system = 'p_a' AND a.p = s.p_a JOIN f_place b ON b.system = 'p_b' AND b.p = s.p_b))""")


@query("n33_delong", f"SELECT 'p_a' AS a, 'p_b' AS b, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS delta, round(se, 6) AS std_err, round((auc_a - auc_b) / se, 6) AS z, round({sql_normal_p('((auc_a - auc_b) / se)')}, 6) AS p_value FROM f_delong", ["f_delong"])
def n33(spark, sf):
    return N.delong(scores(spark, sf), ["p_a", "p_b"])


@query("n34_placement_values", "SELECT system, round(p, 9) AS p, round(v10, 9) AS v10, round(v01, 9) AS v01 FROM f_place", ["f_place"], digits=9)
def n34(spark, sf):
    return N.placements(scores_long(spark, sf)).drop("n_pos", "n_neg")


B = N_BOOT
POIS = " + ".join(f"CAST(u >= {round(b * 1e12):d}e-12 AS INT)" for b in poisson_bounds())


def _draws(key, seed):
    return f"SELECT draw, y, p_a, p_b, grp, {POIS} AS w FROM (SELECT draw, y, p_a, p_b, grp, {sql_uniform(sql_pair('draw', key), seed)} AS u FROM f_scores, (SELECT unnest(range(0, {B})) AS draw))"


def _boot_sql(key, seed):
    """Metrics per draw of system p_b."""
    return f"""SELECT d.draw, auroc, ap, {E['f1']} AS f1, {E['macro_f1']} AS macro_f1 FROM (SELECT draw, sum(n1 * (below + n0 / 2e0)) / nullif(sum(n1) * sum(n0), 0) AS auroc, sum(n1 * tp / nullif(tp + fp, 0)) / nullif(sum(n1), 0) AS ap FROM (
  SELECT draw, n1, n0, coalesce(sum(n0) OVER (PARTITION BY draw ORDER BY p_b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n1) OVER (PARTITION BY draw ORDER BY p_b DESC) AS tp, sum(n0) OVER (PARTITION BY draw ORDER BY p_b DESC) AS fp FROM (
  SELECT draw, p_b, CAST(sum(w * y) AS DOUBLE) AS n1, CAST(sum(w * (1 - y)) AS DOUBLE) AS n0 FROM f_draw GROUP BY 1, 2)) GROUP BY draw) d
  JOIN (SELECT draw, CAST(sum(CASE WHEN p_b >= 5e-1 THEN w * y END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN p_b >= 5e-1 THEN w * (1 - y) END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN p_b < 5e-1 THEN w * y END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN p_b < 5e-1 THEN w * (1 - y) END) AS DOUBLE) AS tn FROM f_draw GROUP BY draw) c USING (draw)"""


def _ci_sql(metrics):
    return " UNION ALL ".join(f"SELECT '{n}' AS metric, round(quantile_cont({c}, 25e-3), 6) AS ci_low, round(quantile_cont({c}, 975e-3), 6) AS ci_high, round(avg({c}), 6) AS mean, count({c}) AS n_draws FROM f_m" for n, c in metrics)


_FOUR = [("auroc", "auroc"), ("average_precision", "ap"), ("f1", "f1"), ("macro_f1", "macro_f1")]


def _pb(spark, sf):
    return scores(spark, sf).select("row_id", "grp", "y", F.col("p_b").alias("p"))


@query("n5_sample_bootstrap", f"WITH f_draw AS ({_draws('row_id', 42)}), f_m AS ({_boot_sql('row_id', 42)}) {_ci_sql(_FOUR)}".replace("FROM f_scores,", "FROM f_scores,"), ["f_scores"])
def n5(spark, sf):
    return N.bootstrap_interval(_pb(spark, sf), "row_id", n_boot=B)


@query("n6_cluster_bootstrap", f"WITH f_draw AS ({_draws('grp', 42)}), f_m AS ({_boot_sql('grp', 42)}) {_ci_sql(_FOUR)}", ["f_scores"])
def n6(spark, sf):
    return N.bootstrap_interval(_pb(spark, sf), "grp", n_boot=B)


@query("n7_one_metric_bootstrap", f"WITH f_draw AS ({_draws('row_id', 7)}), f_m AS ({_boot_sql('row_id', 7)}) {_ci_sql(_FOUR[1:2])}", ["f_scores"])
def n7(spark, sf):
    return N.bootstrap_interval(_pb(spark, sf), "row_id", n_boot=B, seed=7, names=["average_precision"])


def _pair_sql():
    one = lambda p: f"""SELECT draw, sum(n1 * (below + n0 / 2e0)) / (max(pos) * max(neg)) AS auroc, sum(n1 / pos * tp * (tpos / pos) / nullif(tp * (tpos / pos) + fp * (tneg / neg), 0)) AS ap FROM (
  SELECT draw, n1, n0, sum(n1) OVER (PARTITION BY draw) AS pos, sum(n0) OVER (PARTITION BY draw) AS neg, (SELECT CAST(sum(y) AS DOUBLE) FROM f_scores) AS tpos, (SELECT CAST(sum(1 - y) AS DOUBLE) FROM f_scores) AS tneg,
  coalesce(sum(n0) OVER (PARTITION BY draw ORDER BY {p} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n1) OVER (PARTITION BY draw ORDER BY {p} DESC) AS tp, sum(n0) OVER (PARTITION BY draw ORDER BY {p} DESC) AS fp FROM (
  SELECT draw, {p}, CAST(sum(w * y) AS DOUBLE) AS n1, CAST(sum(w * (1 - y)) AS DOUBLE) AS n0 FROM f_draw WHERE w > 0 GROUP BY 1, 2)) GROUP BY draw"""
    obs = f"SELECT max(CASE WHEN system = 'p_a' THEN auroc END) - max(CASE WHEN system = 'p_b' THEN auroc END) AS auroc, max(CASE WHEN system = 'p_a' THEN ap END) - max(CASE WHEN system = 'p_b' THEN ap END) AS ap FROM ({auc_sql('f_long', 'system')})"
    row = lambda m, c: f"""SELECT '{m}' AS metric, o.{c} AS observed, quantile_cont(d.{c}, 25e-3) AS ci_low, quantile_cont(d.{c}, 975e-3) AS ci_high, least(1e0, 2 * least(avg(CAST(d.{c} <= 0 AS INT)), avg(CAST(d.{c} >= 0 AS INT)))) AS p_value, avg(CAST(sign(d.{c}) = sign(o.{c}) AS INT)) AS same_sign, count(*) AS n_draws FROM f_d d, f_o o GROUP BY o.{c}"""
    return f"WITH f_draw AS ({_draws('row_id', 42)}), f_a AS ({one('p_a')}), f_b AS ({one('p_b')}), f_d AS (SELECT a.auroc - b.auroc AS auroc, a.ap - b.ap AS ap FROM f_a a JOIN f_b b USING (draw)), f_o AS ({obs}), f_pb AS ({row('auroc', 'auroc')} UNION ALL {row('average_precision', 'ap')}) "


@query("n35_paired_bootstrap", _pair_sql() + "SELECT metric, round(observed, 6) AS observed, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value, round(same_sign, 6) AS same_sign, n_draws, CAST(p_value < 5e-2 AS BIGINT) AS significant FROM f_pb", ["f_long"])
def n35(spark, sf):
    return N.paired_bootstrap(scores(spark, sf), "p_a", "p_b", n_boot=B)


@query("n36_compare_systems", _pair_sql() + f"SELECT 'p_a' AS a, 'p_b' AS b, round(auc_a, 6) AS auc_a, round(auc_b, 6) AS auc_b, round(auc_a - auc_b, 6) AS delta, round(se, 6) AS std_err, round((auc_a - auc_b) / se, 6) AS z, round({sql_normal_p('((auc_a - auc_b) / se)')}, 6) AS p_value, metric, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(f_pb.p_value, 6) AS boot_p FROM f_delong, f_pb", ["f_long", "f_delong"])
def n36(spark, sf):
    return N.compare_systems(scores(spark, sf), ["p_a", "p_b"], n_boot=B)
