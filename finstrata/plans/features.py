"""Queries E*: window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FEATURES, FEATURE_GROUPS, INDICATORS, RATIOS
from ..functions.panel import entity_rows, recent_rows, rows_so_far, last_finite, row_index, trailing_streak
from ..functions.scalars import as_double, close, growth, ratio, stable
from ..operators import features as X
from ..operators import samples as S
from .registry import query
from .views import SQL, panel

# ---- SQL text of the same features, built from the ratio registry --------------------------------------
W8 = "(PARTITION BY entity ORDER BY period_end ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
P4 = "(PARTITION BY entity ORDER BY period_end ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING)"
WA = "(PARTITION BY entity ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WE = "(PARTITION BY entity ORDER BY period_end)"


def _d(c):
    return f"CAST({c} AS DOUBLE)"


def _div(a, b):
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def _streak(cond):
    return (f"CAST(least(8, rn - coalesce(max(CASE WHEN NOT coalesce({cond}, false) THEN rn END) OVER {WA}, 0)) AS DOUBLE)")


def _resolve(expr, p):
    if expr == "total_liabilities":
        return f"coalesce({p}liabilities, {p}total_assets - {p}stockholders_equity)"
    return " - ".join(f"{p}{x.strip()}" for x in expr.split(" - "))


def _ratio(name, p):
    n, d = RATIOS[name]
    return _div(f"({_resolve(n, p)})", f"({_resolve(d, p)})")


def _growth(a, b):
    return f"(({a} - {b}) / nullif(abs({b}), 0))"


SQL["w_rn"] = (["f_panel"], f"SELECT *, row_number() OVER {WE} AS rn FROM f_panel")
SQL["w_win"] = (["w_rn"], "SELECT entity, period_end, rn AS n_history,\n" + ",\n".join(
    [f"last_value({_d(c)} IGNORE NULLS) OVER {W8} AS l_{c}" for c in INDICATORS]
    + [f"last_value({_d(c)} IGNORE NULLS) OVER {P4} AS p_{c}" for c in INDICATORS]
    + [
        f"coalesce(sum(CASE WHEN operating_cash_flow < 0 THEN 1e0 END) OVER {W8}, 0e0) AS w_ocf_neg",
        f"count(revenue) OVER {W8} AS w_rev_n", f"avg(revenue) OVER {W8} AS w_rev_mean",
        f"stddev_pop(revenue) OVER {W8} AS w_rev_sd", f"max({_d('revenue')}) OVER {W8} AS w_rev_peak",
        f"min({_div('current_assets', 'current_liabilities')}) OVER {W8} AS current_ratio_min_window",
        f"min({_div('operating_cash_flow', 'revenue')}) OVER {W8} AS ocf_to_sales_min_window",
        f"min({_div('net_income', 'revenue')}) OVER {W8} AS net_margin_min_window",
        f"{_streak('net_income < 0')} AS negative_ni_streak",
        f"{_streak('operating_cash_flow < 0')} AS negative_ocf_streak",
    ]) + "\nFROM w_rn")


def feature_sql(name: str) -> str:
    """The unrounded SQL of one feature over ``w_win``."""
    if name.endswith("_latest"):
        return _ratio(name[:-7], "l_")
    if name.endswith("_yoy_growth"):
        g = name[:-11]
        return f"CASE WHEN n_history >= 5 THEN {_growth('l_' + g, 'p_' + g)} END"
    if name.endswith("_yoy"):
        r = name[:-4]
        return f"CASE WHEN n_history >= 5 THEN {_growth(_ratio(r, 'l_'), _ratio(r, 'p_'))} END"
    return {
        "working_capital_to_assets": _div("(l_current_assets - l_current_liabilities)", "l_total_assets"),
        "distress_quarters_in_window": "w_ocf_neg",
        "revenue_cv": "CASE WHEN w_rev_n > 1 THEN w_rev_sd / nullif(w_rev_mean, 0) END",
        "revenue_drawdown_window": "CASE WHEN w_rev_peak > 0 THEN l_revenue / w_rev_peak - 1 END",
    }.get(name, name)


def cols_sql(names, digits=6):
    return ", ".join(f"round({feature_sql(n)}, {digits}) AS {n}" for n in names)


SQL["f_feat"] = (["w_win"], "SELECT entity, period_end, n_history, " + ", ".join(
    f"{feature_sql(n)} AS {n}" for n in FEATURES) + " FROM w_win")

SIG = {
    "net_income<0": "coalesce(net_income < 0, false)",
    "operating_cash_flow<0": "coalesce(operating_cash_flow < 0, false)",
    "operating_income<0": "coalesce(operating_income < 0, false)",
    "current_liabilities>current_assets": "coalesce(current_liabilities > current_assets, false)",
    "stockholders_equity<0": "coalesce(stockholders_equity < 0, false)",
    "revenue_yoy<-5%": f"coalesce((revenue - lag(revenue, 4) OVER {WE}) / nullif(CAST(abs(lag(revenue, 4) OVER {WE}) AS DOUBLE), 0) < -5e-2, false)",
}
SQL["f_sig"] = (["w_rn"], "SELECT *, " + ", ".join(f"CAST({v} AS INT) AS s{i}" for i, v in enumerate(SIG.values()))
                + " FROM w_rn")
_names = list(SIG)
SQL["f_lab"] = (["f_sig"], "SELECT *, s0+s1+s2+s3+s4+s5 AS n_signals, CASE WHEN s0+s1+s2+s3+s4+s5 >= 2 THEN 1 ELSE 0 END AS label2 FROM f_sig")
SQL["f_samples"] = (["f_lab"], f"""SELECT * FROM (SELECT entity, period_end, fiscal_year, available_on AS as_of, rn AS n_history,
  lead(fiscal_year) OVER {WE} AS target_fiscal_year, lead(fiscal_quarter) OVER {WE} AS target_fiscal_quarter,
  lead(period_start) OVER {WE} AS target_period_start, lead(period_end) OVER {WE} AS target_period_end,
  lead(available_on) OVER {WE} AS label_available_on, lead(label2) OVER {WE} AS is_distressed,
  concat(entity, '-', lead(fiscal_year) OVER {WE}, 'Q', lead(fiscal_quarter) OVER {WE}) AS sample_id FROM f_lab) WHERE target_period_end IS NOT NULL""")
SQL["f_split"] = (["f_samples"], """SELECT *, CASE WHEN n <= 14 OR n - pos >= 14 THEN 'train' WHEN n - pos < 8 THEN 'test' WHEN n - pos < 9 THEN 'purged'
  WHEN n - pos < 13 THEN 'validation' ELSE 'purged' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period_end) AS pos,
  count(*) OVER (PARTITION BY entity) AS n FROM f_samples)""")


def samples2(spark, sf, keep=()):
    """Samples of the test panel labelled with at least two stress signals, with their split."""
    return S.time_split(S.rule_samples(panel(spark, sf), "stress_signals", 2))


@query("flagship_split_profile", """
SELECT split, count(*) AS n, CAST(sum(is_distressed) AS BIGINT) AS positives, round(avg(is_distressed), 6) AS positive_rate,
  round(avg(debt_to_assets_latest), 6) AS mean_debt_to_assets, round(avg(revenue_yoy_growth), 6) AS mean_revenue_growth,
  round(avg(current_ratio_min_window), 6) AS mean_worst_current_ratio, round(avg(revenue_drawdown_window), 6) AS mean_drawdown,
  round(avg(negative_ni_streak), 6) AS mean_ni_streak
FROM f_split s JOIN f_feat f USING (entity, period_end) GROUP BY split""", ["f_split", "f_feat"])
def flagship(spark, sf):
    p = S.label_by_rule("stress_signals", panel(spark, sf), 2)
    p = p.withColumn("is_distressed", F.lead("label").over(entity_rows())).withColumn("target_end", F.lead("period_end").over(entity_rows()))
    feats = X.feature_table(p, ["is_distressed", "target_end"]).where(F.col("target_end").isNotNull())
    split = S.time_split(feats)
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_distressed").alias("positives"),
        F.avg("is_distressed").alias("positive_rate"), F.avg("debt_to_assets_latest").alias("mean_debt_to_assets"),
        F.avg("revenue_yoy_growth").alias("mean_revenue_growth"),
        F.avg("current_ratio_min_window").alias("mean_worst_current_ratio"),
        F.avg("revenue_drawdown_window").alias("mean_drawdown"), F.avg("negative_ni_streak").alias("mean_ni_streak"),
    )


@query("e1_to_double", """SELECT event_id, TRY_CAST(regexp_extract(props, '-?[0-9]+[.]?[0-9]*') AS DOUBLE) AS v,
  TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def e1(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", as_double(F.nullif(F.regexp_extract("props", r"-?[0-9]+[.]?[0-9]*", 0), F.lit(""))).alias("v"),
                    as_double(F.col("event_type")).alias("bad"))


@query("e2_indicator_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS indicator, CAST({i} AS BIGINT) AS pos, count({c}) AS n_known FROM f_panel" for i, c in enumerate(INDICATORS)), ["f_panel"])
def e2(spark, sf):
    p = panel(spark, sf)
    known = p.agg(*[F.count(c).alias(c) for c in INDICATORS if c in p.columns])
    order = F.array(*[F.lit(c) for c in INDICATORS])
    return known.unpivot([], INDICATORS, "indicator", "n_known").withColumn("pos", F.array_position(order, F.col("indicator")) - 1)


@query("e3_history_columns", f"""SELECT entity, period_end, list(coalesce(CAST(net_income AS VARCHAR), '-')) OVER {WA} AS l FROM f_panel""".join(
    ["SELECT entity, period_end, array_to_string(l, ',') AS net_income_series FROM (", ")"]), ["f_panel"])
def e3(spark, sf):
    p = panel(spark, sf).select("entity", "period_end", F.collect_list(F.struct("net_income")).over(rows_so_far()).alias("history"))
    return p.select("entity", "period_end", F.array_join(
        F.transform("history", lambda h: F.coalesce(h["net_income"].cast("string"), F.lit("-"))), ",").alias("net_income_series"))


@query("e4_lookback_window", f"SELECT entity, period_end, count(*) OVER {W8} AS n_window, min(period_end) OVER {W8} AS oldest FROM f_panel", ["f_panel"])
def e4(spark, sf):
    return panel(spark, sf).select("entity", "period_end", F.count(F.lit(1)).over(recent_rows()).alias("n_window"),
                                   F.min("period_end").over(recent_rows()).alias("oldest"))


@query("e5_last_finite", "SELECT entity, period_end, " + ", ".join(f"l_{c}" for c in ("net_income", "liabilities", "receivables", "short_term_investments")) + " FROM w_win", ["w_win"])
def e5(spark, sf):
    return panel(spark, sf).select("entity", "period_end", *[
        last_finite(F.col(c).cast("double")).alias(f"l_{c}") for c in ("net_income", "liabilities", "receivables", "short_term_investments")])


@query("e6_growth", f"SELECT entity, period_end, round({_growth('CAST(net_income AS DOUBLE)', f'lag(net_income, 4) OVER {WE}')}, 6) AS g FROM f_panel", ["f_panel"])
def e6(spark, sf):
    return panel(spark, sf).select("entity", "period_end", growth(F.col("net_income"), F.lag("net_income", 4).over(entity_rows())).alias("g"))


@query("e7_safe_ratio", f"SELECT entity, period_end, round({_div('net_income', 'inventory')}, 6) AS r FROM f_panel", ["f_panel"])
def e7(spark, sf):
    return panel(spark, sf).select("entity", "period_end", ratio(F.col("net_income"), F.col("inventory")).alias("r"))


@query("e8_min_finite", f"SELECT entity, period_end, min(net_income) OVER {W8} AS worst FROM f_panel", ["f_panel"])
def e8(spark, sf):
    return panel(spark, sf).select("entity", "period_end", F.min("net_income").over(recent_rows()).alias("worst"))


@query("e9_trailing_streak", f"SELECT entity, period_end, {_streak('net_income < 0')} AS neg, {_streak('operating_cash_flow > 0')} AS pos_ocf FROM w_rn", ["w_rn"])
def e9(spark, sf):
    p = panel(spark, sf).withColumn("_rn", row_index())
    return p.select("entity", "period_end", trailing_streak(F.col("net_income") < 0).alias("neg"),
                    trailing_streak(F.col("operating_cash_flow") > 0).alias("pos_ocf"))


@query("e10_total_liabilities", f"SELECT entity, period_end, {_resolve('total_liabilities', 'l_')} AS tl FROM w_win", ["w_win"])
def e10(spark, sf):
    return X.with_windows(panel(spark, sf)).select("entity", "period_end", X.resolve("total_liabilities", "l_").alias("tl"))


@query("e11_resolved_operands", "SELECT entity, period_end, l_revenue - l_cost_of_sales AS margin, l_current_assets - l_inventory AS quick, l_net_income AS ni FROM w_win", ["w_win"])
def e11(spark, sf):
    w = X.with_windows(panel(spark, sf))
    return w.select("entity", "period_end", X.resolve("revenue - cost_of_sales", "l_").alias("margin"),
                    X.resolve("current_assets - inventory", "l_").alias("quick"), X.resolve("net_income", "l_").alias("ni"))


@query("e12_ratio_latest", f"SELECT entity, period_end, round({_ratio('receivables_to_sales', 'l_')}, 6) AS r FROM w_win", ["w_win"])
def e12(spark, sf):
    return X.with_windows(panel(spark, sf)).select("entity", "period_end", X.ratio_of("receivables_to_sales", "l_").alias("r"))


def _group(name, cols):
    @query(name, f"SELECT entity, period_end, {cols_sql(cols)} FROM w_win", ["w_win"])
    def run(spark, sf):
        return X.feature_table(panel(spark, sf)).select("entity", "period_end", *cols)


_group("e13_ratios_latest", FEATURE_GROUPS["ratios_latest"])
_group("e14_ratios_yoy", FEATURE_GROUPS["ratios_yoy"])
_group("e15_indicator_growth", FEATURE_GROUPS["growth"])
_group("e16_working_capital", FEATURE_GROUPS["structure"])
_group("e17_negative_ocf_quarters", ["distress_quarters_in_window"])
_group("e18_revenue_cv", ["revenue_cv"])
_group("e19_worst_in_window", ["current_ratio_min_window", "ocf_to_sales_min_window", "net_margin_min_window"])
_group("e20_revenue_drawdown", ["revenue_drawdown_window"])
_group("e21_negative_streaks", ["negative_ni_streak", "negative_ocf_streak"])


@query("e22_feature_order", " UNION ALL ".join(
    f"SELECT '{n}' AS feature, CAST({i} AS BIGINT) AS pos, count({n}) AS n_known FROM f_feat" for i, n in enumerate(FEATURES)), ["f_feat"])
def e22(spark, sf):
    t = X.feature_table(panel(spark, sf))
    names = [c for c in t.columns if c not in ("entity", "period_end", "n_history")]
    order = F.array(*[F.lit(n) for n in names])
    known = t.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "feature", "n_known")
    return known.withColumn("pos", F.array_position(order, F.col("feature")) - 1)


@query("e23_feature_matrix", f"SELECT entity, period_end, {cols_sql(FEATURES)} FROM w_win", ["w_win"])
def e23(spark, sf):
    return X.feature_table(panel(spark, sf)).drop("n_history")


@query("e24_feature_rows", f"SELECT s.sample_id, s.entity, s.is_distressed, s.n_history, "
       + ", ".join(f"round(f.{n}, 6) AS {n}" for n in FEATURES[:12]) + " FROM (SELECT sample_id, entity, period_end, CAST(is_distressed AS BIGINT) AS is_distressed, n_history FROM f_samples) s JOIN f_feat f USING (entity, period_end)",
       ["f_samples", "f_feat"])
def e24(spark, sf):
    p = S.stress_label(panel(spark, sf), 2)
    nxt = lambda c: F.lead(c).over(entity_rows())
    p = p.withColumn("is_distressed", nxt("label")).withColumn("sample_id", F.when(
        nxt("period_end").isNotNull(), F.concat(F.col("entity").cast("string"), F.lit("-"), nxt("fiscal_year"), F.lit("Q"), nxt("fiscal_quarter"))))
    t = X.feature_table(p, ["is_distressed", "sample_id"]).where(F.col("sample_id").isNotNull())
    return t.select("sample_id", "entity", "is_distressed", "n_history", *FEATURES[:12])


@query("e25_feature_groups", " UNION ALL ".join(
    f"SELECT '{g}' AS feature_group, CAST({len(ns)} AS BIGINT) AS n_features, CAST({' + '.join(f'count({n})' for n in ns)} AS BIGINT) AS n_known FROM f_feat"
    for g, ns in FEATURE_GROUPS.items()), ["f_feat"])
def e25(spark, sf):
    t = X.feature_table(panel(spark, sf))
    known = t.agg(*[sum((F.count(n) for n in ns[1:]), F.count(ns[0])).alias(g) for g, ns in FEATURE_GROUPS.items()])
    size = F.create_map(*[x for g, ns in FEATURE_GROUPS.items() for x in (F.lit(g), F.lit(len(ns)))])
    return known.unpivot([], list(FEATURE_GROUPS), "feature_group", "n_known").withColumn("n_features", size[F.col("feature_group")])


@query("e26_latest_ratio_matrix", f"SELECT entity, period_end, {cols_sql(FEATURE_GROUPS['ratios_latest'])} FROM w_win", ["w_win"])
def e26(spark, sf):
    return X.latest_ratios(panel(spark, sf))


def _g(a, b):
    return _growth(f"l_{a}", f"b_{b}")


SQL["w_extra"] = (["w_rn"], "SELECT entity, period_end, rn, " + ", ".join(
    [f"last_value({_d(c)} IGNORE NULLS) OVER {W8} AS l_{c}" for c in INDICATORS]
    + [f"lag({_d(c)}, 4) OVER {WE} AS b_{c}" for c in ("inventory", "selling_general_admin", "revenue")]
    + [f"lag({_d('net_income')}, 1) OVER {WE} AS b_ni",
       f"sum({_d('net_income')}) OVER f4 AS s_ni", f"sum({_d('operating_cash_flow')}) OVER f4 AS s_ocf",
       "count(CASE WHEN net_income IS NOT NULL AND operating_cash_flow IS NOT NULL THEN 1 END) OVER f4 AS n4",
       f"max({_d('revenue')}) OVER {W8} AS peak",
       f"min({_div('current_assets', 'current_liabilities')}) OVER {W8} AS current_ratio_min_8q",
       f"min({_div('operating_cash_flow', 'revenue')}) OVER {W8} AS ocf_to_sales_min_8q",
       f"min({_div('net_income', 'revenue')}) OVER {W8} AS net_margin_min_8q",
       f"{_streak('net_income < 0')} AS neg_ni_streak", f"{_streak('operating_cash_flow < 0')} AS neg_ocf_streak"])
    + " FROM w_rn WINDOW f4 AS (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
_TL, _WC = "(l_total_assets - l_stockholders_equity)", "(l_current_assets - l_current_liabilities)"
EXTRA_SQL = {
    "liab_derived_to_assets": _div(_TL, "l_total_assets"), "liab_derived_to_equity": _div(_TL, "l_stockholders_equity"),
    "equity_to_assets": _div("l_stockholders_equity", "l_total_assets"),
    "accruals_to_assets": _div("(l_net_income - l_operating_cash_flow)", "l_total_assets"),
    "accruals4_to_assets": f"CASE WHEN n4 = 4 THEN {_div('(s_ni - s_ocf)', 'l_total_assets')} END",
    "days_inventory": f"9125e-2 * {_div('l_inventory', 'l_cost_of_sales')}",
    "days_receivables": f"9125e-2 * {_div('l_receivables', 'l_revenue')}",
    "inventory_growth_minus_revenue_growth": f"CASE WHEN rn >= 5 THEN {_g('inventory', 'inventory')} - {_g('revenue', 'revenue')} END",
    "selling_general_admin_growth_minus_revenue_growth":
        f"CASE WHEN rn >= 5 THEN {_g('selling_general_admin', 'selling_general_admin')} - {_g('revenue', 'revenue')} END",
    "current_ratio_min_8q": "current_ratio_min_8q", "ocf_to_sales_min_8q": "ocf_to_sales_min_8q",
    "net_margin_min_8q": "net_margin_min_8q",
    "revenue_drawdown_8q": "CASE WHEN peak > 0 THEN l_revenue / peak - 1 END",
    "neg_ni_streak": "neg_ni_streak", "neg_ocf_streak": "neg_ocf_streak",
    "altman_z_book": f"12e-1*{_div(_WC, 'l_total_assets')} + 14e-1*{_div('l_retained_earnings', 'l_total_assets')} + 33e-1*{_div('l_operating_income', 'l_total_assets')} + 6e-1*{_div('l_stockholders_equity', _TL)} + {_div('l_revenue', 'l_total_assets')}",
    "ohlson_o": f"-132e-2 + CASE WHEN l_total_assets > 0 THEN -407e-3*ln(l_total_assets) ELSE 0e0 END + 603e-2*{_div(_TL, 'l_total_assets')} - 143e-2*{_div(_WC, 'l_total_assets')} + 757e-4*{_div('l_current_liabilities', 'l_current_assets')} - 172e-2*CASE WHEN {_TL} > l_total_assets THEN 1 ELSE 0 END - 237e-2*{_div('l_net_income', 'l_total_assets')} - 183e-2*{_div('l_operating_cash_flow', _TL)} + 285e-3*neg_ni_streak - 521e-3*{_div('(l_net_income - b_ni)', '(abs(l_net_income) + abs(b_ni))')}",
}


@query("e27_extra_features", "SELECT entity, period_end, " + ", ".join(f"round({v}, 5) AS {k}" for k, v in EXTRA_SQL.items()) + " FROM w_extra", ["w_extra"], digits=5)
def e27(spark, sf):
    return X.extra_features(panel(spark, sf))


@query("e28_design_table", "SELECT f.entity, f.period_end, n_history, " + ", ".join(f"round(f.{n}, 5) AS {n}" for n in FEATURES[:6]) + ", "
       + ", ".join(f"round({EXTRA_SQL[k]}, 5) AS {k}" for k in ("altman_z_book", "ohlson_o"))
       + " FROM f_feat f JOIN w_extra x ON f.entity = x.entity AND f.period_end = x.period_end", ["f_feat", "w_extra"], digits=5)
def e28(spark, sf):
    return X.design_table(panel(spark, sf), ["altman_z_book", "ohlson_o"]).select(
        "entity", "period_end", "n_history", *FEATURES[:6], "altman_z_book", "ohlson_o")


@query("e29_legacy_matrix", f"""SELECT entity, period_end, round({_div('l_liabilities', 'l_total_assets')}, 6) AS debt_to_assets_latest,
  round({_div('l_liabilities', 'l_stockholders_equity')}, 6) AS debt_to_equity_latest, {cols_sql(['gross_margin_latest', 'revenue_cv'])} FROM w_win""", ["w_win"])
def e29(spark, sf):
    return X.legacy_table(panel(spark, sf)).select("entity", "period_end", "debt_to_assets_latest", "debt_to_equity_latest",
                                                   "gross_margin_latest", "revenue_cv")


PROFILE_DEFAULTS = {"current_ratio": 1.5, "debt_to_assets": 0.6, "net_margin": 0.03, "ocf_to_sales": 0.05,
                    "receivables_to_sales": 0.4, "retained_to_assets": 0.1}


@query("e31_profile_of_sample", "SELECT entity, period_end, " + ", ".join(
    f"round(coalesce({_ratio(r, 'l_')}, CAST({v} AS DOUBLE)), 6) AS {r}" for r, v in PROFILE_DEFAULTS.items()) + " FROM w_win", ["w_win"])
def e31(spark, sf):
    return X.profile_of(X.latest_ratios(panel(spark, sf)), PROFILE_DEFAULTS)


@query("e32_calendar_quarter", "SELECT concat('Q', quarter(period_end)) AS q, count(*) AS n FROM f_panel GROUP BY 1", ["f_panel"])
def e32(spark, sf):
    return panel(spark, sf).groupBy(F.concat(F.lit("Q"), F.quarter("period_end")).alias("q")).agg(F.count(F.lit(1)).alias("n"))


@query("e33_quarter_days", "SELECT entity, period_end, CAST(period_end - period_start AS BIGINT) AS days FROM f_panel", ["f_panel"])
def e33(spark, sf):
    return panel(spark, sf).select("entity", "period_end", F.datediff("period_end", "period_start").alias("days"))


@query("e34_tolerant_equality", f"""SELECT entity, period_end, CAST(CASE WHEN a IS NULL AND b IS NULL THEN 1 WHEN a IS NULL OR b IS NULL THEN 0
  WHEN abs(a - b) <= 1e-2 THEN 1 ELSE 0 END AS BIGINT) AS same FROM (SELECT entity, period_end, {_div('net_income', 'revenue')} AS a,
  lag({_div('net_income', 'revenue')}) OVER {WE} AS b FROM f_panel)""", ["f_panel"])
def e34(spark, sf):
    p = panel(spark, sf).select("entity", "period_end", ratio(F.col("net_income"), F.col("revenue")).alias("a"))
    p = p.withColumn("b", F.lag("a").over(entity_rows()))
    return p.select("entity", "period_end", close(F.col("a"), F.col("b"), 1e-2).alias("same"))


@query("e35_stable_rounding", f"SELECT entity, period_end, round({_div('revenue', 'current_liabilities')}, 3) AS r3 FROM f_panel", ["f_panel"])
def e35(spark, sf):
    return panel(spark, sf).select("entity", "period_end", stable(ratio(F.col("revenue"), F.col("current_liabilities")), 3).alias("r3"))
