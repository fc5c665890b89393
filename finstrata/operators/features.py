"""The 47 window features, the 17 extra features, and their groupings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import FEATURES, FEATURE_GROUPS, GROWTH_FIELDS, INDICATORS, RATIOS
from ..functions.panel import earlier_rows, entity_rows, recent_rows, last_finite, row_index, trailing_streak
from ..functions.scalars import growth, ratio, total_liabilities

EXTRA_FEATURES = [
    "liab_derived_to_assets", "liab_derived_to_equity", "equity_to_assets",
    "accruals_to_assets", "accruals4_to_assets",
    "days_inventory", "days_receivables",
    "inventory_growth_minus_revenue_growth", "selling_general_admin_growth_minus_revenue_growth",
    "current_ratio_min_8q", "ocf_to_sales_min_8q", "net_margin_min_8q", "revenue_drawdown_8q",
    "neg_ni_streak", "neg_ocf_streak", "altman_z_book", "ohlson_o",
]


def resolve(expr: str, prefix: str) -> Column:
    """An operand of a ratio over already windowed columns; each part is its own last known value."""
    if expr.strip() == "total_liabilities":
        return total_liabilities(*(F.col(prefix + c) for c in ("liabilities", "total_assets", "stockholders_equity")))
    parts = [F.col(prefix + p.strip()) for p in expr.split(" - ")]
    return parts[0] if len(parts) == 1 else parts[0] - parts[1]


def ratio_of(name: str, prefix: str, registry: dict[str, tuple[str, str]] = RATIOS) -> Column:
    num, den = registry[name]
    return ratio(resolve(num, prefix), resolve(den, prefix))


def with_windows(panel: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Latest (``l_``) and year-ago (``p_``) known value per indicator plus the path and stress windows.

    Every expression uses the same partitioning and ordering: one exchange, one sort.
    """
    d = lambda c: F.col(c).cast("double")
    row_ratio = lambda a, b: ratio(F.col(a), F.col(b))
    base = panel.withColumn("_rn", row_index())
    return base.select(
        "entity", "period_end", *keep, F.col("_rn").alias("n_history"),
        *[last_finite(d(c)).alias(f"l_{c}") for c in INDICATORS],
        *[last_finite(d(c), earlier_rows()).alias(f"p_{c}") for c in INDICATORS],
        F.coalesce(F.sum(F.when(d("operating_cash_flow") < 0, 1.0)).over(recent_rows()), F.lit(0.0)).alias("w_ocf_neg"),
        F.count("revenue").over(recent_rows()).alias("w_rev_n"),
        F.avg(d("revenue")).over(recent_rows()).alias("w_rev_mean"),
        F.stddev_pop(d("revenue")).over(recent_rows()).alias("w_rev_sd"),
        F.max(d("revenue")).over(recent_rows()).alias("w_rev_peak"),
        F.min(row_ratio("current_assets", "current_liabilities")).over(recent_rows()).alias("current_ratio_min_window"),
        F.min(row_ratio("operating_cash_flow", "revenue")).over(recent_rows()).alias("ocf_to_sales_min_window"),
        F.min(row_ratio("net_income", "revenue")).over(recent_rows()).alias("net_margin_min_window"),
        trailing_streak(F.col("net_income") < 0).alias("negative_ni_streak"),
        trailing_streak(F.col("operating_cash_flow") < 0).alias("negative_ocf_streak"),
    )


def feature_columns(registry: dict[str, tuple[str, str]] = RATIOS) -> list[Column]:
    """The feature projections over ``with_windows``; a user may pass further ratios."""
    enough = F.col("n_history") >= 5
    out: list[Column] = []
    for name in registry:
        latest = ratio_of(name, "l_", registry)
        out += [
            latest.alias(f"{name}_latest"),
            F.when(enough, growth(latest, ratio_of(name, "p_", registry))).alias(f"{name}_yoy"),
        ]
    out += [F.when(enough, growth(F.col(f"l_{g}"), F.col(f"p_{g}"))).alias(f"{g}_yoy_growth") for g in GROWTH_FIELDS]
    out += [
        ratio(F.col("l_current_assets") - F.col("l_current_liabilities"), F.col("l_total_assets")).alias(
            "working_capital_to_assets"
        ),
        F.col("w_ocf_neg").alias("distress_quarters_in_window"),
        F.when(F.col("w_rev_n") > 1, F.try_divide(F.col("w_rev_sd"), F.col("w_rev_mean"))).alias("revenue_cv"),
        F.col("current_ratio_min_window"), F.col("ocf_to_sales_min_window"), F.col("net_margin_min_window"),
        F.when(F.col("w_rev_peak") > 0, F.col("l_revenue") / F.col("w_rev_peak") - 1.0).alias("revenue_drawdown_window"),
        F.col("negative_ni_streak"), F.col("negative_ocf_streak"),
    ]
    return out


def feature_table(panel: DataFrame, keep: Sequence[str] = (), registry: dict[str, tuple[str, str]] = RATIOS) -> DataFrame:
    """(entity, period_end, *keep, n_history, 47 features), one row per panel row."""
    return with_windows(panel, keep).select("entity", "period_end", *keep, "n_history", *feature_columns(registry))


def latest_ratios(panel: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return with_windows(panel, keep).select(
        "entity", "period_end", *keep, *[ratio_of(r, "l_").alias(f"{r}_latest") for r in RATIOS]
    )


def strict_history(panel: DataFrame, as_of: str = "as_of") -> DataFrame:
    """Keep only rows already published at the decision time of the row that uses them."""
    return panel.where(F.col("available_on") <= F.col(as_of))


def extra_features(panel: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Seventeen further features: leverage, accruals, days, growth gaps, path, two bankruptcy scores.

    The year-ago base here is exactly four rows back (a missing value there stays missing).
    """
    d = lambda c: F.col(c).cast("double")
    names = ["total_assets", "stockholders_equity", "current_assets", "current_liabilities", "inventory",
             "receivables", "revenue", "cost_of_sales", "net_income", "operating_cash_flow", "operating_income",
             "retained_earnings", "selling_general_admin"]
    four = entity_rows().rowsBetween(-3, 0)
    row_ratio = lambda a, b: ratio(F.col(a), F.col(b))
    w = panel.withColumn("_rn", row_index()).select(
        "entity", "period_end", *keep, "_rn",
        *[last_finite(d(c)).alias(f"l_{c}") for c in names],
        *[F.lag(d(c), 4).over(entity_rows()).alias(f"b_{c}") for c in ("inventory", "selling_general_admin", "revenue")],
        F.lag(d("net_income"), 1).over(entity_rows()).alias("b_ni"),
        F.sum(d("net_income")).over(four).alias("s_ni"), F.sum(d("operating_cash_flow")).over(four).alias("s_ocf"),
        F.count(F.when(F.col("net_income").isNotNull() & F.col("operating_cash_flow").isNotNull(), 1)).over(four).alias("n4"),
        F.max(d("revenue")).over(recent_rows()).alias("peak"),
        F.min(row_ratio("current_assets", "current_liabilities")).over(recent_rows()).alias("current_ratio_min_8q"),
        F.min(row_ratio("operating_cash_flow", "revenue")).over(recent_rows()).alias("ocf_to_sales_min_8q"),
        F.min(row_ratio("net_income", "revenue")).over(recent_rows()).alias("net_margin_min_8q"),
        trailing_streak(F.col("net_income") < 0).alias("neg_ni_streak"),
        trailing_streak(F.col("operating_cash_flow") < 0).alias("neg_ocf_streak"),
    )
    g = lambda c: F.col("l_" + c)
    ta, eq, ca, cl = g("total_assets"), g("stockholders_equity"), g("current_assets"), g("current_liabilities")
    ni, ocf, rev = g("net_income"), g("operating_cash_flow"), g("revenue")
    tl, wc = ta - eq, ca - cl
    gap = lambda c: F.when(
        F.col("_rn") >= 5, growth(g(c), F.col(f"b_{c}")) - growth(rev, F.col("b_revenue"))
    ).alias(f"{c}_growth_minus_revenue_growth")
    ohlson = (
        -1.32
        + F.when(ta > 0, -0.407 * F.ln(ta)).otherwise(0.0)
        + 6.03 * ratio(tl, ta) - 1.43 * ratio(wc, ta) + 0.0757 * ratio(cl, ca)
        - 1.72 * F.when(tl > ta, 1.0).otherwise(0.0)
        - 2.37 * ratio(ni, ta) - 1.83 * ratio(ocf, tl)
        + 0.285 * F.col("neg_ni_streak")
        - 0.521 * ratio(ni - F.col("b_ni"), F.abs(ni) + F.abs(F.col("b_ni")))
    )
    return w.select(
        "entity", "period_end", *keep,
        ratio(tl, ta).alias("liab_derived_to_assets"), ratio(tl, eq).alias("liab_derived_to_equity"),
        ratio(eq, ta).alias("equity_to_assets"),
        ratio(ni - ocf, ta).alias("accruals_to_assets"),
        F.when(F.col("n4") == 4, ratio(F.col("s_ni") - F.col("s_ocf"), ta)).alias("accruals4_to_assets"),
        (91.25 * ratio(g("inventory"), g("cost_of_sales"))).alias("days_inventory"),
        (91.25 * ratio(g("receivables"), rev)).alias("days_receivables"),
        gap("inventory"), gap("selling_general_admin"),
        "current_ratio_min_8q", "ocf_to_sales_min_8q", "net_margin_min_8q",
        F.when(F.col("peak") > 0, rev / F.col("peak") - 1.0).alias("revenue_drawdown_8q"),
        "neg_ni_streak", "neg_ocf_streak",
        (1.2 * ratio(wc, ta) + 1.4 * ratio(g("retained_earnings"), ta) + 3.3 * ratio(g("operating_income"), ta)
         + 0.6 * ratio(eq, tl) + 1.0 * ratio(rev, ta)).alias("altman_z_book"),
        ohlson.alias("ohlson_o"),
    )


def design_table(panel: DataFrame, extra: Sequence[str] = tuple(EXTRA_FEATURES), keep: Sequence[str] = ()) -> DataFrame:
    """Base and chosen extra features side by side (same key, so the join reuses the entity partitioning)."""
    base = feature_table(panel, keep)
    return base.join(extra_features(panel).select("entity", "period_end", *extra), ["entity", "period_end"])


def legacy_table(panel: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The earlier feature set: leverage from the reported tag only, no path features."""
    raw = dict(RATIOS, debt_to_assets=("liabilities", "total_assets"), debt_to_equity=("liabilities", "stockholders_equity"))
    return feature_table(panel, keep, raw).drop(*FEATURE_GROUPS["path"])


def profile_of(features: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """A few ratios per sample, missing ones replaced by reference constants."""
    return features.select(
        "entity", "period_end",
        *[F.coalesce(F.col(f"{r}_latest"), F.lit(v)).alias(r) for r, v in defaults.items()],
    )


def unpivot_features(df: DataFrame, ids: Sequence[str], names: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Long (ids, feature, value)."""
    return df.unpivot([F.col(i) for i in ids], [F.col(n).cast("double").alias(n) for n in names], "feature", "value")


def low_coverage(df: DataFrame, names: Sequence[str], share: float = 0.5) -> DataFrame:
    """Features known in less than ``share`` of the rows."""
    stats = df.agg(*[(F.count(n) / F.count(F.lit(1))).alias(n) for n in names])
    return stats.unpivot([], list(names), "feature", "coverage").where(F.col("coverage") < share)
