"""Queries D*: samples, labels, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.panel import entity_rows, rows_so_far
from ..functions.scalars import altman_z, total_liabilities
from ..operators import samples as S
from ..constants import INDICATORS
from .features import SIG, WE, _d, _div, samples2
from .registry import query
from .views import SQL, panel, table

_Z = ("656e-2*" + _div("(current_assets - current_liabilities)", "total_assets")
      + " + 326e-2*" + _div("retained_earnings", "total_assets") + " + 672e-2*" + _div("operating_income", "total_assets")
      + " + 105e-2*" + _div("stockholders_equity", "coalesce(liabilities, total_assets - stockholders_equity)"))
SQL["f_z"] = (["w_rn"], f"SELECT *, {_Z} AS z FROM w_rn")
SQL["f_fwd"] = (["f_lab"], f"""SELECT *, coalesce(max(label2) OVER ahead, 0) AS fwd, count(*) OVER ahead AS observed, max(available_on) OVER ahead AS known_on
  FROM f_lab WINDOW ahead AS (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
_FIRED = "concat_ws(',', " + ", ".join(f"CASE WHEN s{i} = 1 THEN '{k}' END" for i, k in enumerate(SIG)) + ")"


@query("d1_sample_construction", """SELECT sample_id, entity, period_end, as_of, n_history, target_fiscal_year, target_fiscal_quarter, target_period_start,
  target_period_end, label_available_on, fiscal_year FROM (SELECT * REPLACE (CAST(target_fiscal_year AS BIGINT) AS target_fiscal_year,
  CAST(target_fiscal_quarter AS BIGINT) AS target_fiscal_quarter, CAST(fiscal_year AS BIGINT) AS fiscal_year) FROM f_samples)""", ["f_samples"])
def d1(spark, sf):
    return S.make_samples(panel(spark, sf), ["fiscal_year"])


def _stored_labels(spark, sf):
    """Labels of an earlier run for two thirds of the samples; some lack their date."""
    s = S.rule_samples(panel(spark, sf), "stress_signals", 1)
    return s.where("entity % 3 <> 0").select(
        "sample_id", F.col("is_distressed").alias("old_label"),
        F.when(F.col("target_fiscal_quarter") != 2, F.col("label_available_on")).alias("old_label_available_on"))


@query("d2_label_carry_over", f"""SELECT sample_id, CAST(CASE WHEN entity % 3 <> 0 THEN l1 ELSE coalesce(CAST(tni < 0 AS INT), 0) END AS BIGINT) AS carried_label,
  label_available_on AS carried_on, CAST(entity % 3 <> 0 AS BIGINT) AS was_known FROM (
  SELECT entity, concat(entity, '-', lead(fiscal_year) OVER {WE}, 'Q', lead(fiscal_quarter) OVER {WE}) AS sample_id, lead(net_income) OVER {WE} AS tni,
  lead(CASE WHEN n_signals >= 1 THEN 1 ELSE 0 END) OVER {WE} AS l1, lead(available_on) OVER {WE} AS label_available_on FROM f_lab) WHERE label_available_on IS NOT NULL""", ["f_lab"])
def d2(spark, sf):
    p = panel(spark, sf).withColumn("target_net_income", F.lead("net_income").over(entity_rows()))
    s = S.make_samples(p, ["target_net_income"])
    out = S.carry_over_labels(s, _stored_labels(spark, sf), F.col("target_net_income") < 0)
    return out.select("sample_id", "carried_label", "carried_on", "was_known")


@query("d3_history_projection", "SELECT entity, CAST(fiscal_year AS BIGINT) AS fiscal_year, CAST(fiscal_quarter AS BIGINT) AS fiscal_quarter, period_start, period_end, available_on, "
       + ", ".join(INDICATORS) + " FROM f_panel", ["f_panel"])
def d3(spark, sf):
    return panel(spark, sf).select("entity", "fiscal_year", "fiscal_quarter", "period_start", "period_end", "available_on", *INDICATORS)


@query("d4_time_split", "SELECT sample_id, split FROM f_split", ["f_split"])
def d4(spark, sf):
    return samples2(spark, sf).select("sample_id", "split")


@query("d5_test_ranges", "SELECT entity, min(target_period_start) AS first_start, max(target_period_end) AS last_end, count(*) AS n_test FROM f_split WHERE split = 'test' GROUP BY 1", ["f_split"])
def d5(spark, sf):
    return S.test_ranges(samples2(spark, sf))


@query("d6_expected_split", """SELECT coalesce(e.split, 'none') AS expected, coalesce(s.split, 'none') AS stored, count(*) AS n FROM f_split e
  FULL JOIN (SELECT sample_id, CASE WHEN entity % 10 = 0 AND split = 'purged' THEN 'train' ELSE split END AS split FROM f_split WHERE entity % 17 <> 0) s USING (sample_id) GROUP BY 1, 2""", ["f_split"])
def d6(spark, sf):
    from ..operators.audit import split_reconciliation
    good = samples2(spark, sf).select("sample_id", "entity", "split")
    stored = good.where("entity % 17 <> 0").withColumn(
        "split", F.when((F.col("entity") % 10 == 0) & (F.col("split") == "purged"), "train").otherwise(F.col("split")))
    return split_reconciliation(good, stored).groupBy("expected", "stored").agg(F.count(F.lit(1)).alias("n"))


@query("d7_parse_sample_id", r"""SELECT sample_id, nullif(regexp_extract(sample_id, '^([A-Z0-9]+)-(\d{4})Q([1-4])$', 1), '') AS id_entity,
  CAST(nullif(regexp_extract(sample_id, '^([A-Z0-9]+)-(\d{4})Q([1-4])$', 2), '') AS BIGINT) AS id_year,
  CAST(nullif(regexp_extract(sample_id, '^([A-Z0-9]+)-(\d{4})Q([1-4])$', 3), '') AS BIGINT) AS id_quarter,
  CAST(regexp_matches(sample_id, '^([A-Z0-9]+)-(\d{4})Q([1-4])$') AS BIGINT) AS well_formed FROM (
  SELECT sample_id FROM f_samples UNION ALL SELECT replace(sample_id, 'Q', '/') FROM f_samples)""", ["f_samples"])
def d7(spark, sf):
    ids = S.make_samples(panel(spark, sf)).select("sample_id")
    ids = ids.union(ids.select(F.replace("sample_id", F.lit("Q"), F.lit("/"))))
    return ids.select("sample_id", *S.parse_sample_id(F.col("sample_id")))


@query("d8_min_history_filter", "SELECT sample_id, n_history FROM f_samples WHERE n_history >= 5", ["f_samples"])
def d8(spark, sf):
    return S.filter_by_history(S.make_samples(panel(spark, sf)), 5).select("sample_id", "n_history")


@query("d9_history_length", "SELECT sample_id, n_history FROM f_samples", ["f_samples"])
def d9(spark, sf):
    return S.make_samples(panel(spark, sf)).select("sample_id", "n_history")


@query("d10_label_vector", "SELECT sample_id, CAST(is_distressed AS BIGINT) AS y FROM f_samples", ["f_samples"])
def d10(spark, sf):
    return samples2(spark, sf).select("sample_id", F.col("is_distressed").cast("int").alias("y"))


@query("d11_stress_signals", "SELECT entity, period_end, " + ", ".join(f"CAST(s{i} AS BIGINT) AS s{i}" for i in range(6)) + " FROM f_sig", ["f_sig"])
def d11(spark, sf):
    flags = list(S.signal_columns().values())
    return panel(spark, sf).select("entity", "period_end", *[c.alias(f"s{i}") for i, c in enumerate(flags)])


@query("d12_rule_label", f"SELECT entity, period_end, CAST(label2 AS BIGINT) AS label, {_FIRED} AS fired FROM f_lab", ["f_lab"])
def d12(spark, sf):
    return S.stress_label(panel(spark, sf), 2).select("entity", "period_end", "label", F.array_join("fired", ",").alias("fired"))


@query("d13_total_liabilities", "SELECT entity, period_end, coalesce(liabilities, total_assets - stockholders_equity) AS tl FROM f_panel", ["f_panel"])
def d13(spark, sf):
    return panel(spark, sf).select("entity", "period_end", total_liabilities(
        F.col("liabilities"), F.col("total_assets"), F.col("stockholders_equity")).alias("tl"))


@query("d14_altman_z", "SELECT entity, period_end, round(z, 6) AS z FROM f_z", ["f_z"])
def d14(spark, sf):
    return panel(spark, sf).select("entity", "period_end", altman_z().alias("z"))


@query("d15_altman_label", "SELECT entity, period_end, CAST(coalesce(CAST(z < 11e-1 AS INT), 0) AS BIGINT) AS label, CAST(z IS NULL AS BIGINT) AS z_missing FROM f_z", ["f_z"])
def d15(spark, sf):
    return S.altman_label(panel(spark, sf)).select("entity", "period_end", "label", "z_missing")


_STEPS = ", ".join(
    f"CASE WHEN lead(label2, {k}) OVER {WE} = 1 THEN concat('q+{k}:', lead(fired, {k}) OVER {WE}) END" for k in range(1, 5))


@query("d16_forward_label", f"""SELECT entity, period_end, CAST(fwd AS BIGINT) AS label, observed AS observed_quarters, known_on AS label_known_on,
  concat_ws(';', {_STEPS}) AS fired_ahead FROM (SELECT *, {_FIRED} AS fired FROM f_fwd)""", ["f_fwd"])
def d16(spark, sf):
    return S.forward_label(panel(spark, sf), 2).select(
        "entity", "period_end", "label", "observed_quarters", "label_known_on", F.array_join("fired_ahead", ";").alias("fired_ahead"))


@query("d17_label_by_rule", """SELECT rule, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM (
  SELECT 'stress_signals' AS rule, CASE WHEN n_signals >= 1 THEN 1 ELSE 0 END AS label FROM f_lab
  UNION ALL SELECT 'altman_z', coalesce(CAST(z < 11e-1 AS INT), 0) FROM f_z
  UNION ALL SELECT 'forward_4q', coalesce(max(CASE WHEN n_signals >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY period_end ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) FROM f_lab) GROUP BY rule""", ["f_lab", "f_z"])
def d17(spark, sf):
    p = panel(spark, sf)
    parts = [S.label_by_rule(r, p).select(F.lit(r).alias("rule"), "label") for r in S.LABEL_RULES]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query("d18_rule_samples", f"""SELECT sample_id, n_history, CAST(l1 AS BIGINT) AS is_distressed FROM (SELECT concat(entity, '-', lead(fiscal_year) OVER {WE}, 'Q', lead(fiscal_quarter) OVER {WE}) AS sample_id,
  rn AS n_history, lead(CASE WHEN n_signals >= 1 THEN 1 ELSE 0 END) OVER {WE} AS l1 FROM f_lab) WHERE l1 IS NOT NULL""", ["f_lab"])
def d18(spark, sf):
    return S.rule_samples(panel(spark, sf)).select("sample_id", "n_history", "is_distressed")


@query("d19_samples_any_rule", f"""SELECT sample_id, CAST(lead_fwd AS BIGINT) AS is_distressed FROM (SELECT concat(entity, '-', lead(fiscal_year) OVER {WE}, 'Q', lead(fiscal_quarter) OVER {WE}) AS sample_id,
  lead(fwd) OVER {WE} AS lead_fwd FROM f_fwd) WHERE lead_fwd IS NOT NULL""", ["f_fwd"])
def d19(spark, sf):
    return S.rule_samples(panel(spark, sf), "forward_4q", 2).select("sample_id", "is_distressed")


@query("d20_label_agreement", """SELECT rule, count(*) AS n, round(avg(CAST(label = base AS INT)), 6) AS agreement, round(avg(label), 6) AS positive_rate,
  round(greatest(sum(label), count(*) - sum(label)) / nullif(CAST(least(sum(label), count(*) - sum(label)) AS DOUBLE), 0), 6) AS imbalance_ratio FROM (
  SELECT 'altman_z' AS rule, coalesce(CAST(z.z < 11e-1 AS INT), 0) AS label, label2 AS base, z.rn FROM f_z z JOIN f_lab USING (entity, period_end)
  UNION ALL SELECT 'forward_4q', fwd, label2, rn FROM f_fwd) WHERE rn > 1 GROUP BY rule""", ["f_z", "f_lab", "f_fwd"])
def d20(spark, sf):
    from ..operators.profiles import label_agreement
    p = panel(spark, sf)
    base = S.rule_samples(p, "stress_signals", 2).select("sample_id", F.col("is_distressed").alias("base"))
    return label_agreement({r: S.rule_samples(p, r, 2) for r in ("altman_z", "forward_4q")}, base)


_RULES = {
    "net_income<0": "coalesce({p}net_income, 0) < 0", "operating_income<0": "coalesce({p}operating_income, 0) < 0",
    "operating_cash_flow<0": "coalesce({p}operating_cash_flow, 0) < 0",
    "ocf_or_ni<0": "(coalesce({p}operating_cash_flow, 0) < 0 OR coalesce({p}net_income, 0) < 0)",
    "current_liabilities>current_assets": "coalesce({p}current_liabilities, 0) > coalesce({p}current_assets, 0)",
    "stockholders_equity<0": "coalesce({p}stockholders_equity, 0) < 0", "retained_earnings<0": "coalesce({p}retained_earnings, 0) < 0",
}
_CUR = "WITH a AS (SELECT *, " + ", ".join(f"lag({c}) OVER {WE} AS h_{c}" for c in (
    "net_income", "operating_income", "operating_cash_flow", "current_liabilities", "current_assets", "stockholders_equity", "retained_earnings")) + " FROM f_lab) "


@query("d21_rule_agreement_audit", _CUR + " UNION ALL ".join(
    [f"SELECT '{k}' AS rule, round(avg(CAST(CAST({v.format(p='')} AS INT) = label2 AS INT)), 6) AS target_agreement, round(avg(CAST(CAST({v.format(p='h_')} AS INT) = label2 AS INT)), 6) AS history_agreement FROM a WHERE rn > 1"
     for k, v in _RULES.items()]
    + [f"SELECT 'stress_signals>={k}', round(avg(CAST(CAST(n_signals >= {k} AS INT) = label2 AS INT)), 6), NULL FROM a WHERE rn > 1" for k in (1, 2)]), ["f_lab"])
def d21(spark, sf):
    from ..operators.profiles import rule_agreement
    return rule_agreement(S.stress_label(panel(spark, sf), 2))


@query("d22_history_arrays", f"""SELECT entity, period_end, CAST(len(h) AS BIGINT) AS n, round(list_sum(h), 6) AS revenue_seen FROM (
  SELECT entity, period_end, list({_d('revenue')}) OVER (PARTITION BY entity ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h, lead(period_end) OVER {WE} AS t FROM f_panel) WHERE t IS NOT NULL""", ["f_panel"])
def d22(spark, sf):
    s = S.with_history(panel(spark, sf), ["revenue"])
    return s.select("entity", "period_end", F.size("history").alias("n"),
                    F.aggregate("history", F.lit(0.0), lambda acc, h: acc + h["revenue"].cast("double")).alias("revenue_seen"))
