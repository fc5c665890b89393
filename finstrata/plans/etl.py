"""Queries C*, F1-F3, G1-G3: facts to panel and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DURATION_INDICATORS, INDICATORS, TAGS
from ..functions.scalars import filing_url
from ..operators import facts as C
from ..operators.models import materialize
from .registry import query
from .views import SQL, facts, filings, panel, table

_PRIO = [(i, "duration" if i in DURATION_INDICATORS else "instant", t, k) for i in INDICATORS for k, t in enumerate(TAGS[i])]
SQL["f_tags"] = ([], "SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{k}', '{t}', {p})" for i, k, t, p in _PRIO) + ") AS v(indicator, kind, tag, prio)")
SQL["f_usd"] = (["f_facts", "f_tags"], "SELECT f.*, t.indicator, t.kind, t.prio FROM f_facts f JOIN f_tags t ON f.tag = t.tag WHERE unit = 'USD' AND val IS NOT NULL")
SQL["f_here"] = (["f_usd", "f_panel"], """SELECT u.*, p.fiscal_year, p.fiscal_quarter, p.period_start, p.period_end, p.available_on FROM f_usd u JOIN f_panel p
  ON u.entity = p.entity AND u.end_d = p.period_end WHERE u.filed <= p.available_on""")
SQL["f_cells"] = (["f_here", "f_usd", "f_panel"], """
SELECT g.entity, g.fiscal_year, g.fiscal_quarter, g.period_start, g.period_end, g.available_on, g.indicator, coalesce(b.method, 'absent') AS method, b.value, b.accn AS accn, b.tag AS tag
FROM (SELECT p.entity, fiscal_year, fiscal_quarter, period_start, period_end, available_on, i.indicator FROM f_panel p, (SELECT DISTINCT indicator FROM f_tags) i) g
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, period_end, indicator ORDER BY prio, branch, filed, accn) AS k FROM (
  SELECT entity, period_end, indicator, prio, 0 AS branch, filed, accn, tag, CASE WHEN kind = 'instant' THEN 'instant' WHEN fiscal_quarter = 1 THEN 'reported_first_quarter' ELSE 'reported_quarter' END AS method, val AS value
  FROM f_here WHERE (kind = 'instant' AND start_d IS NULL) OR (kind = 'duration' AND start_d = period_start)
  UNION ALL
  SELECT c.entity, c.period_end, c.indicator, c.prio, 1, c.filed, c.accn, c.tag, 'current_ytd_minus_previous_ytd', c.val - q.val FROM (
    SELECT *, (SELECT max(e.end_d) FROM f_usd e WHERE e.entity = c0.entity AND e.tag = c0.tag AND e.start_d = c0.start_d AND e.end_d < c0.period_end AND e.kind = 'duration') AS prev_end
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, period_end, indicator, prio ORDER BY filed, accn) AS kk FROM f_here WHERE kind = 'duration' AND start_d < period_start) WHERE kk = 1) c0) c
  JOIN (SELECT * FROM f_usd WHERE kind = 'duration') q ON q.entity = c.entity AND q.tag = c.tag AND q.start_d = c.start_d AND q.end_d = c.prev_end AND q.filed <= c.available_on)) WHERE k = 1) b
ON b.entity = g.entity AND b.period_end = g.period_end AND b.indicator = g.indicator""")


def landed(spark, sf):
    """Facts and periods written once: the derivation reads the facts three times, as it would a landed table."""
    return materialize(facts(spark, sf)), materialize(panel(spark, sf))


def cells(spark, sf):
    return C.derive_cells(*landed(spark, sf))


def _first(c, f):
    return F.get(F.col(c), F.lit(0))[f]


@query("c1_tag_priority", "SELECT indicator, kind, tag, CAST(prio AS BIGINT) AS prio, count(f.entity) AS n_facts FROM f_tags LEFT JOIN f_facts f USING (tag) GROUP BY 1, 2, 3, 4", ["f_tags", "f_facts"])
def c1(spark, sf):
    n = facts(spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return C.tag_table(spark).join(n, "tag", "left").select("indicator", "kind", "tag", "prio", F.coalesce("n", F.lit(0)).alias("n_facts"))


@query("c2_facts_of_known_tags", "SELECT tag, count(*) AS n FROM f_facts WHERE tag IN (SELECT tag FROM f_tags) GROUP BY tag", ["f_facts", "f_tags"])
def c2(spark, sf):
    return facts(spark, sf).join(C.tag_table(spark).select("tag").distinct(), "tag", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("c3_instant_or_duration", "SELECT kind, count(DISTINCT indicator) AS n_indicators, count(f.entity) AS n_facts FROM f_tags LEFT JOIN f_facts f USING (tag) GROUP BY kind", ["f_tags", "f_facts"])
def c3(spark, sf):
    n = facts(spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return C.tag_table(spark).join(n, "tag", "left").groupBy("kind").agg(
        F.countDistinct("indicator").alias("n_indicators"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_facts"))


@query("c4_published_asof_pick", """SELECT entity, period_end, val, accn, filed FROM (SELECT *, row_number() OVER (PARTITION BY entity, period_end ORDER BY filed, accn) AS k
  FROM f_here WHERE tag = 'Assets' AND start_d IS NULL) WHERE k = 1""", ["f_here"])
def c4(spark, sf):
    f = facts(spark, sf).where("tag = 'Assets' and start_d is null").select("entity", "end_d", "val", "accn", "filed")
    p = panel(spark, sf).select("entity", "period_end", "available_on")
    c = f.join(p, (f.entity == p.entity) & (f.end_d == p.period_end)).select(f.entity, "period_end", "available_on", "val", "accn", "filed")
    return C.published_pick(c, ["entity", "period_end"]).drop("available_on")


@query("c4_published_with_late_fallback", """SELECT entity, period_end, val, accn, filed FROM (SELECT f.*, p.period_end, row_number() OVER (PARTITION BY f.entity, p.period_end
  ORDER BY CAST(f.filed > p.available_on AS INT), f.filed, f.accn) AS k FROM f_facts f JOIN f_panel p ON f.entity = p.entity AND f.end_d = p.period_end
  WHERE f.tag = 'Assets' AND f.accn LIKE '%b') WHERE k = 1""", ["f_facts", "f_panel"])
def c4b(spark, sf):
    f = facts(spark, sf).where("tag = 'Assets' and accn like '%b'").select("entity", "end_d", "val", "accn", "filed")
    p = panel(spark, sf).select("entity", "period_end", "available_on")
    c = f.join(p, (f.entity == p.entity) & (f.end_d == p.period_end)).select(f.entity, "period_end", "available_on", "val", "accn", "filed")
    return C.published_pick(c, ["entity", "period_end"], allow_late=True).drop("available_on")


@query("c5_derived_cells", "SELECT entity, period_end, indicator, method, value, accn, tag FROM f_cells", ["f_cells"])
def c5(spark, sf):
    return cells(spark, sf).select("entity", "period_end", "indicator", "method", "value", _first("facts", "accn").alias("accn"), _first("facts", "tag").alias("tag"))


@query("c6_rebuilt_rows", "SELECT entity, period_end, max(CASE WHEN indicator = 'revenue' THEN value * 25000 END) AS revenue, max(CASE WHEN indicator = 'total_assets' THEN value * 25000 END) AS total_assets, "
       "max(CASE WHEN indicator = 'operating_cash_flow' THEN value * 25000 END) AS operating_cash_flow, count(*) AS n_sources FROM f_cells GROUP BY 1, 2", ["f_cells"])
def c6(spark, sf):
    return C.rebuild_rows(cells(spark, sf)).select("entity", "period_end", "revenue", "total_assets", "operating_cash_flow", F.size("sources").alias("n_sources"))


@query("c7_provenance_facts", "SELECT entity, period_end, indicator, CAST(0 AS BIGINT) AS fact_pos, accn, tag FROM f_cells WHERE method <> 'absent'", ["f_cells"])
def c7(spark, sf):
    c = cells(spark, sf)
    out = C.public_facts(c, F.col("entity")).where("fact_pos = 0")
    return out.select("entity", F.col("end_d").alias("period_end"), "indicator", "fact_pos", "accn", "tag")


@query("c8_filing_url", "SELECT DISTINCT accn, concat('https://www.sec.gov/Archives/edgar/data/', entity, '/', replace(accn, '-', ''), '/', accn, '-index.html') AS url FROM f_facts", ["f_facts"])
def c8(spark, sf):
    return facts(spark, sf).select("accn", filing_url(F.col("entity"), F.col("accn")).alias("url")).distinct()


def facts_with_years(spark, sf):
    """Facts plus annual net income; even entities lack a separate fourth-quarter revenue."""
    f = facts(spark, sf).where(~((F.col("entity") % 2 == 0) & (F.col("fp") == "Q4") & F.col("start_d").isNotNull()))
    p = panel(spark, sf).where("fiscal_quarter = 4")
    annual = p.select("entity", F.lit("NetIncomeLoss").alias("tag"), F.make_date("fiscal_year", F.lit(1), F.lit(1)).alias("start_d"), F.col("period_end").alias("end_d"),
                      F.coalesce("net_income", F.lit(0)).alias("val"), F.col("fiscal_year").alias("fy"), F.lit("FY").alias("fp"), F.col("available_on").alias("filed"),
                      F.concat_ws("-", "entity", "fiscal_year", F.lit("y")).alias("accn"), F.lit("USD").alias("unit"))
    return f.unionByName(annual)


SQL["f_facts_y"] = (["f_facts"], """SELECT * FROM f_facts WHERE NOT (entity % 2 = 0 AND fp = 'Q4' AND start_d IS NOT NULL)
  UNION ALL SELECT entity, 'NetIncomeLoss', make_date(fiscal_year, 1, 1), period_end, coalesce(net_income, 0), fiscal_year, 'FY', available_on, concat(entity, '-', fiscal_year, '-y'), 'USD' FROM f_panel WHERE fiscal_quarter = 4""")
SQL["f_found"] = (["f_facts_y"], """SELECT entity, fy, q, start_d, end_d, filed FROM (SELECT *, CAST(substr(fp, 2, 1) AS BIGINT) AS q, row_number() OVER (PARTITION BY entity, fy, fp ORDER BY filed,
  list_position(['NetIncomeLoss','OperatingIncomeLoss','RevenueFromContractWithCustomerExcludingAssessedTax','SalesRevenueNet','NetCashProvidedByUsedInOperatingActivities'], tag), end_d, accn) AS k
  FROM f_facts_y f WHERE unit = 'USD' AND start_d IS NOT NULL AND fp IN ('Q1','Q2','Q3','Q4') AND end_d - start_d BETWEEN 80 AND 100
  AND tag IN ('NetIncomeLoss','OperatingIncomeLoss','RevenueFromContractWithCustomerExcludingAssessedTax','SalesRevenueNet','NetCashProvidedByUsedInOperatingActivities')
  AND EXISTS (SELECT 1 FROM f_facts_y b WHERE b.entity = f.entity AND b.end_d = f.end_d AND b.start_d IS NULL AND b.tag IN ('Assets','AssetsCurrent') AND b.unit = 'USD')) WHERE k = 1""")


@query("c9_discover_periods", """SELECT entity, CAST(fy AS BIGINT) AS fiscal_year, q AS fiscal_quarter, start_d AS period_start, end_d AS period_end, filed AS available_on, CAST(0 AS BIGINT) AS from_year FROM f_found
  UNION ALL SELECT y.entity, CAST(y.fy AS BIGINT), 4, coalesce(t.end_d, y.start_d), y.end_d, y.filed, 1 FROM (SELECT * FROM f_facts_y WHERE tag = 'NetIncomeLoss' AND fp = 'FY' AND unit = 'USD' AND end_d - start_d BETWEEN 330 AND 399) y
  LEFT JOIN f_found t ON t.entity = y.entity AND t.fy = y.fy AND t.q = 3 WHERE NOT EXISTS (SELECT 1 FROM f_found d WHERE d.entity = y.entity AND d.fy = y.fy AND d.q = 4)""", ["f_found"])
def c9(spark, sf):
    return C.discover_periods(facts_with_years(spark, sf))


@query("c10_method_value", "SELECT entity, period_end, indicator, value * 25000 AS v FROM f_cells WHERE method <> 'absent'", ["f_cells"])
def c10(spark, sf):
    c = cells(spark, sf).where("method <> 'absent'")
    return c.select("entity", "period_end", "indicator", C.derived_value(F.col("facts"), 25000, F.col("method")).alias("v"))


def shipped(spark, sf):
    """The panel in converted units, one cell in some rows altered, six indicators never shipped."""
    drop = {"inventory", "receivables", "retained_earnings", "liabilities", "net_income", "short_term_investments"}
    cols = []
    for i in INDICATORS:
        c = F.col(i) * 25000
        if i in drop:
            c = F.lit(None).cast("bigint")
        if i == "revenue":
            c = F.when(F.col("entity") % 13 == 0, c + 1).otherwise(c)
        cols.append(c.alias(i))
    return panel(spark, sf).select("entity", "fiscal_year", "fiscal_quarter", *cols)


_SHIP = {i: ("NULL" if i in {"inventory", "receivables", "retained_earnings", "liabilities", "net_income", "short_term_investments"}
             else f"CASE WHEN entity % 13 = 0 THEN {i} * 25000 + 1 ELSE {i} * 25000 END" if i == "revenue" else f"{i} * 25000") for i in INDICATORS}
SQL["f_cmp"] = (["f_cells", "f_panel"], "SELECT c.*, s.shipped, CAST(c.value * 25000 IS NOT DISTINCT FROM s.shipped AS INT) AS same, CAST(c.value IS NULL AND s.shipped IS NULL AS INT) AS absent_both FROM f_cells c JOIN ("
                + " UNION ALL ".join(f"SELECT entity, period_end, '{i}' AS indicator, CAST({e} AS BIGINT) AS shipped FROM f_panel" for i, e in _SHIP.items())
                + ") s ON c.entity = s.entity AND c.period_end = s.period_end AND c.indicator = s.indicator")


@query("c11_verify_rebuild", """SELECT CASE WHEN grouping(method) = 0 THEN 'by_method' WHEN grouping(indicator) = 0 THEN 'by_indicator' WHEN grouping(tag) = 0 THEN 'by_tag' ELSE 'all' END AS axis,
  coalesce(method, indicator, tag, 'None') AS bucket, count(*) AS n, CAST(sum(same) AS BIGINT) AS n_match, CAST(sum(absent_both) AS BIGINT) AS n_absent_both FROM f_cmp GROUP BY GROUPING SETS ((method), (indicator), (tag), ())""", ["f_cmp"])
def c11(spark, sf):
    return C.match_summary(C.compare_cells(cells(spark, sf), shipped(spark, sf)))


@query("c11_mismatch_examples", "SELECT entity, CAST(fiscal_year AS BIGINT) AS fiscal_year, CAST(fiscal_quarter AS BIGINT) AS fiscal_quarter, indicator, method FROM f_cmp WHERE same = 0 ORDER BY entity, fiscal_year, fiscal_quarter, indicator LIMIT 25", ["f_cmp"])
def c11b(spark, sf):
    return C.mismatch_examples(C.compare_cells(cells(spark, sf), shipped(spark, sf))).select(*C.CELL, "indicator", "method")


@query("c12_legacy_table_match", """SELECT indicator, count(*) AS n, CAST(sum(CAST(a IS NOT DISTINCT FROM b AS INT)) AS BIGINT) AS n_equal FROM (
  SELECT 'revenue' AS indicator, revenue AS a, CASE WHEN entity % 5 = 0 THEN revenue + 1 ELSE revenue END AS b FROM f_panel WHERE fiscal_year >= 1994
  UNION ALL SELECT 'net_income', net_income, CASE WHEN entity % 5 = 0 THEN NULL ELSE net_income END FROM f_panel WHERE fiscal_year >= 1994) GROUP BY indicator""", ["f_panel"])
def c12(spark, sf):
    p = panel(spark, sf)
    old = p.where("fiscal_year >= 1994").withColumn("revenue", F.when(F.col("entity") % 5 == 0, F.col("revenue") + 1).otherwise(F.col("revenue"))).withColumn(
        "net_income", F.when(F.col("entity") % 5 != 0, F.col("net_income")))
    return C.compare_tables(p, old, ["revenue", "net_income"])


CANDIDATES = {"Assets": "instant", "SalesRevenueNet": "duration", "RevenueFromContractWithCustomerExcludingAssessedTax": "duration",
              "NetCashProvidedByUsedInOperatingActivities": "duration", "Liabilities": "instant"}


@query("c13_tag_coverage", "SELECT tag, kind, round(min(cov), 6) AS min_cov, round(avg(cov), 6) AS mean_cov, round(min(ex), 6) AS min_exact, CAST(sum(CAST(cov = 0 AS INT)) AS BIGINT) AS n_missing FROM ("
       "SELECT tag, kind, entity, 1e2 * count(h) / count(*) AS cov, 1e2 * count(x) / count(*) AS ex FROM (SELECT p.entity, p.period_end, t.tag, t.kind, "
       "(SELECT max(1) FROM f_facts f WHERE f.entity = p.entity AND f.tag = t.tag AND f.end_d = p.period_end) AS h, "
       "(SELECT max(1) FROM f_facts f WHERE f.entity = p.entity AND f.tag = t.tag AND f.end_d = p.period_end AND f.start_d IS NOT DISTINCT FROM CASE WHEN t.kind = 'duration' THEN p.period_start END) AS x "
       "FROM f_panel p, (VALUES " + ", ".join(f"('{t}', '{k}')" for t, k in CANDIDATES.items()) + ") AS t(tag, kind)) GROUP BY 1, 2, 3) GROUP BY 1, 2", ["f_facts", "f_panel"])
def c13(spark, sf):
    return C.tag_coverage_summary(C.tag_coverage(facts(spark, sf), panel(spark, sf), CANDIDATES))


@query("c14_coverage_matrix", "SELECT entity, " + ", ".join(f"round(1e2 * count({i}) / count(*), 6) AS {i}" for i in INDICATORS) + " FROM f_panel GROUP BY entity", ["f_panel"])
def c14(spark, sf):
    return C.coverage_matrix(panel(spark, sf))


@query("c15_coverage_summary", " UNION ALL ".join(f"SELECT '{i}' AS indicator, round(min(v), 6) AS min_pct, round(avg(v), 6) AS mean_pct FROM (SELECT entity, 1e2 * count({i}) / count(*) AS v FROM f_panel GROUP BY entity)" for i in INDICATORS), ["f_panel"])
def c15(spark, sf):
    return C.coverage_summary(C.coverage_matrix(panel(spark, sf)))


@query("c16_scaled_values", " UNION ALL ".join(f"SELECT entity, period_end, '{i}' AS indicator, round({i} / 1e6, 6) AS value FROM f_panel" for i in INDICATORS), ["f_panel"])
def c16(spark, sf):
    return C.scaled_values(panel(spark, sf), 1e6)


SQL["f_ev"] = (["f_events"], """SELECT event_id, entity, filing_date, unnest(CASE items WHEN '1.03, 9.01' THEN ['bankruptcy'] WHEN '2.06,4.02' THEN ['distress_item_2.06', 'distress_item_4.02']
  WHEN '4.01' THEN ['distress_item_4.01'] ELSE [] END) AS kind FROM f_events""")


@query("c17_filing_events", "SELECT event_id, entity, filing_date, kind FROM f_ev", ["f_ev"])
def c17(spark, sf):
    return C.filing_events(filings(spark, sf)).drop("item_list")


@query("c18_event_summary", """SELECT c_custkey AS entity, count(kind) AS n_events, CAST(coalesce(sum(CAST(kind = 'bankruptcy' AS INT)), 0) AS BIGINT) AS n_bankruptcy, min(filing_date) AS first, max(filing_date) AS last,
  CAST(coalesce(sum(CAST(kind = 'bankruptcy' AS INT)), 0) > 0 AS BIGINT) AS has_bankruptcy FROM customer LEFT JOIN f_ev ON c_custkey = entity GROUP BY 1""", ["f_ev"])
def c18(spark, sf):
    ents = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"))
    return C.event_summary(C.filing_events(filings(spark, sf)), ents)


@query("f1_point_in_time_filter", "SELECT tag, count(*) AS n FROM f_facts f JOIN f_panel p ON f.entity = p.entity AND f.end_d = p.period_end WHERE f.filed <= p.available_on GROUP BY tag", ["f_facts", "f_panel"])
def f1(spark, sf):
    f, p = facts(spark, sf), panel(spark, sf)
    j = f.join(p.select(F.col("entity").alias("e"), "period_end", "available_on"), (F.col("entity") == F.col("e")) & (F.col("end_d") == F.col("period_end")))
    return j.where(F.col("filed") <= F.col("available_on")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("f2_usd_filter", "SELECT unit, tag, count(*) AS n FROM f_facts WHERE unit = 'USD' AND val IS NOT NULL GROUP BY 1, 2", ["f_facts"])
def f2(spark, sf):
    return C.usd_facts(facts(spark, sf)).groupBy("unit", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("f3_period_length_filter", "SELECT tag, fp, count(*) AS n FROM f_facts WHERE end_d - start_d BETWEEN 80 AND 100 OR end_d - start_d BETWEEN 330 AND 399 GROUP BY 1, 2", ["f_facts"])
def f3(spark, sf):
    d = F.datediff("end_d", "start_d")
    return facts(spark, sf).where(d.between(80, 100) | d.between(330, 399)).groupBy("tag", "fp").agg(F.count(F.lit(1)).alias("n"))


def _recorded(spark, sf):
    """Recorded provenance with three kinds of damage: altered fact, altered value, unknown method."""
    c = cells(spark, sf).withColumn("value", (F.col("value") * 25000).cast("bigint"))
    e = F.col("entity")
    bad_fact = F.transform("facts", lambda f: f.withField("val", f["val"] + 1))
    return (
        c.withColumn("facts", F.when((e % 11 == 0) & (F.col("indicator") == "total_assets"), bad_fact).otherwise(F.col("facts")))
        .withColumn("value", F.when((e % 9 == 0) & (F.col("indicator") == "revenue"), F.col("value") + 7).otherwise(F.col("value")))
        .withColumn("value", F.when((e % 8 == 0) & (F.col("indicator") == "inventory"), F.lit(5).cast("bigint")).otherwise(F.col("value")))
        .withColumn("method", F.when((e % 6 == 0) & (F.col("method") == "reported_quarter"), "guess").otherwise(F.col("method")))
    )


@query("g1_facts_missing", "SELECT entity, period_end, indicator FROM f_cells WHERE entity % 11 = 0 AND indicator = 'total_assets' AND method <> 'absent'", ["f_cells"])
def g1(spark, sf):
    r = _recorded(spark, sf)
    used = r.select("entity", "period_end", "indicator", F.explode("facts").alias("f")).select("entity", "period_end", "indicator", "f.*")
    return C.facts_missing(used, facts(spark, sf)).select("entity", "period_end", "indicator")


@query("g2_cell_verification", """SELECT entity, count(*) AS n_cells, CAST(sum(CAST(method = 'absent' AS INT)) AS BIGINT) AS n_absent_cells, CAST(sum(CAST(method <> 'absent' AS INT)) AS BIGINT) AS n_facts_checked,
  CAST(sum(CAST(entity % 11 = 0 AND indicator = 'total_assets' AND method <> 'absent' AS INT)) AS BIGINT) AS n_facts_missing,
  CAST(sum(CAST((entity % 11 = 0 AND indicator = 'total_assets' AND method <> 'absent') OR (entity % 9 = 0 AND indicator = 'revenue' AND method <> 'absent' AND NOT (entity % 6 = 0 AND method = 'reported_quarter')) AS INT)) AS BIGINT) AS n_value_mismatch,
  CAST(sum(CAST(entity % 8 = 0 AND indicator = 'inventory' AS INT)) AS BIGINT) AS n_absent_but_filled, CAST(sum(CAST(entity % 6 = 0 AND method = 'reported_quarter' AS INT)) AS BIGINT) AS n_unsupported_method FROM f_cells GROUP BY entity""", ["f_cells"])
def g2(spark, sf):
    return C.verify_cells(_recorded(spark, sf), facts(spark, sf))


@query("g3_ytd_difference", "SELECT entity, period_end, value, operating_cash_flow AS expected FROM f_cells JOIN f_panel USING (entity, period_end) WHERE indicator = 'operating_cash_flow' AND method = 'current_ytd_minus_previous_ytd'", ["f_cells", "f_panel"])
def g3(spark, sf):
    c = cells(spark, sf).where("indicator = 'operating_cash_flow' and method = 'current_ytd_minus_previous_ytd'").select("entity", "period_end", "value")
    return c.join(panel(spark, sf).select("entity", "period_end", F.col("operating_cash_flow").alias("expected")), ["entity", "period_end"])
