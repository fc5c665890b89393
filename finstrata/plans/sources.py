"""Queries A* and B*: readers and writers (file round trips are covered by the tests)."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..constants import INDICATORS
from ..functions.ordered import running_totals
from ..operators import features as X
from ..operators import facts as C
from ..operators import samples as S
from ..sources import documents as D
from ..sources import writers as Wr
from .features import samples2
from .registry import query
from .views import facts, panel, scores, table


def fact_documents(spark, sf):
    """Nested JSON documents, one per entity and fiscal year."""
    f = facts(spark, sf)
    entry = F.struct(
        F.col("start_d").cast("string").alias("start"), F.col("end_d").cast("string").alias("end"), "val", "accn", "fy", "fp",
        F.lit("10-Q").alias("form"), F.col("filed").cast("string").alias("filed"), F.lit(None).cast("string").alias("frame"))
    units = f.groupBy("entity", "fy", "tag", "unit").agg(F.collect_list(entry).alias("entries"))
    tags = units.groupBy("entity", "fy", "tag").agg(F.struct(
        F.map_from_entries(F.collect_list(F.struct("unit", "entries"))).alias("units")).alias("body"))
    docs = tags.groupBy("entity", "fy").agg(F.map_from_entries(F.collect_list(F.struct("tag", "body"))).alias("tags"))
    return docs.select("entity", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), F.col("tags")).alias("facts"))).alias("doc"))


_CAST = "CAST(fy AS BIGINT) AS fy"


@query("a1_read_split", "SELECT sample_id, split, CAST(is_distressed AS BIGINT) AS is_distressed FROM f_split WHERE split = 'validation'", ["f_split"])
def a1(spark, sf):
    return samples2(spark, sf).where("split = 'validation'").select("sample_id", "split", "is_distressed")


@query("a4_documents_in_corpus_order", """SELECT s_suppkey AS entity, corpus_pos, CAST(coalesce(n, 0) AS BIGINT) AS n FROM supplier
  LEFT JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS corpus_pos FROM supplier WHERE s_suppkey % 2 = 0) c USING (s_suppkey)
  LEFT JOIN (SELECT entity AS s_suppkey, count(*) AS n FROM f_panel GROUP BY 1) p USING (s_suppkey) WHERE n > 0""", ["f_panel"])
def a4(spark, sf):
    listed = table(spark, sf, "supplier").where("s_suppkey % 2 = 0")
    by_bal = running_totals(listed.groupBy("s_acctbal").agg(F.count(F.lit(1)).alias("k")), "s_acctbal", ["k"])
    within = F.row_number().over(W.partitionBy("s_acctbal").orderBy("s_suppkey"))
    corpus = listed.withColumn("r", within).join(by_bal, "s_acctbal").select(
        F.col("s_suppkey").alias("entity"), (F.col("k_cum") - F.col("k") + F.col("r")).alias("corpus_pos"))
    docs = panel(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return D.order_by_corpus(docs, corpus)


@query("a5_panel_rows", "SELECT entity, period_end, revenue, net_income FROM f_panel", ["f_panel"])
def a5(spark, sf):
    rows = panel(spark, sf).select(
        F.col("entity").alias("ticker"), "fiscal_year", "fiscal_quarter", "period_start", "period_end", "available_on",
        *[F.col(i).cast("string").alias(f"{i}_vnd") for i in INDICATORS])
    return D.panel_from_documents(rows).select("entity", "period_end", "revenue", "net_income")


@query("a6_usd_facts", f"SELECT entity, tag, start_d, end_d, val, filed, accn, {_CAST} FROM f_facts WHERE unit = 'USD' AND val IS NOT NULL AND tag = 'RevenueFromContractWithCustomerExcludingAssessedTax'", ["f_facts"])
def a6(spark, sf):
    f = C.usd_facts(D.parse_fact_documents(fact_documents(spark, sf)))
    f = f.where(F.col("tag") == "RevenueFromContractWithCustomerExcludingAssessedTax")
    return f.select("entity", "tag", "start_d", "end_d", "val", "filed", "accn", "fy")


@query("a7_all_facts", f"SELECT entity, tag, unit, start_d, end_d, val, filed, accn, fp, {_CAST} FROM f_facts", ["f_facts"])
def a7(spark, sf):
    return D.parse_fact_documents(fact_documents(spark, sf)).select(
        "entity", "tag", "unit", "start_d", "end_d", "val", "filed", "accn", "fp", "fy")


@query("a8_fact_lookup", """SELECT a.entity, a.tag, a.end_d, a.val, count(*) AS n_records FROM f_facts a JOIN f_facts b ON a.entity = b.entity AND a.tag = b.tag
  AND a.start_d IS NOT DISTINCT FROM b.start_d AND a.end_d = b.end_d AND a.accn = b.accn WHERE a.fp = 'Q2' GROUP BY 1, 2, 3, 4""", ["f_facts"])
def a8(spark, sf):
    f = facts(spark, sf)
    want = f.where("fp = 'Q2'").select(F.col("entity").alias("e"), F.col("tag").alias("t"), F.col("start_d").alias("s"),
                                       F.col("end_d").alias("d"), F.col("accn").alias("a"), F.col("val").alias("v"))
    hit = want.join(f, (F.col("e") == F.col("entity")) & (F.col("t") == F.col("tag")) & F.col("s").eqNullSafe(F.col("start_d"))
                    & (F.col("d") == F.col("end_d")) & (F.col("a") == F.col("accn")))
    return hit.groupBy(F.col("e").alias("entity"), F.col("t").alias("tag"), F.col("d").alias("end_d"), F.col("v").alias("val")).agg(
        F.count(F.lit(1)).alias("n_records"))


@query("a9_period_index", """SELECT tag, count(DISTINCT (entity, end_d)) AS n_ends, count(DISTINCT (entity, coalesce(start_d, DATE '1900-01-01'), end_d)) AS n_exact FROM f_facts GROUP BY tag""", ["f_facts"])
def a9(spark, sf):
    f = facts(spark, sf).select("tag", "entity", F.coalesce("start_d", F.lit("1900-01-01").cast("date")).alias("s"), "end_d").distinct()
    exact = f.groupBy("tag").agg(F.count(F.lit(1)).alias("n_exact"))
    ends = f.select("tag", "entity", "end_d").distinct().groupBy("tag").agg(F.count(F.lit(1)).alias("n_ends"))
    return ends.join(exact, "tag")


@query("a10_snapshot_or_empty", "SELECT s_suppkey AS entity, count(f.entity) AS n_facts FROM supplier LEFT JOIN (SELECT * FROM f_facts WHERE entity % 4 <> 0) f ON s_suppkey = f.entity GROUP BY 1", ["f_facts"])
def a10(spark, sf):
    have = facts(spark, sf).where("entity % 4 <> 0").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity")).join(have, "entity", "left").select(
        "entity", F.coalesce("n", F.lit(0)).alias("n_facts"))


def registry_texts(spark, sf):
    body = F.struct(F.col("s_suppkey").alias("cik"), F.col("s_name").alias("entity_name"), F.lit("u").alias("url"),
                    F.sha2("s_name", 256).alias("sha256"), F.lit("2024-01-01").alias("downloaded_at"))
    return table(spark, sf, "supplier").select(F.to_json(F.create_map(F.col("s_name"), body)).alias("doc"))


@query("a11_download_registry", "SELECT s_name AS ticker, s_suppkey AS cik, s_name AS entity_name, sha256(s_name) AS sha256 FROM supplier")
def a11(spark, sf):
    return D.parse_registry(registry_texts(spark, sf)).select("ticker", "cik", "entity_name", "sha256")


@query("a12_zip_filings", """SELECT user_id AS entity, '8-K' AS form, CAST(ts AS DATE) AS filing_date, concat('a-', event_id) AS accession, event_type AS items FROM events""")
def a12(spark, sf):
    e = table(spark, sf, "events")
    pages = e.groupBy(F.col("user_id").alias("entity"), F.floor(F.col("event_id") / 100).alias("page")).agg(
        F.collect_list(F.struct(F.lit("8-K").alias("form"), F.col("ts").cast("date").cast("string").alias("filingDate"),
                                F.concat(F.lit("a-"), F.col("event_id").cast("string")).alias("accessionNumber"), F.col("event_type").alias("items"))).alias("r"))
    arrays = pages.select("entity", "page", *[F.col("r")[k].alias(k) for k in ("form", "filingDate", "accessionNumber", "items")])
    return D.all_filings(arrays.where("page % 2 = 0"), arrays.where("page % 2 = 1"))


@query("a13_entities_from_files", "SELECT DISTINCT CAST(entity AS VARCHAR) AS entity FROM f_panel", ["f_panel"])
def a13(spark, sf):
    return D.entities_from_files(panel(spark, sf).select(F.concat(F.col("entity").cast("string"), F.lit("-16-indicators.json")).alias("file_name")))


@query("a14_labelled_csv", "SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels")
def a14(spark, sf):
    lines = table(spark, sf, "labels").select(F.to_csv(F.struct("doc_id", "quality", "toxic")).alias("line"))
    return D.check_labelled(D.labelled_from_csv_lines(lines, "doc_id long, quality int, toxic int"), "toxic")


@query("a15_sample_csv", "SELECT entity, CAST(fiscal_year AS BIGINT) AS fiscal_year, period_end, revenue AS revenue_vnd, total_assets AS total_assets_vnd FROM f_panel", ["f_panel"])
def a15(spark, sf):
    cols = ["fiscal_year", "fiscal_quarter", "period_start", "period_end", "available_on"] + INDICATORS[:10]
    lines = panel(spark, sf).select("entity", F.to_csv(F.struct(*cols)).alias("line"))
    parsed = lines.select("entity", F.from_csv("line", D.SAMPLE_CSV.simpleString()[7:-1].replace(":", " ")).alias("r"))
    return parsed.select("entity", "r.fiscal_year", "r.period_end", "r.revenue_vnd", "r.total_assets_vnd")


@query("a16_find_sample", """SELECT sample_id, split FROM f_split WHERE sample_id = '3-1996Q2' UNION ALL SELECT sample_id, split FROM (SELECT *, CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 WHEN 'train' THEN 2 ELSE 3 END AS k
  FROM f_split WHERE entity = 5 AND sample_id LIKE '%Q4' ORDER BY k, sample_id LIMIT 1)""", ["f_split"])
def a16(spark, sf):
    s = samples2(spark, sf)
    return S.find_sample(s, wanted="3-1996q2").unionByName(S.find_sample(s, entity="5", quarter="q4")).select("sample_id", "split")


@query("a17_sample_index", "SELECT sample_id, entity, split FROM f_split", ["f_split"])
def a17(spark, sf):
    s = samples2(spark, sf)
    out = None
    for name in ("train", "validation", "test", "purged"):
        part = s.where(F.col("split") == name)
        out = part if out is None else out.unionByName(part)
    return out.select("sample_id", "entity", "split")


@query("b2_manifest", """SELECT split, count(*) AS n, CAST(sum(is_distressed) AS BIGINT) AS positives, count(DISTINCT entity) AS entities, min(target_period_start) AS first_start,
  max(target_period_end) AS last_end FROM f_split GROUP BY split""", ["f_split"])
def b2(spark, sf):
    return Wr.build_manifest(samples2(spark, sf))


@query("b3_content_fingerprint", """SELECT split, count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(sha256(concat_ws('|', sample_id, CAST(is_distressed AS VARCHAR), CAST(target_period_end AS VARCHAR))), 1, 10)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM f_split GROUP BY split""", ["f_split"])
def b3(spark, sf):
    return Wr.content_fingerprint(samples2(spark, sf), ["sample_id", "is_distressed", "target_period_end"], ["split"])


@query("b4_ranked_table", "SELECT row_id, round(p_a, 6) AS p, CAST(y AS BIGINT) AS y FROM f_scores ORDER BY p DESC, row_id", ["f_scores"])
def b4(spark, sf):
    return Wr.ranked(scores(spark, sf).select("row_id", F.col("p_a").alias("p"), "y"), "p", "row_id")


EVIDENCE = ["current_ratio_latest", "debt_to_assets_latest", "net_margin_latest", "ocf_to_sales_latest",
            "revenue_yoy_growth", "negative_ni_streak", "revenue_drawdown_window"]


@query("b5_error_cases", "SELECT s.sample_id, CAST(s.is_distressed AS BIGINT) AS y, CAST(p >= 5e-1 AS BIGINT) AS predicted, " + ", ".join(f"round(f.{e}, 6) AS {e}" for e in EVIDENCE)
       + " FROM (SELECT *, least(1e0, n_history / 1e1) AS p FROM f_samples) s JOIN f_feat f USING (entity, period_end) WHERE CAST(p >= 5e-1 AS INT) <> is_distressed", ["f_samples", "f_feat"])
def b5(spark, sf):
    s = samples2(spark, sf)
    scored = s.select("sample_id", F.col("is_distressed").alias("y"), F.least(F.lit(1.0), F.col("n_history") / 10.0).alias("p"))
    feats = X.feature_table(panel(spark, sf)).join(s.select("entity", "period_end", "sample_id"), ["entity", "period_end"])
    return Wr.error_cases(scored, feats, EVIDENCE).drop("p")


@query("b6_trial_ledger", """SELECT n_nationkey AS trial, concat('{"depth":', n_nationkey % 5, ',"rate":', (n_nationkey % 4) / 4e0, '}') AS params FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation)""")
def b6(spark, sf):
    n = table(spark, sf, "nation")
    t = n.select(F.col("n_nationkey").alias("trial"), (F.col("n_nationkey") % 5).alias("depth"), ((F.col("n_nationkey") % 4) / 4.0).alias("rate"))
    return Wr.ledger_rows(t, ["depth", "rate"])


@query("b7_entity_documents", """SELECT entity, CAST(16 AS BIGINT) AS indicator_count, CAST(25000 AS BIGINT) AS vnd_per_usd, count(*) AS n_rows,
  string_agg(concat(period_end, ':', coalesce(CAST(net_income AS VARCHAR), '-')), ',' ORDER BY period_end) AS series FROM f_panel GROUP BY entity""", ["f_panel"])
def b7(spark, sf):
    d = Wr.entity_documents(panel(spark, sf), 25000)
    text = F.transform("rows", lambda r: F.concat(r["period_end"].cast("string"), F.lit(":"), F.coalesce(r["net_income_vnd"], F.lit("-"))))
    return d.select("entity", "indicator_count", "vnd_per_usd", F.size("rows").alias("n_rows"), F.array_join(text, ",").alias("series"))


@query("b8_result_rows", "SELECT grp % 5 AS fold, round(avg(p_a), 6) AS p_a_mean, round(stddev_pop(p_a), 6) AS p_a_std, round(avg(p_b), 6) AS p_b_mean, round(stddev_pop(p_b), 6) AS p_b_std FROM f_scores GROUP BY 1", ["f_scores"])
def b8(spark, sf):
    return Wr.result_rows(scores(spark, sf).withColumn("fold", F.col("grp") % 5), ["fold"], ["p_a", "p_b"])


@query("b1_split_rows_clustered", "SELECT split, count(*) AS n, count(DISTINCT entity) AS entities FROM f_split GROUP BY split", ["f_split"])
def b1(spark, sf):
    """The rows as they are written, one folder per split (the write itself is covered by the tests)."""
    return samples2(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"))


@query("a3_manifest_fields", "SELECT split, count(*) AS n, CAST(sum(is_distressed) AS BIGINT) AS positives FROM f_split GROUP BY split", ["f_split"])
def a3(spark, sf):
    """The manifest written as JSON text and read back with its declared fields."""
    text = Wr.manifest_json(Wr.build_manifest(samples2(spark, sf)))
    return text.select("split", F.from_json("body", "n long, positives long").alias("m")).select("split", "m.n", "m.positives")
