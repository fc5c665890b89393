"""Queries P*: reconciliation rules on the panel, its facts, samples, splits and scored tables, with seeded damage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FEATURES
from ..operators import audit as A
from ..operators import features as X
from ..operators import metrics as M
from ..operators import profiles as P
from ..operators import samples as S
from ..sources import documents as D
from ..sources import writers as Wr
from . import profiles  # noqa: F401  (names views that the SQL here reads)
from .etl import cells, facts
from .features import WE, samples2
from .registry import query
from .sources import registry_texts
from .views import SQL, panel, table


def _rule(group, rule, n, bad, example, src):
    return f"SELECT '{group}' AS grp, '{rule}' AS rule, CAST(count({n}) AS BIGINT) AS n, CAST(coalesce(sum(CASE WHEN NOT ({bad}) THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_bad, min(CASE WHEN NOT ({bad}) THEN {example} END) AS example FROM {src}"


def rules_sql(group, rules, example, src):
    return " UNION ALL ".join(_rule(group, r, c, c, example, src) for r, c in rules.items())


KEY = "concat(entity, '-', fiscal_year, 'Q', fiscal_quarter)"


def damaged_panel(spark, sf):
    """Every 37th quarter row is too long, every 41st published early; one quarter in nine is missing."""
    p = panel(spark, sf)
    k = F.col("entity") * 28 + F.col("fiscal_year") * 4 + F.col("fiscal_quarter")
    p = p.where(k % 9 != 0)
    return p.withColumn("period_start", F.when(k % 37 == 0, F.date_sub("period_start", 40)).otherwise(F.col("period_start"))).withColumn(
        "available_on", F.when(k % 41 == 0, F.date_sub("period_end", 3)).otherwise(F.col("available_on")))


_K = "(entity * 28 + fiscal_year * 4 + fiscal_quarter)"
SQL["f_dmg"] = (["f_panel"], f"""SELECT *, lag(fiscal_year) OVER {WE} AS py, lag(fiscal_quarter) OVER {WE} AS pq, lag(period_end) OVER {WE} AS pe FROM (SELECT * REPLACE (CASE WHEN {_K} % 37 = 0 THEN CAST(period_start - INTERVAL 40 DAY AS DATE) ELSE period_start END AS period_start,
  CASE WHEN {_K} % 41 = 0 THEN CAST(period_end - INTERVAL 3 DAY AS DATE) ELSE available_on END AS available_on) FROM f_panel WHERE {_K} % 9 <> 0)""")
_QR = {
    "quarter_length": "period_end - period_start BETWEEN 70 AND 105", "published_after_end": "available_on >= period_end", "quarter_number": "fiscal_quarter BETWEEN 1 AND 4",
    "period_end_grows": "CASE WHEN pq IS NOT NULL THEN period_end > pe END",
    "quarter_follows": "CASE WHEN pq IS NOT NULL THEN fiscal_year = CASE WHEN pq = 4 THEN py + 1 ELSE py END AND fiscal_quarter = CASE WHEN pq = 4 THEN 1 ELSE pq + 1 END END",
}


@query("p4_quarter_rules", rules_sql("quarters", _QR, KEY, "f_dmg"), ["f_dmg"])
def p4(spark, sf):
    return A.quarter_rules(damaged_panel(spark, sf))


def documents(spark, sf):
    e = F.col("entity")
    return Wr.entity_documents(panel(spark, sf), 25000).withColumn("currency", F.when(e % 4 == 0, "USD").otherwise(F.col("currency"))).withColumn(
        "vnd_per_usd", F.when(e % 5 == 0, 24000).otherwise(F.col("vnd_per_usd")))


@query("p7_document_rules", rules_sql("documents", {"document_currency": "entity % 4 <> 0", "document_rate": "entity % 5 <> 0", "document_indicator_count": "entity = entity"}, "CAST(entity AS VARCHAR)", "(SELECT DISTINCT entity FROM f_panel)"), ["f_panel"])
def p7(spark, sf):
    return A.document_rules(documents(spark, sf), 25000)


@query("p1_rule_runner", f"SELECT grp, count(*) AS n_rules, CAST(sum(n) AS BIGINT) AS n_checks, CAST(sum(n_bad) AS BIGINT) AS n_issues FROM ({rules_sql('quarters', _QR, KEY, 'f_dmg')} UNION ALL {rules_sql('documents', {'document_currency': 'entity % 4 <> 0', 'document_rate': 'entity % 5 <> 0', 'document_indicator_count': 'entity = entity'}, 'CAST(entity AS VARCHAR)', '(SELECT DISTINCT entity FROM f_panel)')}) GROUP BY grp", ["f_dmg"])
def p1(spark, sf):
    return A.check_summary(A.collect_checks([A.quarter_rules(damaged_panel(spark, sf)), A.document_rules(documents(spark, sf), 25000)]))


def snapshot_files(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey % 13 <> 0")
    k = F.col("s_suppkey")
    return s.select(F.col("s_name").alias("ticker"), F.when(k % 5 == 0, F.sha2(F.concat("s_name", F.lit("x")), 256)).otherwise(F.sha2("s_name", 256)).alias("sha256"),
                    k.alias("cik"), F.when(k % 7 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("entity_name"))


SQL["f_snap"] = ([], "SELECT *, s_suppkey % 13 <> 0 AS present FROM supplier")
_REG = {
    "registered": "present", "file_present": "present", "sha256": "CASE WHEN present THEN s_suppkey % 5 <> 0 END", "cik": "CASE WHEN present THEN true END",
    "entity_name": "CASE WHEN present THEN s_suppkey % 7 <> 0 OR upper(s_name) = s_name END",
}
_REG["registered"] = "s_suppkey = s_suppkey"


@query("p2_snapshot_registry", rules_sql("snapshots", _REG, "s_name", "f_snap"), ["f_snap"])
def p2(spark, sf):
    return A.registry_rules(snapshot_files(spark, sf), D.parse_registry(registry_texts(spark, sf)))


@query("p3_content_hashes", "SELECT s_name AS ticker, sha256(s_name) AS want, CASE WHEN s_suppkey % 5 = 0 THEN sha256(concat(s_name, 'x')) ELSE sha256(s_name) END AS have FROM supplier WHERE s_suppkey % 13 <> 0 AND s_suppkey % 5 = 0")
def p3(spark, sf):
    reg = D.parse_registry(registry_texts(spark, sf)).select("ticker", F.col("sha256").alias("want"))
    return reg.join(snapshot_files(spark, sf).select("ticker", F.col("sha256").alias("have")), "ticker").where("want <> have")


def stored_cells(spark, sf):
    """Derived cells in converted units with damage: one value, one method, one fact period."""
    c = cells(spark, sf).withColumn("value", (F.col("value") * 25000).cast("bigint"))
    e, i = F.col("entity"), F.col("indicator")
    shifted = F.transform("facts", lambda f: f.withField("end_d", F.date_add(f["end_d"], 1)))
    return (
        c.withColumn("facts", F.when((e % 11 == 0) & (i == "total_assets"), shifted).otherwise(F.col("facts")))
        .withColumn("value", F.when((e % 9 == 0) & (i == "revenue"), F.col("value") + 7).otherwise(F.col("value")))
        .withColumn("method", F.when((e % 6 == 0) & (F.col("method") == "reported_quarter"), "guess").otherwise(F.col("method")))
    )


SQL["f_stored"] = (["f_cells"], """SELECT entity, fiscal_year, fiscal_quarter, indicator, entity % 11 = 0 AND indicator = 'total_assets' AND method <> 'absent' AS shifted, entity % 9 = 0 AND indicator = 'revenue' AND method <> 'absent' AS off,
  CASE WHEN entity % 6 = 0 AND method = 'reported_quarter' THEN 'guess' ELSE method END AS method FROM f_cells""")
_Y, _I, _Dn = "method = 'current_ytd_minus_previous_ytd'", "method = 'instant'", "method IN ('reported_quarter', 'reported_first_quarter')"
_FR = {r: f"CASE WHEN {_Y} THEN true END" for r in ("ytd_has_two", "ytd_ends_at_period", "ytd_same_start", "ytd_previous_before")}
_FR |= {"duration_matches_period": f"CASE WHEN {_Dn} THEN true END", "instant_matches_period": f"CASE WHEN {_I} THEN NOT shifted END",
        "single_fact": f"CASE WHEN {_I} OR {_Dn} THEN true END", "value_as_expected": f"CASE WHEN {_I} OR {_Dn} OR {_Y} THEN NOT off END"}


@query("p5_expected_values", rules_sql("facts", _FR, f"concat({KEY}, ':', indicator)", "f_stored"), ["f_stored"])
def p5(spark, sf):
    return A.fact_rules(stored_cells(spark, sf), 25000)


_LIVE = "method NOT IN ('absent', 'guess')"
_PR = {"method_known": "method <> 'guess'", "absent_is_empty": "CASE WHEN method = 'absent' THEN true END", "has_facts": f"CASE WHEN {_LIVE} THEN true END",
       "fact_exists": f"CASE WHEN {_LIVE} THEN NOT shifted END", "fact_value": f"CASE WHEN {_LIVE} AND NOT shifted THEN true END", "available_on_is_latest_filing": f"CASE WHEN {_LIVE} THEN true END"}


@query("p6_cell_provenance", rules_sql("provenance", _PR, f"concat({KEY}, ':', indicator)", "f_stored"), ["f_stored"])
def p6(spark, sf):
    return A.provenance_rules(stored_cells(spark, sf), facts(spark, sf))


def stored_samples(spark, sf):
    """Stored samples with damage: decision dates moved, one label out of range."""
    s = samples2(spark, sf)
    return s.withColumn("as_of", F.when(F.col("n_history") == 9, F.date_sub("as_of", 1)).otherwise(F.col("as_of"))).withColumn(
        "is_distressed", F.when((F.col("n_history") == 3) & (F.col("entity") % 5 == 0), 2).otherwise(F.col("is_distressed")))


_SR = {"id_well_formed": "true", "target_in_panel": "true", "has_history": "true", "history_length": "true", "as_of_matches": "n_history <> 9", "target_period": "true", "label_date": "true",
       "label_binary": "NOT (n_history = 3 AND entity % 5 = 0)", "label_not_before_as_of": "true", "history_published_by_as_of": "n_history <> 9", "history_before_target": "true"}


@query("p8_sample_rules", rules_sql("samples", {k: f"({v})" for k, v in _SR.items()}, "sample_id", "f_split"), ["f_split"])
def p8(spark, sf):
    return A.sample_rules(stored_samples(spark, sf), panel(spark, sf))


def stored_split(spark, sf):
    """Two entities lost, one sample twice, one split moved, one unknown sample."""
    s = samples2(spark, sf).select("sample_id", "entity", "split", "n_history")
    keep = s.where("entity % 8 <> 0").withColumn("split", F.when(F.col("n_history") == 14, "test").otherwise(F.col("split")))
    return keep.unionByName(keep.where("n_history = 2")).unionByName(keep.where("n_history = 5").withColumn("sample_id", F.concat("sample_id", F.lit("z"))))


SQL["f_stsplit"] = (["f_split"], """SELECT sample_id, CASE WHEN n_history = 14 THEN 'test' ELSE split END AS split, n_history FROM f_split WHERE entity % 8 <> 0 UNION ALL SELECT sample_id, split, n_history FROM f_split WHERE entity % 8 <> 0 AND n_history = 2
  UNION ALL SELECT concat(sample_id, 'z'), split, n_history FROM f_split WHERE entity % 8 <> 0 AND n_history = 5""")


@query("p9_split_rules", rules_sql("splits", {"in_one_split": "k = 1"}, "sample_id", "(SELECT sample_id, count(*) AS k FROM f_stsplit GROUP BY 1)") + " UNION ALL " + rules_sql("splits", {
    "every_sample_stored": "CASE WHEN e <> 'none' THEN s <> 'none' END", "no_extra_sample": "CASE WHEN s <> 'none' THEN e <> 'none' END", "split_as_policy": "CASE WHEN e <> 'none' AND s <> 'none' THEN e = s END"},
    "sample_id", "(SELECT sample_id, coalesce(e.split, 'none') AS e, coalesce(s.split, 'none') AS s FROM f_split e FULL JOIN (SELECT DISTINCT sample_id, split FROM f_stsplit) s USING (sample_id))"), ["f_stsplit"])
def p9(spark, sf):
    return A.split_rules(samples2(spark, sf), stored_split(spark, sf))


@query("p10_manifest_rules", """WITH m AS (SELECT split, count(*) AS n FROM f_split GROUP BY 1), y AS (SELECT entity, max(target_fiscal_year) AS ly, count(CASE WHEN split = 'test' THEN 1 END) AS nt, min(CASE WHEN split = 'test' THEN target_fiscal_year END) AS fy FROM f_split GROUP BY 1 HAVING nt > 0) """
       + rules_sql("manifest", {"declared": "true", "still_exists": "true", "n_equal": "split <> 'test'", "positives_equal": "true", "entities_equal": "true", "first_start_equal": "true", "last_end_equal": "true"}, "split", "m").replace("count(true)", "count(*)")
       + " UNION ALL " + rules_sql("manifest", {"test_size": "nt = 8", "test_is_last_two_years": "fy = ly - 1"}, "CAST(entity AS VARCHAR)", "y"), ["f_split"])
def p10(spark, sf):
    s = samples2(spark, sf)
    declared = Wr.build_manifest(s).withColumn("n", F.when(F.col("split") == "test", F.col("n") + 1).otherwise(F.col("n")))
    return A.manifest_rules(s, declared)


@query("p10_fit_windows", """WITH b AS (SELECT max(CASE WHEN split = 'train' THEN as_of END) AS t, max(CASE WHEN split = 'validation' THEN as_of END) AS v, min(CASE WHEN split = 'validation' THEN as_of END) AS va, min(CASE WHEN split = 'test' THEN as_of END) AS ta FROM f_split) """
       + rules_sql("fit_windows", {"validation_fit_window": "t <= DATE '1996-06-01' AND DATE '1996-06-01' <= va", "final_fit_window": "greatest(t, v) <= DATE '1997-03-01' AND DATE '1997-03-01' <= ta"}, "'manifest'", "b"), ["f_split"])
def p10b(spark, sf):
    bounds = P.published_bounds(samples2(spark, sf).withColumn("available_on", F.col("as_of")))
    return A.fit_window_rules(bounds, F.lit("1996-06-01").cast("date"), F.lit("1997-03-01").cast("date"))


@query("p11_corpus_rules", """WITH a AS (SELECT entity, count(*) AS n, min(fiscal_year) AS y0, max(fiscal_year) AS y1 FROM f_panel GROUP BY 1) """ + rules_sql("corpus", {
    "declared": "entity % 10 <> 0", "still_exists": "true", "n_quarters_equal": "CASE WHEN entity % 10 <> 0 THEN entity % 3 <> 0 END", "first_year_equal": "CASE WHEN entity % 10 <> 0 THEN true END", "last_year_equal": "CASE WHEN entity % 10 <> 0 THEN true END"},
    "CAST(entity AS VARCHAR)", "a"), ["f_panel"])
def p11(spark, sf):
    actual = panel(spark, sf).groupBy("entity").agg(F.count(F.lit(1)).alias("n_quarters"), F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))
    declared = actual.where("entity % 10 <> 0").withColumn("n_quarters", F.when(F.col("entity") % 3 == 0, F.col("n_quarters") - 1).otherwise(F.col("n_quarters")))
    return A.compare_declared(actual, declared, ["entity"], ["n_quarters", "first_year", "last_year"], "corpus")


@query("p12_rule_label_reproducible", rules_sql("rule_labels", {"declared": "true", "still_exists": "true", "is_distressed_equal": "n_history <> 6"}, "sample_id", "f_split").replace("count(true)", "count(*)"), ["f_split"])
def p12(spark, sf):
    s = samples2(spark, sf)
    stored = s.withColumn("is_distressed", F.when(F.col("n_history") == 6, 1 - F.col("is_distressed")).otherwise(F.col("is_distressed")))
    return A.compare_declared(S.rule_samples(panel(spark, sf), "stress_signals", 2), stored, ["sample_id"], ["is_distressed"], "rule_labels")


@query("p13_profile_numbers", rules_sql("profile", {"declared": "true", "still_exists": "true", "total_equal": "true", "distressed_equal": "split <> 'purged'", "share_equal": "true"}, "split", "(SELECT DISTINCT split FROM f_split)").replace("count(true)", "count(*)"), ["f_split"])
def p13(spark, sf):
    a = samples2(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("total"), F.sum("is_distressed").alias("distressed"), F.avg("is_distressed").alias("share"))
    d = a.withColumn("distressed", F.when(F.col("split") == "purged", F.col("distressed") + 1).otherwise(F.col("distressed"))).withColumn("share", F.col("share") + 1e-12)
    return A.compare_declared(a, d, ["split"], ["total", "distressed", "share"], "profile")


@query("p14_label_audit_numbers", rules_sql("label_audit", {"declared": "true", "still_exists": "true", "target_agreement_equal": "rule <> 'net_income<0'"}, "rule", "(SELECT unnest(['net_income<0', 'operating_income<0', 'operating_cash_flow<0', 'ocf_or_ni<0', 'current_liabilities>current_assets', 'stockholders_equity<0', 'retained_earnings<0', 'stress_signals>=1', 'stress_signals>=2']) AS rule WHERE (SELECT count(*) FROM f_panel) > 0)").replace("count(true)", "count(*)"), ["f_panel"])
def p14(spark, sf):
    a = P.rule_agreement(S.stress_label(panel(spark, sf), 2)).select("rule", "target_agreement")
    d = a.withColumn("target_agreement", F.when(F.col("rule") == "net_income<0", F.col("target_agreement") + 0.01).otherwise(F.col("target_agreement")))
    return A.compare_declared(a, d, ["rule"], ["target_agreement"], "label_audit")


@query("p15_provenance_gate", rules_sql("provenance_totals", {"no_missing_fact": "entity = entity", "no_wrong_value": "entity = entity", "no_filled_absent": "entity = entity", "no_unsupported": "entity = entity"}, "CAST(entity AS VARCHAR)", "(SELECT DISTINCT entity FROM f_cells)"), ["f_cells"])
def p15(spark, sf):
    from ..operators.facts import verify_cells
    good = cells(spark, sf).withColumn("value", (F.col("value") * 25000).cast("bigint"))
    v = verify_cells(good, facts(spark, sf))
    return A.run_rules(v, {
        "no_missing_fact": F.col("n_facts_missing") == 0, "no_wrong_value": F.col("n_value_mismatch") == 0, "no_filled_absent": F.col("n_absent_but_filled") == 0,
        "no_unsupported": F.col("n_unsupported_method") == 0}, F.col("entity").cast("string"), "provenance_totals")


def scored(spark, sf):
    s = samples2(spark, sf)
    p = (F.col("n_history") % 10) / 10.0
    return s.select("sample_id", "n_history", F.col("is_distressed").alias("y"), p.alias("p")).withColumn(
        "predicted", F.when(F.col("n_history") == 4, 1).otherwise((F.col("p") >= 0.5).cast("int")))


@query("p16_scored_table_rules", rules_sql("scores", {"scored_sample_exists": "true", "sample_is_scored": "n_history <> 11", "label_equals": "CASE WHEN n_history <> 11 THEN true END", "predicted_follows_threshold": "CASE WHEN n_history <> 11 THEN n_history <> 4 END"}, "sample_id", "f_split").replace("count(true)", "count(CASE WHEN n_history <> 11 THEN 1 END)")
       + " UNION ALL " + rules_sql("score_metrics", {"declared": "true", "still_exists": "true", "tp_equal": "true", "fp_equal": "true", "fn_equal": "true", "tn_equal": "true", "precision_equal": "true", "recall_equal": "false", "specificity_equal": "true", "accuracy_equal": "true"}, "'all'", "(SELECT 1 AS one)"), ["f_split"])
def p16(spark, sf):
    t = scored(spark, sf).where("n_history <> 11")
    names = ["precision", "recall", "specificity", "accuracy"]
    declared = M.with_metrics(M.confusion(t, 0.5), names).withColumn("recall", F.col("recall") + 0.001)
    return A.scored_rules(t.drop("n_history"), samples2(spark, sf), 0.5, declared)


@query("p17_prior_recomputation", rules_sql("priors", {"declared": "entity % 6 <> 0", "still_exists": "true", "prior_equal": "CASE WHEN entity % 6 <> 0 THEN true END"}, "CAST(entity AS VARCHAR)", "f_prior").replace("count(true)", "count(*)"), ["f_prior"])
def p17(spark, sf):
    a = P.entity_prior(samples2(spark, sf))
    return A.compare_declared(a, a.where("entity % 6 <> 0"), ["entity"], ["prior"], "priors")


@query("p18_accounting_identity", rules_sql("identity", {"liabilities_equal_assets_minus_equity": "CASE WHEN liabilities IS NOT NULL THEN abs(liabilities - (total_assets - stockholders_equity)) <= 5e-3 * abs(total_assets) END"}, KEY, "(SELECT * REPLACE (CASE WHEN entity % 5 = 0 AND fiscal_quarter = 4 THEN liabilities * 2 ELSE liabilities END AS liabilities) FROM f_panel)"), ["f_panel"])
def p18(spark, sf):
    p = panel(spark, sf).withColumn("liabilities", F.when((F.col("entity") % 5 == 0) & (F.col("fiscal_quarter") == 4), F.col("liabilities") * 2).otherwise(F.col("liabilities")))
    ok = F.when(F.col("liabilities").isNotNull(), F.abs(F.col("liabilities") - (F.col("total_assets") - F.col("stockholders_equity"))) <= 0.005 * F.abs("total_assets"))
    return A.run_rules(p, {"liabilities_equal_assets_minus_equity": ok}, A.cell_key(), "identity")


@query("p19_balance_recomputation", rules_sql("class_balance", {"declared": "true", "still_exists": "true", "n_equal": "true", "positive_equal": "split <> 'train'", "level_equal": "true"}, "split", "(SELECT DISTINCT split FROM f_split)").replace("count(true)", "count(*)"), ["f_split"])
def p19(spark, sf):
    a = P.class_balance(samples2(spark, sf), "is_distressed", ["split"])
    d = a.withColumn("positive", F.when(F.col("split") == "train", F.col("positive") - 1).otherwise(F.col("positive")))
    return A.compare_declared(a, d, ["split"], ["n", "positive", "level"], "class_balance")


@query("p20_feature_list", "WITH k AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, count({n}) AS known FROM f_feat" for n in FEATURES) + ") " + rules_sql("features", {"feature_known_somewhere": "known > 0", "listed": "feature = feature"}, "feature", "k"), ["f_feat"])
def p20(spark, sf):
    return A.feature_list_rules(X.feature_table(panel(spark, sf)), FEATURES)


@query("p21_result_table_rules", rules_sql("results", {"known_technique": "true", "score_in_unit_range": "pr_auc BETWEEN 0 AND 1", "rate_in_unit_range": "fpr BETWEEN 0 AND 1", "beats_nothing": "pr_auc > f1"}, "technique", "f_tech").replace("count(true)", "count(*)"), ["f_tech"])
def p21(spark, sf):
    from .profiles import techniques
    t = techniques(spark, sf)
    c = F.col
    return A.run_rules(t, {"known_technique": c("technique").isin([f"t{i}" for i in range(5)]), "score_in_unit_range": c("pr_auc").between(0, 1),
                           "rate_in_unit_range": c("fpr").between(0, 1), "beats_nothing": c("pr_auc") > c("f1")}, c("technique"), "results")
