"""Reconciliation rules. Each rule is an expectation over rows; the result is a table of rule totals.

A rule table is (rule, n, n_bad, example): every rule aggregates its own failures, so the report does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import AUDIT_QUARTER_DAYS, INDICATORS, METHODS, N_TEST
from ..functions.panel import entity_rows, rows_so_far
from ..functions.scalars import close
from .facts import CELL, derived_value


def run_rules(df: DataFrame, rules: dict[str, Column], key: Column, group: str) -> DataFrame:
    """Evaluate all row rules of a group in one pass; a rule that yields NULL does not apply to the row."""
    one = lambda ok: F.sum(F.when(~ok, 1).otherwise(0))
    aggs = []
    for i, (name, ok) in enumerate(rules.items()):
        aggs += [F.count(ok).alias(f"n{i}"), one(ok).alias(f"b{i}"), F.min(F.when(~ok, key)).alias(f"e{i}")]
    row = df.agg(*aggs)
    out = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"n{i}").alias("n"), F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("n_bad"),
                             F.col(f"e{i}").cast("string").alias("example")) for i, name in enumerate(rules)])
    return row.select(F.explode(out).alias("r")).select(F.lit(group).alias("grp"), "r.*")


def collect_checks(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_summary(checks: DataFrame) -> DataFrame:
    return checks.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rules"), F.sum("n").alias("n_checks"), F.sum("n_bad").alias("n_issues"))


def cell_key() -> Column:
    return F.concat(F.col("entity").cast("string"), F.lit("-"), F.col("fiscal_year"), F.lit("Q"), F.col("fiscal_quarter"))


def quarter_rules(panel: DataFrame, currency: str = "VND") -> DataFrame:
    """Length, publication order, quarter number, continuity of every quarter row."""
    prev = lambda c: F.lag(c).over(entity_rows())
    t = panel.select(
        "entity", "fiscal_year", "fiscal_quarter", "period_end", "available_on", *(["currency"] if "currency" in panel.columns else []),
        F.datediff("period_end", "period_start").alias("days"), prev("fiscal_year").alias("py"), prev("fiscal_quarter").alias("pq"), prev("period_end").alias("pe"))
    q_ok = F.col("fiscal_quarter").between(1, 4)
    both = q_ok & F.col("pq").between(1, 4)
    next_ok = (F.col("fiscal_year") == F.when(F.col("pq") == 4, F.col("py") + 1).otherwise(F.col("py"))) & (
        F.col("fiscal_quarter") == F.when(F.col("pq") == 4, 1).otherwise(F.col("pq") + 1))
    rules = {
        "quarter_length": F.coalesce(F.col("days").between(*AUDIT_QUARTER_DAYS), F.lit(False)),
        "published_after_end": F.coalesce(F.col("available_on") >= F.col("period_end"), F.lit(False)),
        "quarter_number": F.coalesce(q_ok, F.lit(False)),
        "period_end_grows": F.when(both, F.col("period_end") > F.col("pe")),
        "quarter_follows": F.when(both, next_ok),
    }
    if "currency" in panel.columns:
        rules["currency"] = F.coalesce(F.col("currency") == currency, F.lit(False))
    return run_rules(t, rules, cell_key(), "quarters")


def document_rules(docs: DataFrame, rate: int, currency: str = "VND", n_fields: int = len(INDICATORS)) -> DataFrame:
    return run_rules(docs, {
        "document_currency": F.col("currency") == currency, "document_rate": F.col("vnd_per_usd") == rate,
        "document_indicator_count": F.col("indicator_count") == n_fields,
    }, F.col("entity").cast("string"), "documents")


def registry_rules(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Snapshot hash, id and name against the registry; both sides must be complete."""
    j = files.alias("f").join(registry.alias("r"), F.col("f.ticker") == F.col("r.ticker"), "full")
    both = F.col("f.ticker").isNotNull() & F.col("r.ticker").isNotNull()
    same = lambda c: F.when(both, F.col(f"f.{c}").eqNullSafe(F.col(f"r.{c}")))
    return run_rules(j, {
        "registered": F.col("r.ticker").isNotNull(), "file_present": F.col("f.ticker").isNotNull(), "sha256": same("sha256"), "cik": same("cik"),
        "entity_name": same("entity_name"),
    }, F.coalesce("f.ticker", "r.ticker"), "snapshots")


def expected_values(cells: DataFrame, rate: int) -> DataFrame:
    """Rules on the facts of a cell and the value they imply. Facts are ordered by (end, filed)."""
    facts = F.array_sort(F.transform("facts", lambda f: F.struct(f["end_d"].alias("end_d"), f["filed"].alias("filed"), f["start_d"].alias("start_d"), f["val"].alias("val"))))
    t = cells.withColumn("_f", facts).withColumn("_n", F.size("facts"))
    cur, prv = F.get("_f", F.col("_n") - 1), F.get("_f", F.col("_n") - 2)
    ytd = F.col("method") == "current_ytd_minus_previous_ytd"
    instant, duration = F.col("method") == "instant", F.col("method").isin("reported_quarter", "reported_first_quarter")
    one = F.get("facts", F.lit(0))
    value = F.when(ytd & (F.col("_n") >= 2), (cur["val"] - prv["val"]) * rate).when((instant | duration) & (F.col("_n") >= 1), one["val"] * rate)
    return t.select(
        *CELL, "indicator", "method", "value", value.alias("expected"),
        F.when(ytd, F.col("_n") >= 2).alias("ytd_has_two"),
        F.when(ytd & (F.col("_n") >= 2), cur["end_d"] == F.col("period_end")).alias("ytd_ends_at_period"),
        F.when(ytd & (F.col("_n") >= 2), cur["start_d"].eqNullSafe(prv["start_d"])).alias("ytd_same_start"),
        F.when(ytd & (F.col("_n") >= 2), prv["end_d"] < F.col("period_start")).alias("ytd_previous_before"),
        F.when(duration & (F.col("_n") >= 1), (one["start_d"] == F.col("period_start")) & (one["end_d"] == F.col("period_end"))).alias("duration_matches_period"),
        F.when(instant & (F.col("_n") >= 1), one["start_d"].isNull() & (one["end_d"] == F.col("period_end"))).alias("instant_matches_period"),
        F.when(instant | duration, F.col("_n") <= 1).alias("single_fact"))


FACT_RULES = ["ytd_has_two", "ytd_ends_at_period", "ytd_same_start", "ytd_previous_before", "duration_matches_period", "instant_matches_period", "single_fact"]


def fact_rules(cells: DataFrame, rate: int) -> DataFrame:
    t = expected_values(cells, rate)
    rules = {r: F.col(r) for r in FACT_RULES}
    rules["value_as_expected"] = F.when(F.col("expected").isNotNull(), F.col("value").eqNullSafe(F.col("expected")))
    return run_rules(t, rules, F.concat(cell_key(), F.lit(":"), F.col("indicator")), "facts")


def provenance_rules(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Known method, absent means nothing stored, every fact exists with its value, publication date, address."""
    key = [*CELL, "indicator"]
    used = cells.select(*key, F.posexplode("facts").alias("pos", "f")).select(*key, "pos", "f.*")
    have = facts.select("entity", F.col("tag").alias("_t"), F.col("start_d").alias("_s"), F.col("end_d").alias("_e"), F.col("accn").alias("_a"), F.col("val").alias("_v")).groupBy(
        "entity", "_t", "_s", "_e", "_a").agg(F.collect_set("_v").alias("_vals"))
    h = have.withColumnRenamed("entity", "_en")
    j = used.join(h, (F.col("entity") == F.col("_en")) & (F.col("tag") == F.col("_t")) & F.col("start_d").eqNullSafe(F.col("_s"))
                  & (F.col("end_d") == F.col("_e")) & (F.col("accn") == F.col("_a")), "left")
    found = j.groupBy(*key).agg(
        F.min(F.col("_t").isNotNull().cast("int")).alias("exists_all"),
        F.min(F.when(F.col("_t").isNotNull(), F.array_contains("_vals", F.col("val")).cast("int"))).alias("values_all"))
    latest = F.element_at(F.array_sort(F.transform("facts", lambda f: F.struct(f["filed"].alias("filed"), f["end_d"].alias("end_d"), f["accn"].alias("accn")))), -1)
    has = F.size("facts") > 0
    t = cells.join(found, key, "left")
    known, absent = F.col("method").isin(METHODS), F.col("method") == "absent"
    live = known & ~absent
    return run_rules(t.withColumn("_last", F.when(has, latest)), {
        "method_known": known, "absent_is_empty": F.when(absent, ~has & F.col("value").isNull()), "has_facts": F.when(live, has),
        "fact_exists": F.when(live & has, F.coalesce(F.col("exists_all") == 1, F.lit(False))),
        "fact_value": F.when(live & has & F.col("values_all").isNotNull(), F.col("values_all") == 1),
        "available_on_is_latest_filing": F.when(live & has, F.col("available_on") == F.col("_last.filed")),
    }, F.concat(cell_key(), F.lit(":"), F.col("indicator")), "provenance")


def split_reconciliation(expected: DataFrame, stored: DataFrame) -> DataFrame:
    e = expected.select("sample_id", F.col("split").alias("expected"))
    s = stored.select("sample_id", F.col("split").alias("stored"))
    return e.join(s, "sample_id", "full").select("sample_id", F.coalesce("expected", F.lit("none")).alias("expected"), F.coalesce("stored", F.lit("none")).alias("stored"))


def sample_rules(stored: DataFrame, panel: DataFrame) -> DataFrame:
    """Stored samples against the panel: history size, decision time, target, label date, no look ahead.

    History conditions use running maxima over the panel instead of joining each sample with all its history rows.
    """
    prev = lambda c: F.lag(c).over(entity_rows())
    p = panel.select(
        F.concat(F.col("entity").cast("string"), F.lit("-"), F.col("fiscal_year"), F.lit("Q"), F.col("fiscal_quarter")).alias("sample_id"),
        (F.row_number().over(entity_rows()) - 1).alias("p_history"), prev("available_on").alias("p_as_of"), F.col("period_start").alias("p_start"),
        F.col("period_end").alias("p_end"), F.col("available_on").alias("p_label_on"),
        F.max("available_on").over(entity_rows().rowsBetween(-(2**31) + 1, -1)).alias("p_seen"), F.max("period_end").over(entity_rows().rowsBetween(-(2**31) + 1, -1)).alias("p_last_end"))
    j = stored.join(p, "sample_id", "left")
    ok = F.col("p_end").isNotNull()
    return run_rules(j, {
        "id_well_formed": F.col("sample_id").rlike(r"^[A-Z0-9]+-\d{4}Q[1-4]$"), "target_in_panel": ok, "has_history": F.when(ok, F.col("p_history") >= 1),
        "history_length": F.when(ok, F.col("n_history") == F.col("p_history")), "as_of_matches": F.when(ok, F.col("as_of").eqNullSafe(F.col("p_as_of"))),
        "target_period": F.when(ok, (F.col("target_period_start") == F.col("p_start")) & (F.col("target_period_end") == F.col("p_end"))),
        "label_date": F.when(ok, F.col("label_available_on") == F.col("p_label_on")), "label_binary": F.col("is_distressed").isin(0, 1),
        "label_not_before_as_of": F.col("label_available_on") >= F.col("as_of"), "history_published_by_as_of": F.when(ok, F.col("p_seen") <= F.col("as_of")),
        "history_before_target": F.when(ok, F.col("p_last_end") < F.col("target_period_start")),
    }, F.col("sample_id"), "samples")


def split_rules(expected: DataFrame, stored: DataFrame) -> DataFrame:
    dup = stored.groupBy("sample_id").agg(F.count(F.lit(1)).alias("k"))
    once = run_rules(dup, {"in_one_split": F.col("k") == 1}, F.col("sample_id"), "splits")
    r = split_reconciliation(expected, stored.dropDuplicates(["sample_id"]))
    return once.unionByName(run_rules(r, {
        "every_sample_stored": F.when(F.col("expected") != "none", F.col("stored") != "none"),
        "no_extra_sample": F.when(F.col("stored") != "none", F.col("expected") != "none"),
        "split_as_policy": F.when((F.col("expected") != "none") & (F.col("stored") != "none"), F.col("expected") == F.col("stored")),
    }, F.col("sample_id"), "splits"))


def compare_declared(actual: DataFrame, declared: DataFrame, keys: Sequence[str], values: Sequence[str], group: str, tol: float = 1e-9) -> DataFrame:
    """Declared numbers against recomputed ones, per value column; keys must exist on both sides."""
    a = actual.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("_a"))
    d = declared.select(*keys, *[F.col(v).alias(f"d_{v}") for v in values], F.lit(1).alias("_d"))
    j = a.join(d, list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_d").isNotNull()
    types = dict(actual.dtypes)
    same = lambda v: (close(F.col(f"a_{v}"), F.col(f"d_{v}"), tol) if types[v] in ("double", "float") else F.col(f"a_{v}").eqNullSafe(F.col(f"d_{v}")))
    rules = {"declared": F.col("_d").isNotNull(), "still_exists": F.col("_a").isNotNull(), **{f"{v}_equal": F.when(both, same(v)) for v in values}}
    return run_rules(j, rules, F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), group)


def manifest_rules(samples: DataFrame, declared: DataFrame) -> DataFrame:
    """Counts, positives and ranges per split, and: the test split is the last two fiscal years of every entity."""
    from ..sources.writers import build_manifest

    base = compare_declared(build_manifest(samples), declared, ["split"], ["n", "positives", "entities", "first_start", "last_end"], "manifest")
    last = samples.groupBy("entity").agg(
        F.max("target_fiscal_year").alias("last_year"), F.count(F.when(F.col("split") == "test", 1)).alias("n_test"),
        F.min(F.when(F.col("split") == "test", F.col("target_fiscal_year"))).alias("first_test_year"))
    years = run_rules(last.where("n_test > 0"), {
        "test_size": F.col("n_test") == N_TEST, "test_is_last_two_years": F.col("first_test_year") == F.col("last_year") - 1,
    }, F.col("entity").cast("string"), "manifest")
    return base.unionByName(years)


def fit_window_rules(bounds: DataFrame, validation_fit_before: Column, final_fit_before: Column) -> DataFrame:
    """A declared fit date lies between the last publication used for fitting and the first decision it serves."""
    at = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    t = bounds.agg(at("train", "max_published").alias("t"), at("validation", "max_published").alias("v"), at("validation", "min_as_of").alias("va"), at("test", "min_as_of").alias("ta"))
    return run_rules(t, {
        "validation_fit_window": (F.col("t") <= validation_fit_before) & (validation_fit_before <= F.col("va")),
        "final_fit_window": (F.greatest("t", "v") <= final_fit_before) & (final_fit_before <= F.col("ta")),
    }, F.lit("manifest"), "fit_windows")


def scored_rules(scored: DataFrame, samples: DataFrame, threshold: float, declared: DataFrame) -> DataFrame:
    """Scored table against samples and against declared metrics."""
    from .metrics import confusion, with_metrics

    s = samples.select("sample_id", F.col("is_distressed").alias("_y"), F.lit(1).alias("_in"))
    j = scored.join(s, "sample_id", "full")
    rows = run_rules(j, {
        "scored_sample_exists": F.when(F.col("p").isNotNull(), F.col("_in").isNotNull()), "sample_is_scored": F.when(F.col("_in").isNotNull(), F.col("p").isNotNull()),
        "label_equals": F.when(F.col("_in").isNotNull() & F.col("p").isNotNull(), F.col("y") == F.col("_y")),
        "predicted_follows_threshold": F.when(F.col("p").isNotNull(), F.col("predicted") == (F.col("p") >= threshold).cast("int")),
    }, F.col("sample_id"), "scores")
    names = ["precision", "recall", "specificity", "accuracy"]
    actual = with_metrics(confusion(scored, threshold), names).withColumn("k", F.lit("all"))
    return rows.unionByName(compare_declared(actual, declared.withColumn("k", F.lit("all")), ["k"], ["tp", "fp", "fn", "tn", *names], "score_metrics"))


def feature_list_rules(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """Feature columns present, none unexpected, and how often each is known."""
    have = [c for c in table.columns if c in names]
    known = table.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in have])
    long = known.unpivot(["n"], have, "feature", "known")
    return run_rules(long, {"feature_known_somewhere": F.col("known") > 0, "listed": F.col("feature").isin(list(names))}, F.col("feature"), "features")
