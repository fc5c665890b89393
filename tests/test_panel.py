"""Hand-computed values on tiny panels."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from finstrata.constants import FEATURES, INDICATORS
from finstrata.functions.scalars import altman_z
from finstrata.operators import facts as C
from finstrata.operators import features as X
from finstrata.operators import profiles as P
from finstrata.operators import samples as S
from finstrata.operators import validate as V


def quarter(i):
    y, q = 2000 + i // 4, i % 4 + 1
    start = date(y, 3 * q - 2, 1)
    end = {1: date(y, 3, 31), 2: date(y, 6, 30), 3: date(y, 9, 30), 4: date(y, 12, 31)}[q]
    return y, q, start, end


def panel(spark, rows, entity=1):
    out = []
    for i, r in enumerate(rows):
        y, q, s, e = quarter(i)
        out.append((entity, y, q, s, e, date.fromordinal(e.toordinal() + 40), *[r.get(c) for c in INDICATORS]))
    cols = "entity long, fiscal_year int, fiscal_quarter int, period_start date, period_end date, available_on date, " + ", ".join(f"{c} long" for c in INDICATORS)
    return spark.createDataFrame(out, cols)


GOOD = dict(net_income=5, operating_cash_flow=5, operating_income=5, current_assets=10, current_liabilities=5, stockholders_equity=50, revenue=100, total_assets=100, retained_earnings=20)
BAD = dict(GOOD, net_income=-5, operating_cash_flow=-5)


def test_feature_count_and_names():
    assert len(FEATURES) == 47 and len(set(FEATURES)) == 47


def test_altman_known_value(spark):
    z = panel(spark, [GOOD]).select(altman_z().alias("z")).first()["z"]
    assert z == pytest.approx(6.56 * 0.05 + 3.26 * 0.2 + 6.72 * 0.05 + 1.05 * 50 / 50)


def test_altman_missing_is_null(spark):
    assert panel(spark, [dict(GOOD, retained_earnings=None)]).select(altman_z().alias("z")).first()["z"] is None


def test_forward_label(spark):
    rows = [GOOD] * 6 + [BAD] * 6
    got = {r["i"]: r for r in S.forward_label(panel(spark, rows), 2).withColumn("i", F.months_between("period_end", F.lit("2000-03-31")).cast("int") / 3).collect()}
    assert got[3]["label"] == 1 and got[1]["label"] == 0
    short = S.forward_label(panel(spark, [GOOD] * 6), 2).orderBy("period_end").collect()
    assert short[3]["observed_quarters"] == 2


def test_streak_breaks_on_missing(spark):
    rows = [dict(GOOD, net_income=v) for v in (-1, -1, None, -1, -1)]
    got = X.feature_table(panel(spark, rows)).orderBy("period_end").select("negative_ni_streak").collect()
    assert [r[0] for r in got] == [1.0, 2.0, 0.0, 1.0, 2.0]


def test_streak_is_capped(spark):
    got = X.feature_table(panel(spark, [BAD] * 12)).orderBy("period_end").select("negative_ni_streak").collect()
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8, 8]


def test_features_ignore_future_rows(spark):
    """Changing the last quarter leaves all earlier features alone."""
    rows = [dict(GOOD, revenue=100 + i) for i in range(10)]
    a = X.feature_table(panel(spark, rows)).orderBy("period_end").collect()
    b = X.feature_table(panel(spark, rows[:-1] + [dict(BAD, revenue=1)])).orderBy("period_end").collect()
    assert a[:-1] == b[:-1] and a[-1] != b[-1]


def test_split_policy(spark):
    got = S.time_split(panel(spark, [GOOD] * 16)).orderBy("period_end").select("split").collect()
    assert [r[0] for r in got] == ["train"] * 2 + ["purged"] + ["validation"] * 4 + ["purged"] + ["test"] * 8
    assert {r[0] for r in S.time_split(panel(spark, [GOOD] * 14)).select("split").collect()} == {"train"}


def test_runs_and_transitions(spark):
    rows = [("AAA", 1, date(2020, 3, 31)), ("AAA", 1, date(2020, 6, 30)), ("BBB", 1, date(2020, 3, 31)), ("BBB", 0, date(2020, 6, 30)), ("BBB", 1, date(2020, 9, 30))]
    df = spark.createDataFrame(rows, "entity string, is_distressed int, target_period_end date")
    s = {r["entity"]: r for r in P.label_sequences(df).collect()}
    assert (s["AAA"]["n_switches"], s["BBB"]["n_switches"]) == (0, 2)
    assert (s["AAA"]["max_run_one"], s["BBB"]["max_run_one"]) == (2, 1)
    t = P.transitions(df).first()
    assert (t["n01"], t["n10"], t["n11"], t["n00"]) == (1, 1, 1, 0)
    assert t["persistence_pct"] == pytest.approx(100 / 3)


FACT = "entity long, tag string, start_d date, end_d date, val long, fy int, fp string, filed date, accn string, unit string"


def test_year_to_date_difference(spark):
    t = "NetIncomeLoss"
    f = spark.createDataFrame([
        (1, t, date(2020, 1, 1), date(2020, 3, 31), 548648000, 2020, "Q1", date(2020, 5, 1), "a", "USD"),
        (1, t, date(2020, 1, 1), date(2020, 6, 30), 1097289000, 2020, "Q2", date(2020, 8, 1), "b", "USD")], FACT)
    p = spark.createDataFrame([(1, 2020, 2, date(2020, 4, 1), date(2020, 6, 30), date(2020, 8, 1))],
                              "entity long, fiscal_year int, fiscal_quarter int, period_start date, period_end date, available_on date")
    r = C.derive_cells(f, p).where("indicator = 'net_income'").first()
    assert r["method"] == "current_ytd_minus_previous_ytd" and r["value"] * 25000 == (1097289000 - 548648000) * 25000


def test_unpublished_fact_is_absent_unless_late_is_allowed(spark):
    f = spark.createDataFrame([(1, "Assets", None, date(2020, 3, 31), 7, 2020, "Q1", date(2021, 1, 1), "a", "USD")], FACT)
    p = spark.createDataFrame([(1, 2020, 1, date(2020, 1, 1), date(2020, 3, 31), date(2020, 5, 1))],
                              "entity long, fiscal_year int, fiscal_quarter int, period_start date, period_end date, available_on date")
    pick = lambda **kw: C.derive_cells(f, p, **kw).where("indicator = 'total_assets'").first()
    assert pick()["method"] == "absent" and pick(allow_late=True)["value"] == 7


def test_walk_forward_purge(spark):
    rows = [(f"s{i}", date(2020 + i // 12, i % 12 + 1, 28), date(2020 + i // 12, i % 12 + 1, 28)) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, target_period_end date, label_available_on date")
    for r in V.walk_forward(df, 4, 90).where("role = 'train'").collect():
        assert r["target_period_end"] < r["cut"] and (r["cut"] - r["label_available_on"]).days >= 90


def test_group_folds_equal_naive_greedy(spark):
    sizes = {g: 1 + (g * g) % 7 for g in range(60)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g long")
    got = {r["g"]: r["fold"] for r in V.group_folds(df, "g", 4).collect()}
    loads = [0] * 4
    for n in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += n
    mine = [sum(n for g, n in sizes.items() if got[g] == f) for f in range(4)]
    assert set(got) == set(sizes) and sorted(mine) == sorted(loads)


@pytest.mark.parametrize("rule", ["stress_signals", "altman_z", "forward_4q"])
def test_rules_know_their_name(spark, rule):
    assert "label" in S.label_by_rule(rule, panel(spark, [GOOD, BAD])).columns


def test_unknown_rule_is_refused(spark):
    with pytest.raises(KeyError):
        S.label_by_rule("nope", panel(spark, [GOOD]))
