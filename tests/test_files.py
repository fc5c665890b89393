"""Round trips through files and the errors a user can meet."""

import json

import pytest
from pyspark.sql import functions as F

from finstrata.operators import audit as A
from finstrata.plans.features import samples2
from finstrata.plans.views import facts, panel
from finstrata.sources import documents as D
from finstrata.sources import writers as Wr


def test_split_round_trip_prunes_partitions(spark, sf, tmp_path):
    s = samples2(spark, sf)
    Wr.write_splits(s, str(tmp_path / "splits"))
    got = D.load_split(spark, str(tmp_path / "splits"), "test")
    assert got.count() == s.where("split = 'test'").count()
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        D.load_split(spark, str(tmp_path / "splits"), "holdout")


def test_fact_documents(spark, tmp_path):
    doc = {"cik": 5, "entityName": "Low", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2020-03-31", "val": 9, "accn": "x-1", "fy": 2020, "fp": "Q1", "form": "10-Q", "filed": "2020-05-01"}], "EUR": []}}}}}
    (tmp_path / "LOW-companyfacts.json").write_text(json.dumps(doc, indent=1))
    r = D.read_fact_documents(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0]["entity"], r[0]["tag"], r[0]["val"], r[0]["start_d"]) == ("LOW", "Assets", 9, None)


def test_landed_facts_push_filters_down(spark, sf, tmp_path):
    Wr.land_facts(facts(spark, sf), str(tmp_path / "facts"), 4)
    df = spark.read.parquet(str(tmp_path / "facts")).where("tag = 'Assets' and unit = 'USD'").select("entity", "val")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag,Assets)" in plan and df.count() > 0


def test_labelled_csv_checks(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("a,cls\n1.5,0\n2.5,1\n")
    bad.write_text("a,cls\n1.5,0\n2.5,3\n")
    assert D.read_labelled_csv(spark, str(good), "cls").count() == 2
    with pytest.raises(ValueError):
        D.read_labelled_csv(spark, str(bad), "cls")
    with pytest.raises(KeyError):
        D.read_labelled_csv(spark, str(good), "target")


def test_ranked_csv_has_mark_and_order(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "entity string, p double")
    Wr.write_ranked_csv(df, str(tmp_path / "r"))
    text = "".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "r").glob("part-*.csv")))
    assert text.startswith("﻿") and text.index("b,0.9") < text.index("a,0.1")


def test_file_hashes(spark, tmp_path):
    import hashlib
    (tmp_path / "x.bin").write_bytes(b"hello")
    assert Wr.file_hashes(spark, str(tmp_path)).first()["sha256"] == hashlib.sha256(b"hello").hexdigest()


def test_ledger_appends(spark, tmp_path):
    t = spark.createDataFrame([(1, 0.5, 3)], "trial int, ap double, depth int")
    for _ in range(2):
        Wr.append_ledger(t, ["depth"], str(tmp_path / "led"))
    rows = spark.read.json(str(tmp_path / "led")).collect()
    assert len(rows) == 2 and json.loads(rows[0]["params"]) == {"depth": 3}


def test_clean_panel_has_no_issue_and_one_damaged_row_has_one(spark, sf):
    p = panel(spark, sf)
    assert A.quarter_rules(p).agg(F.sum("n_bad")).first()[0] == 0
    first = F.col("period_end") == p.agg(F.min("period_end")).first()[0]
    hurt = p.withColumn("available_on", F.when(first & (F.col("entity") == 1), F.date_sub("period_end", 1)).otherwise(F.col("available_on")))
    bad = A.quarter_rules(hurt).where("n_bad > 0").collect()
    assert [(r["rule"], r["n_bad"]) for r in bad] == [("published_after_end", 1)]
