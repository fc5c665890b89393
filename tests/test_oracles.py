"""A selection of registered queries against their SQL oracles (tools/check.py runs all of them)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, connect

NAMES = [
    "flagship_split_profile", "a6_usd_facts", "b3_content_fingerprint", "c4_published_asof_pick", "c5_derived_cells", "c9_discover_periods",
    "c11_verify_rebuild", "d4_time_split", "d16_forward_label", "e23_feature_matrix", "e27_extra_features", "g2_cell_verification", "g8_fold_membership",
    "h9_multi_axis_profile", "h30_split_overlap", "i3_transitions", "j3_scan_counts", "j14_full_evaluation", "k11_drift_table", "l1_winsorize_iqr",
    "m3_smote", "m6_tomek_links", "n33_delong", "n35_paired_bootstrap", "o9_local_explanations", "p8_sample_rules",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, con, name):
    got = queries()[name](spark, sf).toArrow()
    assert compare(got, con.sql(oracle_sql()[name]).to_arrow_table()) == ""


def test_entry_runs(spark):
    assert entry(spark).count() == 4


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
