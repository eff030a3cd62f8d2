"""The driver contract on the smallest tables, with SQL compared where it is quick."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_queries import TABLES, compare

QUICK = ["s2_blank_separated_scan", "p5_most_frequent_imputation", "p10_encode_against_reference", "f2_threshold_split", "a5_class_loss",
         "a13_density_histogram", "j6_cross_table_nearest", "j9_paired_comparison", "a21_wilcoxon_statistic", "w2_holm_correction",
         "m10_ks_complement", "m20_survival_distance", "m25_identifiability", "g3_independent_marginals", "k7_membership_tables", "d1_dbscan_labels"]


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["cluster", "p_type", "n_rows", "kept", "removed"]
    rows = out.collect()
    assert sum(r["n_rows"] for r in rows) == 200
    assert {r["cluster"] for r in rows} == set(range(-1, 7)) and sum(r["n_rows"] for r in rows if r["cluster"] == -1) == 8


def test_every_query_has_a_callable():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert all(callable(f) for f in contract.queries().values())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    # the flagship parameters of the larger scale still give a valid labelling here
    text, _, ok = compare(spark, con, name, small)
    assert ok, text
