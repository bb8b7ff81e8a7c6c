"""Registered queries against their SQL; PRESSGAUGE_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUICK = (
    "ag11_ten_indicators", "ag12_regional_indicators", "ag15_merged_tables", "ag21_view_dashboard", "ag22_quality_audit",
    "ag33_source_features", "ag44_themes_by_length", "ag46_matched_domains", "flt09_registry_exclusion",
    "gr01_cooccurrence", "ing06_grown_dictionary", "jn13_cascade_match", "snk02_indicator_partitions",
    "st04_stream_moving_volume", "ts05_autocorrelation", "w13_interpolation",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PRESSGAUGE_ALL") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    result = entry.queries()[name](spark, SF).toArrow()
    expected = connect(SF).execute(entry.oracle_sql()[name]).to_arrow_table()
    assert compare(result, expected) is None


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0
    bad = rows.filter("att < 0 OR att > 1 OR N > total_news")
    assert bad.isEmpty()
