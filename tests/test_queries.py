"""Registered queries against their SQL at the smallest scale, and what their plans may hold."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# These write whole tables; the ingest tests cover the same paths on small files.
SLOW = {
    "ingest_folder", "ingest_mixed", "ingest_report", "ingest_zip", "ingest_stream", "file_manifest", "export_manifest", "report_combined", "report_combined_cells",
    "report_submission", "report_registrant", "report_preview", "dashboard_tables", "sample_bundles", "sample_export_all",
}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, con, key):
    text, good = compare(spark, con, SF, key, QUERIES[key], SQL.get(key))
    assert good, text


def test_entry(spark):
    assert entry.entry(spark).columns == ["Rank", "Technology", "Count", "Percentage"]


def executed(spark, key):
    df = QUERIES[key](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", ["top_technologies", "reconcile_all", "entity_lookup_batch", "skills_trend_monthly", "organizer_report"])
def test_no_product_of_tables_and_no_python(spark, key):
    plan = executed(spark, key)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonEval", "ArrowEval", "InPandas"):
        assert word not in plan


def test_total_shares_the_shuffle_of_the_counts(spark):
    assert "ReusedExchange" in executed(spark, "top_technologies")


def test_columns_are_pruned(spark):
    plan = QUERIES["time_trends_weekly"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in plan


def test_samples_count_before_they_rank(spark):
    assert "HashAggregate" in executed(spark, "sample_batch")
