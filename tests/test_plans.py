"""What the plans of the registered queries may hold."""

import pytest

import __spark_entry__ as entry
from sensorlake.queries import batch

SF_DIR = "/root/testdata/sf0.001"
# Queries that write and read on the way, and the one whose ties cost a sort.
EAGER = {"equal_times", "points_last_write", "points_store", "schema_merge_read", "prom_file_scan", "inventory_scan", "results_csv_roundtrip"}


@pytest.mark.parametrize("name", sorted(set(batch.QUERIES) - EAGER))
def test_plan(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for part in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin", "SortAggregate"):
        assert part not in plan
    # One pass over the table, but for the tables a union puts together and the
    # sizes a describe has worked out before.
    scans = {"union_series": 3}.get(name, 1)
    assert plan.count("FileScan parquet") == scans
    # The pivot's key, and a second key only where its rows are grouped again.
    twice = name in ("results_filter", "series_describe", "traffic_describe", "metric_pivot_map")
    assert plan.count("Exchange hashpartitioning") <= 1 + twice


@pytest.mark.parametrize(
    "name,columns",
    [
        ("older_than_count", {"ts"}),
        ("first_last", {"ts", "user_id", "event_type", "value"}),
        ("age_format", {"event_id", "ts"}),
        ("metric_stats", {"ts", "event_type", "value"}),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema: struct<") :].split("\n")[0]
    fields = schema.removeprefix("ReadSchema: struct<").rstrip(">").split(",")
    assert {field.split(":")[0] for field in fields} == columns
