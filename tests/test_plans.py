"""Physical plans: what reaches the scan, and what must not be planned."""

import pytest

import __spark_entry__ as entry
from lakemill.plans import views
from lakemill.session import Tables

SMALL = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan_of(spark, key):
    return QUERIES[key](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "key", [k for k in QUERIES if k.startswith(("join_", "view_", "rpt_", "udf_", "agg_", "win_"))]
)
def test_no_cross_product(spark, key):
    plan = plan_of(spark, key)
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


def test_date_range_reaches_the_scan(spark):
    plan = plan_of(spark, "flt_between_date")
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]


def test_prefix_and_list_reach_the_scan(spark):
    assert "In(o_orderpriority" in plan_of(spark, "flt_in_list")
    assert "StringEndsWith(p_name" in plan_of(spark, "flt_like_suffix")


@pytest.mark.parametrize("key", ["win_latest_row", "win_first_per_key"])
def test_rows_per_group_are_limited_before_the_shuffle(spark, key):
    assert "WindowGroupLimit" in plan_of(spark, key)


@pytest.mark.parametrize(
    "key", ["win_avg_partition", "join_self", "view_product_reviews", "win_avg_over_agg"]
)
def test_group_values_need_no_window(spark, key):
    assert "Window" not in plan_of(spark, key)


def test_small_groups_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan_of(spark, "win_avg_partition")


def test_keys_in_source_order_move_no_rows(spark):
    before_join = plan_of(spark, "win_row_number_key").split("BroadcastExchange")[0]
    assert "Exchange" not in before_join


def test_truncated_lists_are_dealt_by_ranges(spark):
    """A group of any size spreads over tasks, so no window brings it together."""
    plan = plan_of(spark, "agg_listagg_truncate")
    assert "rangepartitioning(l_suppkey" in plan and "Window" not in plan


def test_months_are_grouped_as_days(spark):
    """No line is turned into text before the sums."""
    plan = views.month_sales(Tables(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    top, *below = plan.strip().splitlines()
    assert "date_format" in top and "trunc" in plan
    assert not any("date_format" in line for line in below)
