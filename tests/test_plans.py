"""Plan-shape guards: what the optimiser must keep doing at any scale."""

import contextlib
import io

import pytest

from marketlens.plans import load_all

SF_DIR = "/root/testdata/sf0.001"
REGISTRY = load_all()
BATCH = sorted(n for n in REGISTRY if not n.startswith("stream_")
               and n not in ("order_intake", "report_from_export", "sales_report", "dashboard")
               and not n.startswith("intake_"))


def plan_of(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        REGISTRY[name].build(spark, SF_DIR).explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_or_nested_loop_join(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_related_products_limits_groups_before_the_shuffle(spark):
    tree = plan_of(spark, "related_products").split("\n\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2  # partial + final of the one window


def test_flagship_prunes_and_pre_aggregates(spark):
    plan = plan_of(spark, "sales_by_category")
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in plan
    assert "partial_sum(line_total" in plan.replace(" ", "") or "partial_sum" in plan
    # the per-product partial aggregate sits below the first exchange
    tree = plan.split("\n\n\n")[0].splitlines()
    first_exchange = next(i for i, line in enumerate(tree) if "Exchange (" in line and "Broadcast" not in line)
    assert any("HashAggregate" in line for line in tree[first_exchange:])


def test_event_filters_reach_the_scan(spark):
    plan = plan_of(spark, "page_stats")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
    assert "ReadSchema: struct<event_type:string,props:string>" in plan


def test_daily_window_pushes_the_date_bound(spark):
    plan = plan_of(spark, "daily_sales_30d")
    assert "GreaterThanOrEqual(o_orderdate,2001-07-02T00:00)" in plan
