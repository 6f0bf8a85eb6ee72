"""Plan shape: what every batch plan must (not) contain, whatever the data size."""

import contextlib
import io
import re

import pytest

from tollgate.plans import catalog

STREAMING = ("s3_", "s3r_", "t1_", "t1s_", "t2_", "t2v_", "t2s_", "t3_", "t3t_", "t4_", "t5_", "t5t_", "t6_", "s5_", "w2_")
BATCH = sorted(k for k in catalog.queries() if not k.startswith(STREAMING))
# keys whose unpartitioned window runs over a result of fixed size (a 30-day spine)
BOUNDED_GLOBAL_WINDOW = {"a16_revenue_series"}


def plan_of(spark, sf, key):
    df = catalog.queries()[key](spark, sf)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark, sf_small):
    return {k: plan_of(spark, sf_small, k) for k in BATCH}


def test_no_cartesian_or_nested_loop(plans):
    bad = [k for k, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


def test_no_unpartitioned_window_over_tables(plans):
    bad = []
    for k, p in plans.items():
        for m in re.finditer(r"\(\d+\) Window\n(?:.*\n)*?Arguments: \[(.*?)\], \[(.*?)\], \[(.*?)\]", p):
            if m.group(2).strip() == "" and k not in BOUNDED_GLOBAL_WINDOW:
                bad.append(k)
    assert bad == []


def test_clock_filters_reach_the_scan(plans):
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts,", plans["f3_rolling_window"])
    assert re.search(r"PushedFilters: \[.*In\(event_type,", plans["f4_today"])


def test_columns_pruned(plans):
    scans = re.findall(r"Location: .*?/(\w+)\.parquet\]\n(?:.*\n)*?ReadSchema: struct<(.*?)>", plans["a2_active_count"])
    assert {table: sorted(c.split(":")[0] for c in schema.split(",")) for table, schema in scans} == {
        "events": ["event_id", "event_type", "ts"], "part": ["p_partkey", "p_size"]}


def test_history_page_limits_before_shuffle(plans):
    assert re.search(r"WindowGroupLimit\n(?:.*\n)*?Arguments: .*row_number\(\), 10, Partial", plans["l2_history_page"])


@pytest.mark.parametrize("key,fn", [("w1_current_session", "max_by"), ("w3_latest_plan", "max_by"),
                                    ("j5_unused_payment", "max_by"),
                                    ("a12_favourite_package", "min"), ("w4_first_terminal", "min_by")])
def test_group_picks_are_partial_aggregates(plans, key, fn):
    p = plans[key]
    assert f"partial_{fn}(" in p, key
    assert "\n(1) Window" not in p and " Window (" not in p, key


def test_latest_payment_is_a_partial_aggregate(spark, sf_small):
    """J8's pick runs before its checkpoint, so it is looked at on its own."""
    from tollgate.operators import joins as J
    from tollgate.sources.fixtures import Tables
    p = J.latest_completed_payment(Tables(spark, sf_small).payments)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "partial_max_by(" in p and " Window (" not in p


def test_daily_stats_has_no_user_day_join(plans):
    """A6 as written joins sessions to payments on (user, day); ours never does: the
    only joins left are the single-key joins of the fixture mapping."""
    for key in ("a6_daily_stats", "a6s_daily_stats_safe"):
        assert "Left keys [2]" not in plans[key], key
        assert "Union" in plans[key], key


def test_no_python_in_any_batch_plan(plans):
    python_nodes = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                    "FlatMapCoGroupsInPandas", "AggregateInPandas", "WindowInPandas", "PythonUDF")
    bad = [(k, n) for k, p in plans.items() for n in python_nodes if n in p]
    assert bad == []
