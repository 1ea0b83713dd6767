"""Plan properties of every registered query: no Python evaluation, no
cartesian or nested-loop joins, only hash aggregates, and parquet scans read
a pruned column set."""

import re

from revlens.plans.catalog import catalogue
from conftest import SF_SMALL

FULL_WIDTH = {"lineitem": 11, "orders": 6, "events": 6, "part": 6, "customer": 5}
# The Holt-Winters fit gathers each series' yearly points (collect_list) and picks the best
# grid point with a struct-ordered min_by; both run on (series x 125) rows after aggregation.
ORDER_COLUMNS = {"o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice"}   # of 6
SMALL_TABLE_AGGREGATES = {"hw_fine_fit", "hw_fine_forecast", "hw_forecast", "hw_fitted", "growth_projection"}


def test_plan_properties(spark):
    for name, q in catalogue().items():
        plan = q(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        bad = ["BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
               "CartesianProduct", "BroadcastNestedLoopJoin"]
        if name not in SMALL_TABLE_AGGREGATES:
            bad += ["SortAggregate", "ObjectHashAggregate"]
        for b in bad:
            assert b not in plan, (name, b)
        for cols, table in re.findall(r"FileScan parquet \[([^\]]*)\].*?/([a-z_]+)\.parquet\]", plan):
            assert len(cols.split(",")) < FULL_WIDTH.get(table, 99), (name, table, cols)


def test_finance_filters_reach_the_parquet_scan(spark):
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plans = {n: catalogue()[n](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
                 for n in ("finance_monthly_long", "finance_sales_by_unit", "finance_yearly_by_account")}
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    for name in ("finance_monthly_long", "finance_sales_by_unit"):
        pushed = re.search(r"lineitem\.parquet\].*?PushedFilters: \[([^\]]*)\]", plans[name]).group(1)
        assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed, (name, pushed)
        assert "l_returnflag" in pushed, (name, pushed)
    pushed = re.search(r"lineitem\.parquet\].*?PushedFilters: \[([^\]]*)\]",
                       plans["finance_yearly_by_account"]).group(1)
    assert "l_linestatus" in pushed and "l_returnflag" in pushed, pushed


def test_rollups_read_the_service_rows_once(spark):
    """One lineitem scan, no hot-key broadcast and no forced hash join."""
    for name in ("domain_rollup", "hosting_rollup", "customer_totals", "product_revenue_long", "revenue_by_product_status"):
        plan = catalogue()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"l_orderkey#\d+L?,.*parquet", plan)) == 1, (name, plan)
        assert "shuffle_hash" not in plan and "rightHint" not in plan, name


def test_annual_kpis_read_no_tickets(spark):
    for name in ("annual_metric_table", "acquisition_cost"):
        plan = catalogue()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" not in plan, name


def test_cohort_reads_the_invoices_once(spark):
    """One orders scan, of the columns that cleaning and the cohort need."""
    metrics = [n for n, q in catalogue().items() if n.startswith(("yearly_", "cohort_", "annual_cohort", "lagged_", "rate_bands"))]
    for name in ["annual_cohort", "cohort_forecast", *metrics]:
        plan = catalogue()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?/orders\.parquet\]", plan)
        assert [{c.split("#")[0] for c in x.split(",")} <= ORDER_COLUMNS for x in scans] == [True], (name, scans)


def test_typing_text_does_not_copy_its_expressions(spark):
    """A key's text is evaluated once in the projection and once in the filter."""
    for name in ("typed_invoices", "typed_hosting"):
        plan = catalogue()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 14_000 and plan.count("raise_error") <= 8, (name, len(plan), plan.count("raise_error"))
