"""Fixture CSV round trip: the five billing exports and
the finance sheet, with the edge rows of FIXTURES.md, through every query."""

import os
import tempfile

import pytest

from revlens.plans.catalog import CsvFeeds, run_on_feeds
from revlens.sources.feeds import FINANCE_MONTHS
from test_plans import SMALL_TABLE_AGGREGATES

FILES = {
    "invoice": "id,userid,date,status,total\n"
               "1,1,2000-06-15,Paid,100.00\n2,1,2001-06-14,Paid,7.00\n3,1,2001-06-15,Paid,9.00\n"
               "4,2,2001-01-01,Unpaid,5.00\n5,2,2001-02-01,Paid,0\n6,3,2000-01-01,Paid,\n"
               ",4,2000-01-01,Paid,1\nabc,4,2000-01-01,Paid,1\n7,x,2000-01-01,Paid,1\n8,0,2000-01-01,Paid,1\n"
               "9,5,1999-7-5,Paid,12.5\n",
    "domain": "id,userid,nextinvoicedate,firstpaymentamount,recurringamount,status\n"
              "1,1,2001-03-17,10,120,Active\n2,1,2001-03-18,10,120,Active\n3,1,2001-06-15,20,60,Active\n"
              "4,2,2001-06-16,5,12,Active\n5,2,2001-06-16,6,12,Active\n6,3,,1,1,Active\n7,5,2001-7-5,3,36,Active\n",
    "hosting": "id,userid,nextinvoicedate,termination_date,firstpaymentamount,amount,billingcycle,domainstatus\n"
               "1,1,,2001-01-01,10,30,Monthly,Active\n2,1,2001-08-01,2001-01-01,10,30,Monthly,Completed\n"
               "3,2,2001-08-14,,10,365,Annually,Active\n4,2,2001-08-14,,10,365,One Time,Active\n"
               "5,3,2001-09-01,,,,Quarterly,Active\n",
    "hostingaddon": "id,userid,nextinvoicedate,termination_date,firstpaymentamount,recurring,billingcycle,status\n"
                    "1,1,2001-10-01,,4,60,Biennially,Active\n2,4,2001-10-01,,4,60,Semi-Annually,Completed\n"
                    "3,4,2001-12-01,,4,60,Triennially,Active\n",
    "ticket": "id,userid\n1,1\n2,1\n3,9\n4,0\n,3\n",
}
FINANCE = ("Scenario,business_unit,Account,Year," + ",".join(FINANCE_MONTHS) + "\n"
           "Actuals,Software,Sales,1997," + ",".join(["10"] * 11 + [""]) + "\n"
           "Budget,Software,Sales,1997," + ",".join(["9"] * 12) + "\n"
           "Actuals,Software,COGS,1997," + ",".join(["-3"] * 12) + "\n"
           "Actuals,Hardware,,1997," + ",".join(["-1"] * 12) + "\n"
           "Actuals,Software,Sales,1996," + ",".join(["5"] * 12) + "\n")


@pytest.fixture(scope="module")
def feeds(spark):
    d = tempfile.mkdtemp(prefix="revlens-feeds-")
    paths = {}
    for name, text in FILES.items():
        paths[name] = os.path.join(d, f"{name}.csv")
        with open(paths[name], "w") as fh:
            fh.write(text)
    fin = os.path.join(d, "finance.csv")
    with open(fin, "w") as fh:
        fh.write(FINANCE)
    return CsvFeeds(spark, paths, fin)


def test_every_query_runs_on_csv_feeds(feeds):
    outs = run_on_feeds(feeds)
    for name, df in outs.items():
        # the fixture has no sales in the default finance years
        assert df.count() > 0 or name.startswith("finance_"), name


def test_csv_values(feeds):
    outs = run_on_feeds(feeds, ["profit_by_customer", "domain_status", "invoice_12m_by_user",
                                "finance_yearly_by_account", "hosting_rollup"])
    profit = {r.userid: (r.revenue, r.tickets) for r in outs["profit_by_customer"].collect()}
    assert profit[1.0] == (116.0, 2) and profit[9.0] == (0.0, 1) and profit[3.0] == (0.0, 0)
    status = {r.id: r.final_status for r in outs["domain_status"].collect()}
    assert status == {1.0: "Inactive", 2.0: "Active", 3.0: "Active", 4.0: "Active", 5.0: "Active",
                      6.0: "Inactive", 7.0: "Active"}
    r12 = {r.userid: (r.revenue_12m, r.in_12m) for r in outs["invoice_12m_by_user"].collect()}
    assert r12[1.0] == (7.0, True) and r12[2.0] == (0.0, True) and r12[3.0] == (None, False)
    assert [tuple(r) for r in outs["finance_yearly_by_account"].collect()] == [("COGS", 1997, 36.0)]
    host = {r.userid: r for r in outs["hosting_rollup"].collect()}
    assert host[1.0].final_status == "Active" and host[3.0].payment is None


def test_csv_edge_rows(feeds):
    outs = run_on_feeds(feeds, ["service_payment", "hosting_rollup", "lagging_cycles", "domain_rollup",
                                "free_service_cost", "cycle_rate"])
    pay = {(r.product, r.id): r.payment for r in outs["service_payment"].collect()}
    # customer 2's two domains tie at the earliest next date: both pay the first amount
    assert pay[("domain", 4.0)] == 5.0 and pay[("domain", 5.0)] == 6.0
    # customer 1: earliest date 2001-03-17 pays first (10), the others recurring
    assert pay[("domain", 1.0)] == 10.0 and pay[("domain", 2.0)] == 120.0 and pay[("domain", 3.0)] == 60.0
    host = {r.userid: r for r in outs["hosting_rollup"].collect()}
    # hosting with NULL amounts and a future date: future revenue 0, not NULL; no revenue
    assert host[3.0].future_revenue == 0.0 and host[3.0].revenue is None
    lag = {(r.product, r.id): r.lagging_cycles for r in outs["lagging_cycles"].collect()}
    assert lag[("domain", 3.0)] == round(-1 / 30, 6)          # next = as_of's day, noon as_of -> -1 day
    assert lag[("domain", 4.0)] == 0.0                        # next day -> 0 days, not a free period
    assert lag[("hosting", 1.0)] is None                      # Active without a next date
    rate = {(r.product, r.id): r.cycle_rate for r in outs["cycle_rate"].collect()}
    assert rate[("hosting", 4.0)] is None                     # flagged, unknown cycle
    assert rate[("hosting", 3.0)] == 1.0                      # 365 / 365 days


def test_text_feeds_aggregate_by_hash(feeds):
    for name, df in run_on_feeds(feeds).items():
        if name not in SMALL_TABLE_AGGREGATES:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan, name
