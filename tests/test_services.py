"""Service rollups against a brute-force row loop on random frames with NULL
dates, ties at the earliest date, unknown cycles and a hot customer; the
skew-safe join must give the same rows whatever the salting."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revlens.operators import services
from conftest import AS_OF

CYCLES = ["Monthly", "Quarterly", "Semi-Annually", "Annually", "Biennially", "Triennially", "One Time"]
DAYS = {"Annually": 365, "Monthly": 30, "Biennially": 730, "Semi-Annually": 182.5, "Triennially": 1095,
        "Quarterly": 91.25}
SCHEMA = ("product string, id bigint, userid bigint, nextinvoicedate timestamp_ntz, "
          "termination_date timestamp_ntz, firstpaymentamount decimal(18,2), recurringamount decimal(18,4), "
          "billingcycle string, status string")


def _random_rows(seed=7, n=400):
    rnd = random.Random(seed)
    dates = [AS_OF.replace(hour=0) + timedelta(days=d) for d in (-200, -91, -90, -1, 0, 1, 40)]
    rows = []
    for i in range(n):
        user = 1 if rnd.random() < 0.35 else rnd.randint(2, 25)     # customer 1 holds ~1/3 of the rows
        rows.append((rnd.choice(["domain", "hosting", "hostingaddons"]), i, user,
                     None if rnd.random() < 0.15 else rnd.choice(dates),
                     rnd.choice([None, None, dates[0]]),
                     Decimal(rnd.choice(["0.00", "10.00", "25.50", "99.99"])),
                     Decimal(rnd.choice(["0.0000", "8.5000", "20.1234"])),
                     rnd.choice(CYCLES), rnd.choice(["Active", "Completed", "Cancelled"])))
    return rows


def _status(r):
    product, nxt, term = r[0], r[3], r[4]
    limit = AS_OF - timedelta(days=90)
    if product == "domain":
        return "Inactive" if nxt is None else ("Active" if nxt >= limit else "Inactive")
    if nxt is None:
        return "Active"
    if term is not None:
        return "Inactive"
    return "Active" if nxt >= limit else "Inactive"


def _brute(rows):
    """One pass per customer, written like the reference's transforms."""
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[2]), []).append(r)
    out = {}
    for key, rs in groups.items():
        dates = [r[3] for r in rs if r[3] is not None]
        mn = min(dates) if dates else None
        pay = [r[5] if (r[3] is not None and r[3] == mn) else r[6] for r in rs]
        st = [_status(r) for r in rs]
        m_act = [p > 0 and s == "Active" for p, s in zip(pay, st)]
        m_fut = [r[3] is not None and r[3] > AS_OF and s == "Active" for r, s in zip(rs, st)]
        ok = {"domain": ("Active",)}.get(key[0], ("Active", "Completed"))
        m_rev = [p > 0 and r[8] in ok for p, r in zip(pay, rs)]
        out[key] = ("Active" if "Active" in st else "Inactive",
                    sum(m_act) or None, float(max(pay)),
                    float(sum(p for p, m in zip(pay, m_fut) if m)) if any(m_fut) else None,
                    float(sum(p for p, m in zip(pay, m_rev) if m)) if any(m_rev) else None)
    return out


def test_rollup_matches_brute_force(spark):
    rows = _random_rows()
    df = services.with_final_status(spark.createDataFrame(rows, SCHEMA), AS_OF)
    got = {(r.product, r.userid): (r.final_status, r.active_services, r.payment, r.future_revenue, r.revenue)
           for r in services.rollup_output(services.service_stats(df, AS_OF)).collect()}
    assert got == _brute(rows)


@pytest.mark.parametrize("skew", [{}, {"shares": 7}])
def test_row_level_masks_match_brute_force(spark, skew):
    rows = _random_rows(seed=11)
    df = services.with_final_status(spark.createDataFrame(rows, SCHEMA), AS_OF)
    got = services.masked_values(services.services_with_stats(df, AS_OF, **skew), AS_OF)
    agg = _brute(rows)
    n = 0
    for r in got.collect():
        st, act, _, fut, rev = agg[(r.product, r.userid)]
        if r.active_services_row is not None:
            assert r.active_services_row == act
        if r.future_revenue_row is not None:
            assert float(r.future_revenue_row) == fut
        if r.revenue_row is not None:
            assert float(r.revenue_row) == rev
        n += 1
    assert n == len(rows)


def test_ties_at_min_date_all_pay_first(spark):
    d = datetime(2001, 7, 1)
    rows = [("domain", 1, 5, d, None, Decimal("10.00"), Decimal("1.0000"), None, "Active"),
            ("domain", 2, 5, d, None, Decimal("20.00"), Decimal("2.0000"), None, "Active"),
            ("domain", 3, 5, d + timedelta(days=1), None, Decimal("30.00"), Decimal("3.0000"), None, "Active"),
            ("domain", 4, 5, None, None, Decimal("40.00"), Decimal("4.0000"), None, "Active")]
    df = services.with_final_status(spark.createDataFrame(rows, SCHEMA), AS_OF)
    pay = {r.id: float(r.payment) for r in services.with_payment(df).collect()}
    assert pay == {1: 10.0, 2: 20.0, 3: 3.0, 4: 4.0}


def test_future_revenue_null_payment_counts_zero(spark):
    d = datetime(2001, 7, 1)
    rows = [("hosting", 1, 5, d, None, None, None, "Monthly", "Active")]
    df = services.with_final_status(spark.createDataFrame(rows, SCHEMA), AS_OF)
    r = services.service_stats(df, AS_OF).first()
    assert r.future_revenue == 0 and r.revenue is None and r.active_services is None


def test_user_cost_keeps_active_row_and_sums(spark):
    rows = _random_rows(seed=3, n=200)
    df = services.with_cost_columns(services.with_final_status(spark.createDataFrame(rows, SCHEMA), AS_OF), AS_OF)
    costs = {}
    for r in df.collect():
        costs.setdefault((r.product, r.userid), []).append(r)
    got = {(r.product, r.userid): r for r in services.user_cost(df).collect()}
    assert set(got) == set(costs)
    for key, rs in costs.items():
        g = got[key]
        assert g.final_status == ("Active" if any(x.final_status == "Active" for x in rs) else "Inactive")
        total = sum(c.free_service_cost for c in rs if c.free_service_cost is not None)
        assert math.isclose(g.total_free_service_cost, total, abs_tol=1e-5)
        kept = sorted(rs, key=lambda x: (x.final_status, x.nextinvoicedate is None,
                                         x.nextinvoicedate or datetime.max))[0]
        assert g.lagging_cycles == kept.lagging_cycles


def test_unknown_cycle_cost_is_null_and_skipped(spark):
    d = AS_OF.replace(hour=0) + timedelta(days=61)
    rows = [("hosting", 1, 5, d, None, Decimal("1.00"), Decimal("30.0000"), "One Time", "Active"),
            ("hosting", 2, 5, d, None, Decimal("1.00"), Decimal("30.0000"), "Monthly", "Active")]
    df = services.with_cost_columns(services.with_final_status(spark.createDataFrame(rows, SCHEMA), AS_OF), AS_OF)
    by_id = {r.id: r for r in df.collect()}
    assert by_id[1].free_service_cost is None and by_id[1].cycle_rate is None
    assert by_id[2].lagging_cycles == 2.0 and by_id[2].cycle_rate == 1.0 and by_id[2].free_service_cost == 2.0
    assert services.user_cost(df).first().total_free_service_cost == 2.0


def test_hot_key_is_spread_over_salts(spark):
    """A key with a third of the rows is split over its share of salts, a null
    key is a key, and the joined result is the plain null-safe left join."""
    from revlens.operators.skew import KeySalting, attach_key_stats
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 WHEN id = 1 THEN NULL ELSE id END AS k", "id")
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"), F.min("id").alias("first_id"))
    joined = attach_key_stats(rows, stats, ["k"], ["id"], shares=30)
    want = sorted(((None, 1, 1) if i == 1 else (0, i, 0) if i % 3 == 0 else (i, i, i) for i in range(3000)), key=repr)
    assert sorted(map(tuple, joined.select("k", "id", "first_id").collect()), key=repr) == want
    ks = KeySalting(stats, ["k"], 30)
    assert [tuple(r) for r in ks.hot.collect()] == [(0, 10)]
    salts = ks.salt_rows(rows, ["id"]).groupBy("k").agg(F.countDistinct("_salt").alias("n"))
    assert {r.k: r.n for r in salts.where("k = 0").collect()} == {0: 10}
    assert salts.where("k != 0 AND n != 1").count() == 0
