"""Keep-first invoice rewrites (D2/D3), tickets and the profit join,
including the order-dependent fallback and a ticket-only customer."""

from decimal import Decimal

from revlens.operators import invoices
from conftest import AS_OF, ts

SCHEMA = "id bigint, userid bigint, date timestamp_ntz, status string, total decimal(18,2)"


def _inv(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_revenue_by_user_first_row_fallback(spark):
    rows = [
        # customer 1: first row Unpaid, only zero-valued paid -> revenue NULL
        (1, 1, ts("2000-01-01"), "Unpaid", Decimal("5.00")), (2, 1, ts("2000-02-01"), "Paid", Decimal("0.00")),
        # customer 2: first row Paid with zero -> revenue 0
        (3, 2, ts("2000-01-01"), "Paid", Decimal("0.00")), (4, 2, ts("2000-03-01"), "Unpaid", Decimal("9.00")),
        # customer 3: positive paid invoices, NULL total counts 0 in the sum
        (5, 3, ts("2000-01-01"), "Paid", Decimal("10.00")), (6, 3, ts("2000-02-01"), "Paid", None),
        (7, 3, ts("2000-03-01"), "Paid", Decimal("2.50")),
    ]
    got = {r.userid: (r.paid_invoices, r.revenue) for r in invoices.invoice_revenue_by_user(_inv(spark, rows)).collect()}
    assert got == {1: (None, None), 2: (None, 0.0), 3: (2, 12.5)}


def test_revenue_12m_by_user(spark):
    rows = [
        (1, 1, ts("2000-06-15"), "Paid", Decimal("100.00")),   # exactly 365 days back at midnight: outside
        (2, 1, ts("2001-06-14"), "Paid", Decimal("7.00")),     # day before as_of: inside
        (3, 1, ts("2001-06-15"), "Paid", Decimal("9.00")),     # day of as_of: outside
        (4, 2, ts("2001-01-01"), "Unpaid", Decimal("5.00")),   # in window but unpaid
        (5, 2, ts("1999-01-01"), "Paid", Decimal("5.00")),
    ]
    got = {r.userid: (r.revenue_12m, r.in_12m) for r in invoices.invoice_12m_by_user(_inv(spark, rows), AS_OF).collect()}
    # customer 2 keeps its first row in (date, id) order: the 1999 invoice, outside the window
    assert got == {1: (7.0, True), 2: (None, False)}
    rows_level = {r.id: r.revenue_12m for r in invoices.revenue_12m_rows(_inv(spark, rows), AS_OF).collect()}
    assert rows_level == {1: None, 2: 7.0, 3: None, 4: None, 5: None}


def test_profit_full_outer_with_ticket_only_customer(spark):
    inv = _inv(spark, [(1, 1, ts("2000-01-01"), "Paid", Decimal("100.00"))])
    tix = spark.createDataFrame([(10, 1), (11, 1), (12, 9)], "id bigint, userid bigint")
    got = {r.userid: tuple(r)[1:] for r in invoices.profit_by_customer(inv, tix, 75.0).collect()}
    assert got == {1: (1, 100.0, 2, 150.0, -50.0), 9: (0, 0.0, 1, 75.0, -75.0)}


def test_fractional_ids_keep_input_order(spark):
    """Text feeds coerce ids to DOUBLE; the first-row fallback still orders by (date, id)."""
    rows = [(1.5, 1.0, ts("2000-01-01"), "Paid", Decimal("0.00")),
            (1.4, 1.0, ts("2000-01-01"), "Unpaid", Decimal("3.00"))]
    df = spark.createDataFrame(rows, "id double, userid double, date timestamp_ntz, status string, total decimal(18,2)")
    got = invoices.invoice_revenue_by_user(df).collect()
    assert [(r.paid_invoices, r.revenue) for r in got] == [(None, None)]   # first row (id 1.4) is unpaid
