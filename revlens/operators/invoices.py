"""Invoice and ticket operators: trailing-year flag (E10), W7–W10, the
per-customer keep-first rewrites D2/D3/D4, and the profit table J7.

The keep-first operators of the reference (sort, then drop duplicates) are
re-expressed as one conditional aggregate per customer; where the reference
falls back to "the first input row", the feed's row order (its place in the CSV
files, or ``(date, id)`` for tables, which have none) is picked with ``min_by``.  All are plain ``groupBy`` with
map-side partial aggregation, so a hot customer does not concentrate work.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from revlens.functions import expr as E
from revlens.operators.skew import ROWS_COL, attach_key_stats
from revlens.sources.csv_files import ORDER


def _zero():
    return F.lit(0).cast("decimal(18,2)")


def _money(c, exact: bool):
    return c if exact else c.cast("double")


def row_order(df: DataFrame):
    """Explicit input order of the invoice feed, ``(date NULLS FIRST, id)``, as
    one DECIMAL(38,0) key, so that ``min_by`` stays in the hash aggregate:
    date micros * 10^20 + (id + 2^63) for integral ids; for the ids of a text
    feed (``KEY_TYPE``, whose dates are whole days) days * 10^29 + id * 10^8.
    Any other id type uses the struct ordering.  A feed whose reader gives the
    place of a row in its files is in that order."""
    if ORDER in df.columns:
        return F.col(ORDER)
    id_type = df.schema["id"].dataType
    if id_type == DecimalType(28, 8):
        days = F.coalesce(F.unix_date(F.col("date").cast("date")), F.lit(-(10 ** 8))).cast("decimal(38,0)")
        units = (F.col("id") * F.lit(10 ** 8).cast("decimal(9,0)")).cast("decimal(38,0)")
        return (days * F.lit(str(10 ** 29)).cast("decimal(38,0)") + units).cast("decimal(38,0)")
    if not isinstance(id_type, IntegralType):
        return F.struct(F.col("date"), F.col("id"))
    micros = F.timestamp_diff("MICROSECOND", E.ts_literal(datetime(1970, 1, 1)), F.col("date"))
    micros = F.coalesce(micros, F.lit(-(10 ** 17))).cast("decimal(38,0)")
    shifted = F.col("id").cast("decimal(38,0)") + F.lit(str(2 ** 63)).cast("decimal(38,0)")
    return (micros * F.lit(str(10 ** 20)).cast("decimal(38,0)") + shifted).cast("decimal(38,0)")


def with_trailing_flag(invoices: DataFrame, as_of: datetime) -> DataFrame:
    return invoices.withColumn("in_12m", E.in_trailing_year(F.col("date"), as_of))


def _masks():
    paid = F.coalesce(F.col("status") == E.PAID, F.lit(False))
    m12 = F.col("in_12m") & paid
    paid_pos = paid & F.coalesce(F.col("total") > 0, F.lit(False))
    return paid, m12, paid_pos


def revenue_12m_rows(invoices: DataFrame, as_of: datetime, **skew) -> DataFrame:
    """W7 row values: trailing-year paid revenue of the customer on rows
    inside the mask (NULL totals count 0), NULL elsewhere."""
    rows = with_trailing_flag(invoices, as_of)
    _, m12, _ = _masks()
    stats = rows.groupBy("userid").agg(
        F.count(F.lit(1)).alias(ROWS_COL),
        F.sum(F.when(m12, F.coalesce(F.col("total"), _zero()))).alias("revenue_12m_user"))
    joined = attach_key_stats(rows, stats, ["userid"], ["id"], **skew)
    _, m12, _ = _masks()
    return joined.select("id", "userid",
                         F.when(m12, F.col("revenue_12m_user")).cast("double").alias("revenue_12m"))


def invoice_12m_by_user(invoices: DataFrame, as_of: datetime, exact: bool = False) -> DataFrame:
    """One row per customer — trailing-year paid revenue (NULL when the
    customer has no such invoice) and the flag of the kept row.  ``exact``
    keeps the money as DECIMAL for further exact sums."""
    rows = with_trailing_flag(invoices, as_of)
    _, m12, _ = _masks()
    n12 = F.count_if(m12)
    return rows.groupBy("userid").agg(
        _money(F.when(n12 > 0, F.coalesce(F.sum(F.when(m12, F.col("total"))), _zero())), exact)
        .alias("revenue_12m"),
        F.when(n12 > 0, F.lit(True)).otherwise(F.min_by("in_12m", row_order(rows))).alias("in_12m"))


def invoice_revenue_by_user(invoices: DataFrame, exact: bool = False) -> DataFrame:
    """D3: count of positive paid invoices (NULL when none) and paid revenue.
    A customer without a positive paid invoice keeps the first input row, whose
    revenue is NULL unless that row is paid (quirk Q10)."""
    paid, _, paid_pos = _masks()
    npos = F.count_if(paid_pos)
    keep = (npos > 0) | F.coalesce(F.min_by(paid.cast("int"), row_order(invoices)) == 1, F.lit(False))
    return invoices.groupBy("userid").agg(
        F.nullif(npos, F.lit(0)).alias("paid_invoices"),
        _money(F.when(keep, F.coalesce(F.sum(F.when(paid, F.col("total"))), _zero())), exact)
        .alias("revenue"))


def tickets_by_user(tickets: DataFrame) -> DataFrame:
    """W10 + D4: tickets per customer."""
    return tickets.groupBy("userid").agg(F.count(F.lit(1)).alias("tickets"))


def profit_by_customer(invoices: DataFrame, tickets: DataFrame,
                       cost_per_ticket: float = 75.0, exact: bool = False) -> DataFrame:
    """J7 + E12 from the raw rows (see ``profit``)."""
    return profit(invoice_revenue_by_user(invoices, exact), tickets_by_user(tickets), cost_per_ticket, exact)


def profit(revenue: DataFrame, tickets: DataFrame, cost_per_ticket: float = 75.0, exact: bool = False) -> DataFrame:
    """J7 + E12: invoice revenue ⟗ tickets (one row per customer each), missing
    as 0, cost and profit.

    Both sides are already hash-partitioned by ``userid``, by their own
    aggregates or in buckets, so the full outer join adds no exchange."""
    j = revenue.join(tickets, "userid", "full_outer")
    tickets_c = F.coalesce(F.col("tickets"), F.lit(0)).cast("bigint")
    revenue_c = F.coalesce(F.col("revenue"), _zero() if exact else F.lit(0.0))
    cost = tickets_c.cast("double") * F.lit(float(cost_per_ticket))
    return j.select(
        "userid",
        F.coalesce(F.col("paid_invoices"), F.lit(0)).cast("bigint").alias("paid_invoices"),
        revenue_c.alias("revenue"),
        tickets_c.alias("tickets"),
        cost.alias("cost"),
        (revenue_c.cast("double") - cost).alias("profit"))
