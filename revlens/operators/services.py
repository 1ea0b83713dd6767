"""Service operators: status (E1/E2), payment (E4/W1), the per-customer
rollup A1 (W2–W5), free-service cost (E5–E9) and the per-customer cost D1.

The three service feeds are one table with a ``product`` column, so every
operator runs once for all products, keyed by ``(product, userid)``.

Design of the rollup (A1).  The payment of a row depends on the customer's
earliest next date.  No row needs to learn that date: the rows are aggregated
per ``(product, userid, next date)`` with both payments side by side, and on that
table the customer's earliest date picks between them.  The service rows are
read and shuffled once, as partial aggregates, so a customer with a third of
all rows costs one row per date and map task.  Row-level outputs look the
rollup up through ``operators.skew``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import expr as E
from revlens.operators.skew import ROWS_COL, attach_key_stats

SERVICE_KEYS = ["product", "userid"]
PRODUCTS = ["domain", "hosting", "hostingaddons"]
# Raw statuses that count as revenue: domains only Active, others also Completed.
REVENUE_STATUSES = {"domain": ["Active"], "hosting": ["Active", "Completed"],
                    "hostingaddons": ["Active", "Completed"]}
_EPOCH = datetime(1970, 1, 1)


def with_final_status(services: DataFrame, as_of: datetime) -> DataFrame:
    """E1 for domains, E2 for hosting and add-ons."""
    nxt, term = F.col("nextinvoicedate"), F.col("termination_date")
    return services.withColumn(
        "final_status",
        F.when(F.col("product") == "domain", E.status_domain(nxt, as_of))
        .otherwise(E.status_hosting(nxt, term, as_of)))


def _revenue_status_ok() -> Column:
    p, s = F.col("product"), F.col("status")
    expr = None
    for prod, statuses in REVENUE_STATUSES.items():
        cond = s.isin(*statuses)
        expr = F.when(p == prod, cond) if expr is None else expr.when(p == prod, cond)
    return F.coalesce(expr, F.lit(False))


def min_next_stats(services: DataFrame) -> DataFrame:
    """W1 per (product, userid): the earliest next date, with the row count
    the skew-safe join needs.  Partial aggregation map-side: a hot customer
    costs one row per map task."""
    return services.groupBy(*SERVICE_KEYS).agg(
        F.count(F.lit(1)).alias(ROWS_COL), F.min("nextinvoicedate").alias("min_next"))


def _paid(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "payment",
        E.payment(F.col("nextinvoicedate"), F.col("min_next"),
                  F.col("firstpaymentamount").cast("decimal(20,4)"),
                  F.col("recurringamount").cast("decimal(20,4)")))


def with_payment(services: DataFrame, **skew) -> DataFrame:
    """E4 per row: ``min_next`` of the customer attached through the
    skew-safe join, then the first/recurring choice."""
    stats = min_next_stats(services)
    return _paid(attach_key_stats(services, stats, SERVICE_KEYS, ["id"], **skew).drop(ROWS_COL))


def _masks(as_of: datetime, payment: str | Column = "payment") -> tuple[Column, Column, Column]:
    """W2 (active service), W3 (future revenue), W4/W5 (revenue) row masks."""
    active = F.col("final_status") == E.ACTIVE
    pay_pos = F.coalesce((F.col(payment) if isinstance(payment, str) else payment) > 0, F.lit(False))
    m_act = pay_pos & active
    m_fut = F.coalesce((F.col("nextinvoicedate") > E.ts_literal(as_of)) & active, F.lit(False))
    m_rev = pay_pos & _revenue_status_ok()
    return m_act, m_fut, m_rev


def rollup_rows(rows: DataFrame, as_of: datetime) -> DataFrame:
    """A1 over rows that carry ``payment``: one row per (product, userid)
    with any-Active status, W2 count (NULL when none), max payment, W3 sum
    (masked NULL payments count 0; NULL when no masked row) and W4/W5 sum.
    All aggregates are fixed-width, so the aggregate is hash-based with
    map-side partial aggregation."""
    m_act, m_fut, m_rev = _masks(as_of)
    pay = F.col("payment")
    out = rows.groupBy(*SERVICE_KEYS).agg(
        F.count(F.lit(1)).alias(ROWS_COL),
        F.max((F.col("final_status") == E.ACTIVE).cast("int")).alias("any_active"),
        F.nullif(F.count_if(m_act), F.lit(0)).alias("active_services"),
        F.max(pay).alias("payment"),
        F.sum(F.when(m_fut, F.coalesce(pay, F.lit(0).cast("decimal(20,4)")))).alias("future_revenue"),
        F.sum(F.when(m_rev, pay)).alias("revenue"),
    )
    return out.select(*SERVICE_KEYS, ROWS_COL, status_from_flag(F.col("any_active")),
                      "active_services", "payment", "future_revenue", "revenue")


def service_stats(services: DataFrame, as_of: datetime) -> DataFrame:
    """A1 for all products, from one pass over the rows: per customer and next
    date the aggregates of both payments, then per customer the first payment's
    on the earliest date and the recurring one's elsewhere (NULL dates too)."""
    aggs, zero = [], F.lit(0).cast("decimal(20,4)")
    for kind, amount in (("first", "firstpaymentamount"), ("rec", "recurringamount")):
        pay = F.col(amount).cast("decimal(20,4)")
        m_act, m_fut, m_rev = _masks(as_of, pay)
        aggs += [F.count_if(m_act).alias(f"act_{kind}"), F.max(pay).alias(f"max_{kind}"),
                 F.sum(F.when(m_fut, F.coalesce(pay, zero))).alias(f"fut_{kind}"),
                 F.sum(F.when(m_rev, pay)).alias(f"rev_{kind}")]
    by_date = services.groupBy(*SERVICE_KEYS, "nextinvoicedate").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("final_status") == E.ACTIVE).cast("int")).alias("act"), *aggs)
    earliest = F.min("nextinvoicedate").over(Window.partitionBy(*SERVICE_KEYS))
    by_date = by_date.withColumn("earliest", earliest)

    def chosen(name: str) -> Column:
        return E.payment(F.col("nextinvoicedate"), F.col("earliest"), F.col(f"{name}_first"), F.col(f"{name}_rec"))

    out = by_date.groupBy(*SERVICE_KEYS).agg(
        F.sum("n").alias(ROWS_COL), F.max("act").alias("any_active"), F.min("earliest").alias("min_next"),
        F.nullif(F.sum(chosen("act")), F.lit(0)).alias("active_services"), F.max(chosen("max")).alias("payment"),
        F.sum(chosen("fut")).alias("future_revenue"), F.sum(chosen("rev")).alias("revenue"))
    return out.select(*SERVICE_KEYS, ROWS_COL, "min_next", status_from_flag(F.col("any_active")),
                      "active_services", "payment", "future_revenue", "revenue")


def status_from_flag(any_active: Column) -> Column:
    """Active if any row of the group is Active, else Inactive.  (Aggregating
    an int flag instead of the text keeps the aggregate hash-based.)"""
    return F.when(any_active == 1, F.lit(E.ACTIVE)).otherwise(F.lit(E.INACTIVE)).alias("final_status")


def rollup_output(stats: DataFrame) -> DataFrame:
    """A1 as published: money as DOUBLE."""
    return stats.select(
        "product", "userid", "final_status",
        F.col("active_services").cast("bigint").alias("active_services"),
        F.col("payment").cast("double").alias("payment"),
        F.col("future_revenue").cast("double").alias("future_revenue"),
        F.col("revenue").cast("double").alias("revenue"))


def services_with_stats(services: DataFrame, as_of: datetime, **skew) -> DataFrame:
    """Row-level services with payment and their customer's rollup attached
    (the group-broadcast columns W1–W5), by one skew-safe lookup."""
    stats = service_stats(services, as_of).select(
        *SERVICE_KEYS, ROWS_COL, "min_next", "active_services", "future_revenue", "revenue")
    return _paid(attach_key_stats(services, stats, SERVICE_KEYS, ["id"], **skew).drop(ROWS_COL))


def masked_values(rows: DataFrame, as_of: datetime) -> DataFrame:
    """W2–W5 row values: the customer aggregate on rows inside each mask,
    NULL elsewhere (pandas assigns a filtered transform back by index)."""
    m_act, m_fut, m_rev = _masks(as_of)
    return rows.select(
        "*",
        F.when(m_act, F.col("active_services")).alias("active_services_row"),
        F.when(m_fut, F.col("future_revenue")).alias("future_revenue_row"),
        F.when(m_rev, F.col("revenue")).alias("revenue_row"),
    )


def with_cost_columns(services: DataFrame, as_of: datetime) -> DataFrame:
    """E5–E9 per row: lagging_cycles, free flag, cycle_rate, free_service_cost."""
    lag = E.lagging_cycles(F.col("final_status"), F.col("nextinvoicedate"), as_of)
    out = services.withColumn("lagging_cycles", lag)
    out = out.withColumn("free_flag", E.free_flag(F.col("lagging_cycles")))
    out = out.withColumn("cycle_rate", E.cycle_rate(F.col("product"), F.col("free_flag"),
                                                    F.col("recurringamount"), F.col("billingcycle")))
    return out.withColumn("free_service_cost",
                          E.free_cost(F.col("free_flag"), F.col("lagging_cycles"), F.col("cycle_rate")))


def user_cost(costed: DataFrame) -> DataFrame:
    """D1 + W6: one row per (product, userid): Active before Inactive, the
    lagging cycles of that row (earliest next date first, NULL dates last —
    rows that still tie have equal values), and the total free-service cost
    (all-NULL -> 0)."""
    active = F.col("final_status") == E.ACTIVE
    # One BIGINT ordering key: Active first, then the next date (NULL last).
    # A single fixed-width key keeps min_by inside the hash aggregate.
    micros = F.timestamp_diff("MICROSECOND", E.ts_literal(_EPOCH), F.col("nextinvoicedate"))
    order = (F.when(active, F.lit(0)).otherwise(F.lit(1)).cast("bigint") * F.lit(1 << 62)
             + F.coalesce(micros, F.lit(1 << 61)))
    out = costed.groupBy(*SERVICE_KEYS).agg(
        F.max(active.cast("int")).alias("any_active"),
        F.coalesce(E.exact_sum(F.col("free_service_cost")), F.lit(0.0)).alias("total_free_service_cost"),
        F.min_by("lagging_cycles", order).alias("lagging_cycles"),
    )
    return out.select(*SERVICE_KEYS, status_from_flag(F.col("any_active")),
                      "total_free_service_cost", "lagging_cycles")
