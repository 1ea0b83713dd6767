"""Customer-level operators: product unions U1/U2, the outer-join summaries
J1–J6 with their row sums E11, totals A2, chart data A3, KPIs A10/A11/A13,
acquisition cost E16, money text E17 and the metric table R5.

Every input here is already one row per (product, customer) or per customer.
The three products are one table, so "outer-join the three product tables"
is a single ``groupBy(userid)`` with one conditional aggregate per product
column; the invoice side is then full-outer-joined on ``userid`` — both sides
are hash-partitioned by ``userid`` by their own aggregates, so that join adds
no exchange.  Global KPIs are one union feeding one global aggregate
(partial aggregation per partition; no cross join of one-row frames).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import expr as E

# Output suffix per product (the reference's merge suffixes).
SUFFIX = {"hostingaddons": "addon", "hosting": "hosting", "domain": "domain"}
_MICRO = 1_000_000.0


def _micro(x: Column) -> Column:
    """A cost double as an exact count of micro-units (see expr.exact_sum)."""
    return F.rint(x * F.lit(_MICRO))


def product_costs_long(user_costs: DataFrame) -> DataFrame:
    """The three per-product cost tables stacked (already one table)."""
    return user_costs.select("product", "userid", "final_status", "total_free_service_cost",
                             "lagging_cycles")


def product_revenue_long(stats: DataFrame) -> DataFrame:
    """The three product rollups stacked, missing numbers as 0 (money
    kept as exact decimals here; callers cast)."""
    return stats.select(
        "product", "userid", "final_status",
        F.coalesce(F.col("active_services"), F.lit(0)).cast("bigint").alias("active_services"),
        F.coalesce(F.col("payment"), F.lit(0)).cast("decimal(20,4)").alias("payment"),
        F.coalesce(F.col("future_revenue"), F.lit(0)).cast("decimal(30,4)").alias("future_revenue"),
        F.coalesce(F.col("revenue"), F.lit(0)).cast("decimal(30,4)").alias("revenue"))


def _per_product(col: str, product: str) -> Column:
    return F.max(F.when(F.col("product") == product, F.col(col)))


def customer_free_cost(user_costs: DataFrame, invoice_12m: DataFrame) -> DataFrame:
    """J1–J3 + E11: cost per product side by side, the trailing-year revenue,
    and the all-product free cost (missing as 0), one row per customer."""
    flagged = user_costs.withColumn("_act", (F.col("final_status") == E.ACTIVE).cast("int"))
    wide = flagged.groupBy("userid").agg(*[
        agg.alias(f"{name}_{SUFFIX[p]}")
        for p in ["hostingaddons", "hosting", "domain"]
        for name, agg in [("_act", _per_product("_act", p)),
                          ("total_free_service_cost", _per_product("total_free_service_cost", p))]])
    wide = wide.select("userid", *[
        F.when(F.col(f"_act_{SUFFIX[p]}") == 1, F.lit(E.ACTIVE))
        .when(F.col(f"_act_{SUFFIX[p]}") == 0, F.lit(E.INACTIVE)).alias(f"final_status_{SUFFIX[p]}")
        for p in ["hostingaddons", "hosting", "domain"]],
        *[f"total_free_service_cost_{SUFFIX[p]}" for p in ["hostingaddons", "hosting", "domain"]])
    j = wide.join(invoice_12m, "userid", "full_outer")
    costs = [f"total_free_service_cost_{SUFFIX[p]}" for p in ["hostingaddons", "hosting", "domain"]]
    micro = sum((F.coalesce(_micro(F.col(c)), F.lit(0.0)) for c in costs), F.lit(0.0))
    return j.select(
        "userid",
        *[f"final_status_{SUFFIX[p]}" for p in ["hostingaddons", "hosting", "domain"]],
        *costs, "revenue_12m", "in_12m",
        (micro / F.lit(_MICRO)).alias("free_service_cost_all_products"))


def customer_revenue_summary(revenue_long: DataFrame, invoice_revenue: DataFrame) -> DataFrame:
    """J4–J6 + E11 (quirk Q1 kept): per customer the product service counts
    and revenues, invoice revenue and counts, and the two row sums.  The
    reference's name-substring sum adds the future revenue twice plus every
    revenue column; ``revenue_all_products_corrected`` is the product sum."""
    prods = ["hostingaddons", "hosting", "domain"]
    wide = revenue_long.groupBy("userid").agg(
        *[_per_product("active_services", p).alias(f"active_services_{SUFFIX[p]}") for p in prods],
        *[_per_product("revenue", p).alias(f"revenue_{SUFFIX[p]}") for p in prods],
        *[_per_product("future_revenue", p).alias(f"future_{SUFFIX[p]}") for p in prods])
    j = wide.join(invoice_revenue, "userid", "full_outer")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    future_all = z("future_addon") + z("future_hosting") + z("future_domain")
    product_rev = z("revenue_addon") + z("revenue_hosting") + z("revenue_domain")
    return j.select(
        "userid",
        *[z(f"active_services_{SUFFIX[p]}").cast("bigint").alias(f"active_services_{SUFFIX[p]}") for p in prods],
        *[z(f"revenue_{SUFFIX[p]}").cast("double").alias(f"revenue_{SUFFIX[p]}") for p in prods],
        z("revenue").cast("double").alias("invoice_revenue"),
        z("paid_invoices").cast("bigint").alias("paid_invoices"),
        future_all.cast("double").alias("future_revenue_all_products"),
        (future_all * 2 + product_rev + z("revenue")).cast("double").alias("revenue_all_products"),
        product_rev.cast("double").alias("revenue_all_products_corrected"))


def customer_totals(revenue_long: DataFrame) -> DataFrame:
    """A2: per customer, sums over products."""
    return revenue_long.groupBy("userid").agg(
        F.sum("active_services").cast("bigint").alias("active_services"),
        F.sum("payment").cast("double").alias("payment"),
        F.sum("future_revenue").cast("double").alias("future_revenue"),
        F.sum("revenue").cast("double").alias("revenue"))


def highest_revenue_per_customer(revenue_long: DataFrame) -> DataFrame:
    """The highest product revenue of a customer and its product (first
    product in domain, hosting, add-on order on ties).  Missing revenues are
    skipped; a customer without any has NULL for both."""
    rank = F.when(F.col("product") == "domain", 0).when(F.col("product") == "hosting", 1).otherwise(2)
    # Revenue has 4 decimals, so revenue * 10^5 + (2 - rank) orders by revenue first and
    # then by product order, as one fixed-width key (keeps max_by hash-based).
    key = F.col("revenue").cast("decimal(30,4)") * F.lit(100000).cast("decimal(6,0)") + (F.lit(2) - rank)
    best = revenue_long.groupBy("userid").agg(
        F.max("revenue").cast("double").alias("highest_revenue"),
        F.max_by(rank, key).alias("_rank"))
    return best.select("userid", "highest_revenue",
                       F.when(F.col("_rank") == 0, "domain").when(F.col("_rank") == 1, "hosting")
                       .when(F.col("_rank") == 2, "hostingaddons").alias("product"))


def revenue_by_product_status(revenue_long: DataFrame) -> DataFrame:
    """A3: revenue per product and status."""
    return revenue_long.groupBy("product", "final_status").agg(
        F.sum("revenue").cast("double").alias("revenue"))


def active_clients(revenue_long: DataFrame) -> DataFrame:
    """The reference counts every customer of any service feed (Q3);
    the corrected count keeps customers with an active service."""
    per_user = revenue_long.groupBy("userid").agg(F.sum("active_services").alias("n"))
    return per_user.agg(F.count(F.lit(1)).alias("active_clients"),
                        F.count_if(F.col("n") > 0).alias("active_clients_corrected"))


def annual_kpis(invoice_12m_exact: DataFrame, costed: DataFrame) -> DataFrame:
    """The two annual KPIs of A10: trailing-year revenue and free-service
    cost, from one union and one global aggregate."""
    dec = "decimal(38,4)"
    u = (invoice_12m_exact.select(F.col("revenue_12m").cast(dec).alias("r12"), F.lit(None).cast(dec).alias("fc"))
         .unionByName(costed.select(F.lit(None).cast(dec).alias("r12"),
                                    _micro(F.col("free_service_cost")).cast(dec).alias("fc"))))
    agg = u.agg(F.sum("r12").alias("r12"), F.sum("fc").alias("fc"))
    return agg.select(
        F.coalesce(F.col("r12").cast("double"), F.lit(0.0)).alias("annual_revenue"),
        (F.coalesce(F.col("fc").cast("double"), F.lit(0.0)) / F.lit(_MICRO)).alias("free_service_cost"))


def kpis(invoice_12m_exact: DataFrame, costed: DataFrame, profit_exact: DataFrame,
         cost_per_ticket: float) -> DataFrame:
    """A10: annual revenue, free-service cost, revenue earned (rounded to a
    whole unit, half-even) and profit; two one-row tables, stacked and folded."""
    earned = profit_exact.agg(F.sum(F.col("revenue").cast("decimal(38,4)")).alias("rev"),
                              F.sum(F.col("tickets").cast("decimal(38,4)")).alias("tix"))
    rev = F.coalesce(F.col("rev").cast("double"), F.lit(0.0))
    earned = earned.select(
        E.round_half_even(rev, 0).alias("revenue_earned"),
        (rev - F.coalesce(F.col("tix").cast("double"), F.lit(0.0)) * F.lit(float(cost_per_ticket))).alias("profit"))
    names = ["annual_revenue", "free_service_cost", "revenue_earned", "profit"]
    both = annual_kpis(invoice_12m_exact, costed).unionByName(earned, allowMissingColumns=True)
    return both.agg(*[F.max(n).alias(n) for n in names])


def kpi_text(kpi: DataFrame, clients: DataFrame) -> DataFrame:
    """The three KPI tiles as text.  ``clients`` and ``kpi`` are one row
    each; they are stacked and folded, not cross-joined."""
    u = (kpi.select(F.lit(None).cast("bigint").alias("n"), "revenue_earned", "profit")
         .unionByName(clients.select(F.col("active_clients").alias("n"),
                                     F.lit(None).cast("double").alias("revenue_earned"),
                                     F.lit(None).cast("double").alias("profit"))))
    one = u.agg(F.max("n").alias("n"), F.max("revenue_earned").alias("r"), F.max("profit").alias("p"))
    return one.select(F.col("n").cast("string").alias("active_clients"),
                      E.money_text(F.col("r")).alias("revenue_earned"),
                      E.money_text(F.col("p")).alias("profit"))


def annual_metric_table(kpi: DataFrame) -> DataFrame:
    """The (metric, value) pair table of the revenue-vs-cost chart."""
    return kpi.select(F.expr(
        "stack(2, 'Annual Revenue', annual_revenue, 'Free Service Cost', free_service_cost) AS (metric, value)"))


def acquisition_cost(kpi: DataFrame, multiplier: float, operational_cost: float) -> DataFrame:
    """(annual revenue - free cost - operational cost) x multiplier, 2 places."""
    raw = (F.col("annual_revenue") - F.col("free_service_cost") - F.lit(float(operational_cost))) \
        * F.lit(float(multiplier))
    return (kpi.select("annual_revenue", "free_service_cost",
                       E.round_half_even(raw, 2).alias("acquisition_cost"))
            .withColumn("acquisition_text", E.money_text(F.col("acquisition_cost"))))
