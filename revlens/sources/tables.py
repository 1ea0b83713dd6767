"""The driver's parquet tables re-read as billing feeds.

Only the columns each feed needs are selected, so the parquet scans are
pruned; filters written on these views push down to the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.sources.feeds import FINANCE_MONTHS, table_path

# Fixed values of the table-to-feed mapping.
INVOICE_STATUS = {"F": "Paid", "O": "Unpaid", "P": "Cancelled"}
PRODUCT_BY_PART_MOD = {0: "domain", 1: "hosting", 2: "hostingaddons"}
BILLING_CYCLE_BY_LINE = {1: "Monthly", 2: "Quarterly", 3: "Semi-Annually", 4: "Annually",
                         5: "Biennially", 6: "Triennially", 7: "One Time"}
NO_NEXT_DATE_QUANTITY = 50
FINANCE_ACCOUNT = {"N": "Sales", "R": "COGS", "A": "Returns"}
FINANCE_SCENARIO = {"O": "Actuals", "F": "Budget"}
TICKET_EVENT_TYPE = "error"


def _case(c: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def invoice_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> invoice (id, userid, date, status, total)."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("userid"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("date"),
        _case(F.col("o_orderstatus"), INVOICE_STATUS).alias("status"),
        F.col("o_totalprice").try_cast("decimal(18,2)").alias("total"),
    )


def service_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ orders -> the three service feeds as one table tagged with
    ``product`` (domain / hosting / hostingaddons).

    The join is a plain equi-join: Spark sizes it (sort-merge at scale,
    broadcast only when the statistics prove a side small) and AQE splits a
    skewed order key.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    ship = F.col("l_shipdate").cast("timestamp_ntz")
    price = F.col("l_extendedprice").try_cast("decimal(18,2)")
    status = (F.when(F.col("l_linestatus") == "O", F.lit("Active"))
              .when(F.col("l_returnflag") == "N", F.lit("Completed"))
              .otherwise(F.lit("Cancelled")))
    return j.select(
        _case(F.pmod(F.col("l_partkey"), F.lit(3)), PRODUCT_BY_PART_MOD).alias("product"),
        F.col("l_orderkey").alias("id"),
        F.col("o_custkey").alias("userid"),
        F.when(F.col("l_quantity") != NO_NEXT_DATE_QUANTITY, ship).alias("nextinvoicedate"),
        F.when(F.col("l_returnflag") == "R", ship).alias("termination_date"),
        price.alias("firstpaymentamount"),
        (price * (F.lit(1).cast("decimal(18,2)") - F.col("l_discount").try_cast("decimal(18,2)")))
        .cast("decimal(18,4)").alias("recurringamount"),
        _case(F.col("l_linenumber"), BILLING_CYCLE_BY_LINE).alias("billingcycle"),
        status.alias("status"),
    )


def ticket_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events of type 'error' -> ticket (id, userid)."""
    e = read_table(spark, sf_dir, "events")
    return (e.where(F.col("event_type") == TICKET_EVENT_TYPE)
            .select(F.col("event_id").alias("id"), F.col("user_id").alias("userid")))


def _inverse(mapping: dict, values) -> list:
    return [k for k, v in mapping.items() if v in set(values)]


def finance_feed(spark: SparkSession, sf_dir: str, years=None, accounts=None,
                 scenarios=None, exclude_accounts=None) -> DataFrame:
    """lineitem ⋈ part -> the wide finance sheet (Scenario, business_unit,
    Account, Year, Jan..Dec); months hold exact decimal sums, negative for
    accounts other than Sales, NULL where a month has no line.

    Filters a query puts on Year / Account / Scenario can be given here: they
    are translated to predicates on the raw columns (a ship-date range, flag
    lists), which the parquet scan can use for row-group skipping; the
    derived-column filters Catalyst pushes on its own are evaluated only
    after the rows are read."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    if years is not None:
        cond = None
        for y in sorted(set(years)):
            c = (F.col("l_shipdate") >= F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz")) & \
                (F.col("l_shipdate") < F.lit(f"{y + 1}-01-01 00:00:00").cast("timestamp_ntz"))
            cond = c if cond is None else cond | c
        li = li.where(cond)
    if accounts is not None:
        li = li.where(F.col("l_returnflag").isin(_inverse(FINANCE_ACCOUNT, accounts)))
    if exclude_accounts is not None:
        keep = [a for a in FINANCE_ACCOUNT.values() if a not in set(exclude_accounts)]
        li = li.where(F.col("l_returnflag").isin(_inverse(FINANCE_ACCOUNT, keep)))
    if scenarios is not None:
        li = li.where(F.col("l_linestatus").isin(_inverse(FINANCE_SCENARIO, scenarios)))
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    price = F.col("l_extendedprice").try_cast("decimal(18,2)")
    signed = F.when(F.col("l_returnflag") == "N", price).otherwise(-price)
    month = F.month("l_shipdate")
    return (j.groupBy(
                _case(F.col("l_linestatus"), FINANCE_SCENARIO).alias("Scenario"),
                F.col("p_type").alias("business_unit"),
                _case(F.col("l_returnflag"), FINANCE_ACCOUNT).alias("Account"),
                F.year("l_shipdate").alias("Year"))
            .agg(*[F.sum(F.when(month == i + 1, signed)).cast("decimal(28,2)").alias(m)
                   for i, m in enumerate(FINANCE_MONTHS)]))
