"""Finance-sheet operators R1–R3 with filters F5–F7 and the aggregate A12.

Filters are applied to the wide table before the unpivot, so they push down
to the source; the unpivot (an ``Expand``) then only produces the twelve
month cells of matching rows, and the month NULLs are dropped the way an SQL
``UNPIVOT`` drops them (``DataFrame.unpivot`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.sources.feeds import FINANCE_MONTHS


def unpivot_months(df: DataFrame, ids: list[str], value: str = "sales",
                   name: str = "month") -> DataFrame:
    """Twelve month columns -> (month, value), NULL cells excluded."""
    return (df.unpivot(ids, FINANCE_MONTHS, name, value)
            .where(F.col(value).isNotNull()))


def monthly_long(fin: DataFrame, year: int, account: str, unit: str) -> DataFrame:
    """R1 (F5+F6): month cells of one year, account and business unit."""
    f = fin.where((F.col("Year") == year) & (F.col("Account") == account)
                  & (F.col("business_unit") == unit)).select("Scenario", *FINANCE_MONTHS)
    return unpivot_months(f, ["Scenario"]).select(
        F.col("Scenario").alias("scenario"), "month", F.col("sales").cast("double").alias("sales"))


def sales_by_unit(fin: DataFrame, year: int, account: str) -> DataFrame:
    """R2 + A12 (F5): month cells of one year and account, summed per
    scenario and business unit."""
    f = fin.where((F.col("Year") == year) & (F.col("Account") == account)) \
        .select("Scenario", "business_unit", *FINANCE_MONTHS)
    return (unpivot_months(f, ["Scenario", "business_unit"])
            .groupBy("Scenario", "business_unit")
            .agg(F.sum("sales").cast("double").alias("sales"))
            .select(F.col("Scenario").alias("scenario"), "business_unit", "sales"))


def yearly_by_account(fin: DataFrame, scenario: str, excluded_account: str) -> DataFrame:
    """R3 + A12 (F7): absolute month cells of one scenario, all accounts but
    one (a NULL account is dropped by the inequality), summed per account
    and fiscal year.  The unpivot name column is ``month`` so it cannot
    clash with ``Year``."""
    f = fin.where((F.col("Scenario") == scenario) & (F.col("Account") != excluded_account)) \
        .select("Account", "Year", *[F.abs(F.col(m)).alias(m) for m in FINANCE_MONTHS])
    return (unpivot_months(f, ["Account", "Year"])
            .groupBy("Account", "Year")
            .agg(F.sum("sales").cast("double").alias("sales"))
            .select(F.col("Account").alias("account"), F.col("Year").alias("year"), "sales"))
