"""Finance unpivots: NULL months excluded, filters before the unpivot,
absolute values, and the NULL account dropped by the inequality."""

from decimal import Decimal

from revlens.operators import finance
from revlens.sources.feeds import FINANCE_MONTHS

COLS = "Scenario string, business_unit string, Account string, Year int, " + \
    ", ".join(f"{m} decimal(18,2)" for m in FINANCE_MONTHS)


def _row(scn, unit, acct, year, first):
    vals = [Decimal(first)] + [None] * 10 + [Decimal("-2.00")]
    return (scn, unit, acct, year, *vals)


def test_finance_queries(spark):
    fin = spark.createDataFrame([
        _row("Actuals", "Software", "Sales", 2023, "10.00"),
        _row("Budget", "Software", "Sales", 2023, "7.00"),
        _row("Actuals", "Hardware", "Sales", 2022, "1.00"),
        _row("Actuals", "Software", "COGS", 2023, "-3.00"),
        _row("Actuals", "Software", None, 2023, "-4.00"),
    ], COLS)
    monthly = sorted(tuple(r) for r in finance.monthly_long(fin, 2023, "Sales", "Software").collect())
    assert monthly == [("Actuals", "Dec", -2.0), ("Actuals", "Jan", 10.0), ("Budget", "Dec", -2.0), ("Budget", "Jan", 7.0)]
    by_unit = sorted(tuple(r) for r in finance.sales_by_unit(fin, 2023, "Sales").collect())
    assert by_unit == [("Actuals", "Software", 8.0), ("Budget", "Software", 5.0)]
    yearly = sorted(tuple(r) for r in finance.yearly_by_account(fin, "Actuals", "Sales").collect())
    assert yearly == [("COGS", 2023, 5.0)]
