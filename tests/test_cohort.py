"""Cohort table and forecast: year union with NULLs outside the range, first
year rates, lag defaults, a year without subscribers in the middle."""

from decimal import Decimal

from revlens.operators import cohort
from conftest import ts

SCHEMA = "id bigint, userid bigint, date timestamp_ntz, status string, total decimal(18,2)"


def test_annual_cohort_and_forecast(spark):
    rows = [
        (1, 1, ts("1995-03-01"), "Paid", Decimal("100.00")),
        (2, 1, ts("1997-03-01"), "Paid", Decimal("50.00")),
        (3, 2, ts("1995-05-01"), "Paid", Decimal("30.00")),
        (4, 3, ts("1997-01-01"), "Paid", Decimal("-5.00")),   # year sum <= 0: not a subscriber
        (5, 4, ts("1999-01-01"), "Paid", Decimal("10.00")),   # signup outside the range
        (6, 5, ts("1996-01-01"), "Unpaid", Decimal("10.00")),
    ]
    inv = spark.createDataFrame(rows, SCHEMA)
    coh = {r.year: r for r in cohort.annual_cohort(spark, inv, [1995, 1996, 1997]).collect()}
    assert sorted(coh) == [1995, 1996, 1997, 1999]
    assert (coh[1995].subscribers, coh[1995].additions, coh[1995].disengagement, coh[1995].revenue) == (2, 2, 1, 130.0)
    assert coh[1995].arpu == 65.0
    assert (coh[1996].subscribers, coh[1996].additions, coh[1996].revenue, coh[1996].arpu) == (0, None, 0.0, None)
    assert (coh[1997].subscribers, coh[1997].additions, coh[1997].disengagement) == (1, 1, 2)
    assert (coh[1999].subscribers, coh[1999].additions, coh[1999].revenue) == (None, 1, None)

    fc = {r.year: r for r in cohort.cohort_forecast(cohort.annual_cohort(spark, inv, [1995, 1996, 1997])).collect()}
    assert fc[1995].growth_rate is None and fc[1995].forecast_subscribers == 0.0
    assert fc[1995].variance == -130.0 and fc[1995].var_rate == -100.0
    assert fc[1996].growth_rate is None and fc[1996].churn_rate is None      # additions NULL / 2
    assert fc[1996].forecast_subscribers is None                              # previous rates NULL
    lag = {r.year: r.prev_subscribers for r in cohort.lagged_subscribers(
        cohort.annual_cohort(spark, inv, [1995, 1996, 1997])).collect()}
    assert lag == {1995: 0, 1996: 2, 1997: 0, 1999: 1}


def test_user_year_pivot(spark):
    rows = [(1, 1, ts("1995-03-01"), "Paid", Decimal("100.00")), (2, 1, ts("1995-04-01"), "Paid", None),
            (3, 1, ts("1996-03-01"), "Paid", Decimal("1.00")), (4, 2, ts("1996-03-01"), "Cancelled", Decimal("1.00"))]
    piv = cohort.user_year_pivot(spark.createDataFrame(rows, SCHEMA), [1995, 1996]).collect()
    assert [tuple(r) for r in piv] == [(1, 100.0, 1.0, "1995", "1996")]
