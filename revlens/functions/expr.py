"""Column expressions.  Every rule of the reference that was a
row-wise Python function is one Catalyst expression here, so it stays inside
whole-stage codegen; no Python UDF is involved anywhere.

``as_of`` is always a Python ``datetime`` (naive, wall-clock) and enters the
plan as a ``TIMESTAMP_NTZ`` literal, so it is constant-folded and independent
of the session time zone.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Status labels, the activity window and the trailing-year bounds.
ACTIVE = "Active"
INACTIVE = "Inactive"
COMPLETED = "Completed"
PAID = "Paid"
ACTIVITY_WINDOW_DAYS = 90
TRAILING_YEAR_DAYS = 365
TRAILING_YEAR_END_OFFSET_DAYS = 1
# Days in one billing cycle, used to turn a recurring amount into the rate
# that the reference multiplies by lagging 30-day periods.
BILLING_CYCLE_DAYS = {
    "Annually": 365.0,
    "Monthly": 30.0,
    "Biennially": 730.0,
    "Semi-Annually": 182.5,
    "Triennially": 1095.0,
    "Quarterly": 91.25,
}
DOMAIN_RATE_DIVISOR = 12.0
LAG_PERIOD_DAYS = 30.0
# Rate-band thresholds of the forecast table.
GROWTH_BAND_THRESHOLD = 0.1
CHURN_BAND_THRESHOLD = 0.05
# ---------------------------------------------------------------------------

_DAY_MICROS = 86_400_000_000


def ts_literal(value: datetime) -> Column:
    """A wall-clock ``TIMESTAMP_NTZ`` literal (no time-zone shift)."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def floor_days(later: Column, as_of: datetime) -> Column:
    """Whole days from ``as_of`` to ``later``, floored toward -inf like
    Python's ``timedelta.days`` (half a day ago is -1).  NULL stays NULL."""
    micros = F.timestamp_diff("MICROSECOND", ts_literal(as_of), later)
    return F.floor(micros / F.lit(_DAY_MICROS))


def status_domain(next_date: Column, as_of: datetime) -> Column:
    """No next date -> Inactive; next date within the activity window
    (or later) -> Active; else Inactive."""
    limit = ts_literal(as_of - timedelta(days=ACTIVITY_WINDOW_DAYS))
    return (F.when(next_date.isNull(), F.lit(INACTIVE))
            .when(next_date >= limit, F.lit(ACTIVE))
            .otherwise(F.lit(INACTIVE)))


def status_hosting(next_date: Column, termination: Column, as_of: datetime) -> Column:
    """The null test on the next date comes first, so a terminated
    service without a next date is Active (quirk Q2)."""
    limit = ts_literal(as_of - timedelta(days=ACTIVITY_WINDOW_DAYS))
    return (F.when(next_date.isNull(), F.lit(ACTIVE))
            .when(termination.isNotNull(), F.lit(INACTIVE))
            .when(next_date >= limit, F.lit(ACTIVE))
            .otherwise(F.lit(INACTIVE)))


def payment(next_date: Column, min_next: Column, first: Column, recurring: Column) -> Column:
    """The first payment when the row's next date is the customer's
    earliest one (all ties), else the recurring amount; NULL dates never
    compare equal, so they pay the recurring amount."""
    return F.when(next_date == min_next, first).otherwise(recurring)


def lagging_cycles(final_status: Column, next_date: Column, as_of: datetime) -> Column:
    """E5: Inactive -> 0; Active -> floored days until the next date / 30
    (negative when overdue); Active without a date -> NULL."""
    return (F.when(final_status == INACTIVE, F.lit(0.0))
            .when(final_status == ACTIVE,
                  floor_days(next_date, as_of) / F.lit(LAG_PERIOD_DAYS)))


def free_flag(lag: Column) -> Column:
    """A free-service period exists when the lag is positive."""
    return F.coalesce(lag > 0, F.lit(False))


def cycle_days(cycle: Column) -> Column:
    """Days of a billing cycle; unknown cycles give NULL."""
    expr = None
    for name, days in BILLING_CYCLE_DAYS.items():
        expr = (F.when(cycle == name, F.lit(days)) if expr is None
                else expr.when(cycle == name, F.lit(days)))
    return expr


def cycle_rate(product: Column, flag: Column, recurring: Column, cycle: Column) -> Column:
    """Domains always use recurring/12; hosting and add-ons use
    recurring / cycle-days when flagged (NULL for an unknown cycle), else 0."""
    rec = recurring.cast("double")
    return (F.when(product == "domain", rec / F.lit(DOMAIN_RATE_DIVISOR))
            .when(flag, rec / cycle_days(cycle))
            .otherwise(F.lit(0.0)))


def free_cost(flag: Column, lag: Column, rate: Column) -> Column:
    """Lag * rate inside a free period, else 0."""
    return F.when(flag, lag * rate).otherwise(F.lit(0.0))


def in_trailing_year(date: Column, as_of: datetime) -> Column:
    """as_of-365d <= date <= as_of-1d; NULL dates are outside."""
    lo = ts_literal(as_of - timedelta(days=TRAILING_YEAR_DAYS))
    hi = ts_literal(as_of - timedelta(days=TRAILING_YEAR_END_OFFSET_DAYS))
    return F.coalesce(date.isNotNull() & (date >= lo) & (date <= hi), F.lit(False))


def round_half_even(x: Column, places: int) -> Column:
    """numpy/pandas rounding — half-even on the scaled double."""
    scale = float(10 ** places)
    if places == 0:
        return F.rint(x)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def safe_ratio(num: Column, den: Column) -> Column:
    """NULL where the reference produced inf/NaN."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def money_text(x: Column, prefix: str = "$ ") -> Column:
    """E17: "$ 1,234.50" (two places, thousands grouped); the forecast
    display of the original uses the prefix "$" without a space."""
    return F.concat(F.lit(prefix), F.format_number(x, 2))


def growth_band(rate: Column) -> Column:
    """Red below the growth threshold, else green (NULL compares false -> green)."""
    return F.when(F.coalesce(rate < GROWTH_BAND_THRESHOLD, F.lit(False)), F.lit("red")).otherwise(F.lit("green"))


def churn_band(rate: Column) -> Column:
    """Green below the churn threshold, else red (NULL compares false -> red)."""
    return F.when(F.coalesce(rate < CHURN_BAND_THRESHOLD, F.lit(False)), F.lit("green")).otherwise(F.lit("red"))


def exact_sum(x: Column, places: int = 6) -> Column:
    """Order-independent sum of a derived double: each value is rounded
    half-even to ``places`` decimals and summed as an exact decimal, so every
    run (and any partitioning) returns the same bits.  Result is DOUBLE;
    NULL when no non-null input."""
    scaled = F.rint(x * F.lit(float(10 ** places))).cast("decimal(30,0)")
    return F.sum(scaled).cast("double") / F.lit(float(10 ** places))
