"""Cohort operators: user x year pivot R4, signup/signoff A4, yearly
subscribers/additions/churn/revenue/ARPU A5–A9, the year-aligned table J8,
the lag W11, growth/churn/forecast T1–T5, the long form R6 and rate bands E18.

Plan shape: paid invoices are read once and reduced to one fixed-width row per
customer with map-side partial aggregation; everything after that works on
per-customer or per-year tables.  The year-ordered window (lag) runs over the per-year
table — as many rows as years — so a single window partition is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.functions import expr as E
from revlens.operators.clean import paid_only


def _amount() -> Column:
    return F.coalesce(F.col("total"), F.lit(0).cast("decimal(18,2)"))


def user_year_pivot(invoices: DataFrame, years: Sequence[int]) -> DataFrame:
    """R4 + A4: per paying customer one column per year (sum of paid totals
    in that year, 0 otherwise; NULL totals count 0) and the signup/signoff
    years (first/last paid date, as text)."""
    paid = paid_only(invoices).withColumn("year", F.year("date"))
    return paid.groupBy("userid").agg(
        *[F.sum(F.when(F.col("year") == y, _amount()).otherwise(F.lit(0).cast("decimal(18,2)")))
          .cast("double").alias(f"y{y}") for y in years],
        F.date_format(F.min("date"), "yyyy").alias("signup_year"),
        F.date_format(F.max("date"), "yyyy").alias("signoff_year"))


def signup_signoff(invoices: DataFrame) -> DataFrame:
    """A4: first and last paid date per customer and their years."""
    paid = paid_only(invoices)
    return (paid.groupBy("userid")
            .agg(F.min("date").alias("first_paid"), F.max("date").alias("last_paid"))
            .withColumn("signup_year", F.date_format("first_paid", "yyyy"))
            .withColumn("signoff_year", F.date_format("last_paid", "yyyy")))


def user_years(invoices: DataFrame) -> DataFrame:
    """Paid invoices reduced to (userid, year, amount, first, last)."""
    paid = paid_only(invoices)
    return paid.groupBy("userid", F.year("date").alias("year")).agg(
        F.sum(_amount()).alias("amount"),
        F.min("date").alias("first_paid"), F.max("date").alias("last_paid"))


def customer_years(invoices: DataFrame, years: Sequence[int]) -> DataFrame:
    """Paid invoices reduced to one fixed-width row per customer: the sum of
    each year of the range (NULL without a paid invoice) and the first and
    last paid date."""
    paid = paid_only(invoices).withColumn("year", F.year("date"))
    return paid.groupBy("userid").agg(
        *[F.sum(F.when(F.col("year") == y, _amount())).alias(f"y{y}") for y in years],
        F.min("date").alias("first_paid"), F.max("date").alias("last_paid"))


def annual_cohort(spark: SparkSession, invoices: DataFrame, years: Sequence[int],
                  rounded: bool = True) -> DataFrame:
    """One row per year of the range or of any signup/signoff year —
    subscribers (customers whose year sum is > 0), additions (signups),
    disengagement (signoffs), revenue and ARPU.  Subscribers/revenue/ARPU are
    NULL outside the range, additions/disengagement NULL where none (Q9).
    ``rounded`` applies the reference's 2-place rounding.

    The invoices are read once: a customer's row is stacked into its years, its
    signup and its signoff, which the per-year aggregate counts."""
    lo, hi = min(years), max(years)
    rng = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("year"))
    dec = "decimal(38,4)"
    none = F.lit(None).cast(dec)

    def event(year: Column, kind: str, value: Column) -> Column:
        return F.struct(year.cast("int").alias("year"), F.lit(kind).alias("k"), value.alias("v"))

    events = [F.when(F.col(f"y{y}").isNotNull(), event(F.lit(y), "uy", F.col(f"y{y}").cast(dec))) for y in range(lo, hi + 1)]
    events += [event(F.year("first_paid"), "add", none), event(F.year("last_paid"), "dis", none)]
    stacked = customer_years(invoices, range(lo, hi + 1)).select(F.inline(F.array_compact(F.array(*events))))
    tidy = (rng.select("year", F.lit("range").alias("k"), none.alias("v")).unionByName(stacked)
            .where(F.col("year").isNotNull()))
    k = F.col("k")
    has_range = F.max(k == "range")
    agg = tidy.groupBy("year").agg(
        F.when(has_range, F.count_if((k == "uy") & (F.col("v") > 0))).alias("subscribers"),
        F.nullif(F.count_if(k == "add"), F.lit(0)).alias("additions"),
        F.nullif(F.count_if(k == "dis"), F.lit(0)).alias("disengagement"),
        F.when(has_range, F.coalesce(F.sum(F.when(k == "uy", F.col("v"))), F.lit(0).cast(dec)))
        .cast("double").alias("revenue"))
    arpu = E.safe_ratio(F.col("revenue"), F.col("subscribers"))
    return agg.select("year", "subscribers", "additions", "disengagement",
                      E.round_half_even(F.col("revenue"), 2).alias("revenue") if rounded else F.col("revenue"),
                      (E.round_half_even(arpu, 2) if rounded else arpu).alias("arpu"))


def metric_by_year(cohort: DataFrame, metric: str) -> DataFrame:
    """A5–A9 as (year, value): the metric where the reference's series has an
    entry (range years for subscribers/revenue/ARPU, years with a count for
    additions/disengagement)."""
    return cohort.where(F.col(metric).isNotNull()).select("year", F.col(metric).alias("value"))


def lagged_subscribers(cohort: DataFrame) -> DataFrame:
    """Previous year's subscribers, 0 before the first year."""
    w = Window.orderBy("year")
    return cohort.select("year", "subscribers",
                         F.lag("subscribers", 1, 0).over(w).alias("prev_subscribers"))


def cohort_forecast(cohort: DataFrame) -> DataFrame:
    """T1–T5 over the rounded cohort table (Q8): growth and churn against the
    previous year's subscribers, the forecast from the previous year's rates,
    forecast revenue from the previous ARPU, variance and its rate; all
    rounded to 2 places at the end.  Ratios are NULL where the reference had
    inf/NaN."""
    w = Window.orderBy("year")
    prev_s = F.lag("subscribers", 1, 0).over(w).cast("double")
    step1 = cohort.select("*", prev_s.alias("_ps"))
    step1 = step1.select("*",
                         E.safe_ratio(F.col("additions"), F.col("_ps")).alias("_g"),
                         E.safe_ratio(F.col("disengagement"), F.col("_ps")).alias("_c"))
    step2 = step1.select(
        "*",
        (F.col("_ps") - F.col("_ps") * F.lag("_c", 1, 0.0).over(w)
         + F.col("_ps") * F.lag("_g", 1, 0.0).over(w)).alias("_fs"),
        F.lag("arpu", 1, 0.0).over(w).alias("_pa"))
    step3 = step2.select("*", (F.col("_pa") * F.col("_fs")).alias("_fr"))
    step3 = step3.select("*", (F.col("_fr") - F.col("revenue")).alias("_v"))
    step3 = step3.select("*", (E.safe_ratio(F.col("_v"), F.col("revenue")) * F.lit(100.0)).alias("_vr"))
    r = lambda c: E.round_half_even(F.col(c), 2)
    return step3.select("year", "subscribers", "additions", "disengagement", "revenue", "arpu",
                        r("_g").alias("growth_rate"), r("_c").alias("churn_rate"),
                        r("_fs").alias("forecast_subscribers"), r("_fr").alias("forecast_revenue"),
                        r("_v").alias("variance"), r("_vr").alias("var_rate"))


FORECAST_METRICS = ["subscribers", "additions", "disengagement", "revenue", "arpu", "growth_rate",
                    "churn_rate", "forecast_subscribers", "forecast_revenue", "variance", "var_rate"]


def forecast_table_long(forecast: DataFrame) -> DataFrame:
    """The metric x year table in long form (year, metric, value), missing
    values kept, with the value as grouped text of two places (E17)."""
    wide = forecast.select("year", *[F.col(m).cast("double").alias(m) for m in FORECAST_METRICS])
    long = wide.unpivot("year", FORECAST_METRICS, "metric", "value")
    return long.withColumn("value_text", E.money_text(F.col("value"), ""))


def rate_bands(forecast: DataFrame) -> DataFrame:
    """Colour bands of the growth and churn rows."""
    return forecast.select("year", "growth_rate", "churn_rate",
                           E.growth_band(F.col("growth_rate")).alias("growth_band"),
                           E.churn_band(F.col("churn_rate")).alias("churn_band"))
