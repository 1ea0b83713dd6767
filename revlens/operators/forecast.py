"""Forecast operators: additive Holt-Winters over many series in parallel
(T6) and the compound growth projection (T7).

The reference fits one annual revenue series with a single-machine optimiser.
Here every series (all customers, and each market segment) is fitted at once
as a Spark plan:

1. the yearly values of a series (bounded by the number of years, after
   aggregation) are gathered into one array per series;
2. each series row is expanded to the fixed smoothing grid (a literal array
   exploded per row — no join);
3. the Holt-Winters recurrences are one ``aggregate`` fold per row, evaluated
   in the JVM; the state carries level, trend, the last ``m`` seasonals, the
   SSE and the one-step fitted values;
4. ``min_by`` over the SSE picks the grid point per series;
5. optionally the same fold runs again on a finer grid around each series' own
   best point (a zoom), which holds that point, so the SSE never grows.

Start values (textbook): level = mean of the first season, trend =
(mean of the second season - level) / m, seasonals = first season - level.
The grid is 0.1..0.9 step 0.2 for alpha, beta and gamma.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import expr as E
from revlens.operators.cohort import user_years

GRID = (0.1, 0.3, 0.5, 0.7, 0.9)
# Spacing of the first zoom, and how many times finer each further one is: the
# five points of a zoom reach half a spacing of the grid before it.
ZOOM_STEP, ZOOM_FACTOR = 0.05, 4
ALL_SERIES = "ALL"


def revenue_series(invoices: DataFrame, customers: DataFrame | None, years: Sequence[int]) -> DataFrame:
    """(series, year, y): yearly paid revenue of all customers (the
    reference's series) and, when a customer dimension is given, of each
    market segment, over ``years`` (rounded to 2 places like the cohort
    table).  Invoices are reduced per (customer, year) before the join."""
    uy = user_years(invoices).where(F.col("year").isin(list(years)))
    both = uy.select(F.lit(ALL_SERIES).alias("series"), "year", "amount")
    if customers is not None:
        seg = customers.select(F.col("c_custkey").alias("userid"), F.col("c_mktsegment").alias("series"))
        both = uy.join(seg, "userid", "inner").select("series", "year", "amount").unionByName(both)
    return (both.groupBy("series", "year")
            .agg(E.round_half_even(F.sum("amount").cast("double"), 2).alias("y")))


def _fold(ys: Column, m: int) -> Column:
    a, b, g = F.col("_alpha"), F.col("_beta"), F.col("_gamma")
    first = F.slice(ys, 1, m)
    second = F.slice(ys, m + 1, m)
    mean = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.lit(float(m))
    l0 = mean(first)
    init = F.struct(
        l0.alias("l"),
        ((mean(second) - l0) / F.lit(float(m))).alias("b"),
        F.transform(first, lambda x: x - l0).alias("s"),
        F.lit(0.0).alias("sse"),
        F.array().cast("array<double>").alias("fitted"))

    def step(st: Column, y: Column) -> Column:
        l, tr, s_old = st["l"], st["b"], F.element_at(st["s"], 1)
        f = l + tr + s_old
        l_new = a * (y - s_old) + (F.lit(1.0) - a) * (l + tr)
        b_new = b * (l_new - l) + (F.lit(1.0) - b) * tr
        s_new = g * (y - l - tr) + (F.lit(1.0) - g) * s_old
        return F.struct(
            l_new.alias("l"), b_new.alias("b"),
            F.concat(F.slice(st["s"], 2, m - 1), F.array(s_new)).alias("s"),
            (st["sse"] + (y - f) * (y - f)).alias("sse"),
            F.concat(st["fitted"], F.array(f)).alias("fitted"))

    return F.aggregate(ys, init, step)


def zoom_offsets(zoom: int) -> list[float]:
    """Distances of the ``zoom``-th finer grid (from 0) to its centre."""
    return [k * ZOOM_STEP / ZOOM_FACTOR ** zoom for k in (-2, -1, 0, 1, 2)]


def _best(points: DataFrame, m: int) -> DataFrame:
    """The row of least SSE of each series of ``(series, ys, _alpha, _beta,
    _gamma)``, with its state ``st``; ties go to the least parameters."""
    fitted = points.select("series", "ys", "_alpha", "_beta", "_gamma", _fold(F.col("ys"), m).alias("st"))
    return fitted.groupBy("series").agg(F.min_by(
        F.struct("ys", "_alpha", "_beta", "_gamma", "st"),
        F.struct(F.col("st.sse"), "_alpha", "_beta", "_gamma")).alias("fit")).select("series", "fit.*")


def _around(best: DataFrame, zoom: int) -> DataFrame:
    """The points around each series' best one, within 0 to 1."""
    offsets = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.lit(z).alias("g"))
                        for x, y, z in product(zoom_offsets(zoom), repeat=3)])
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return (best.select("series", "ys", "_alpha", "_beta", "_gamma", F.explode(offsets).alias("_o"))
            .select("series", "ys", *[inside(F.col(c) + F.col(f"_o.{o}")).alias(c)
                                      for c, o in (("_alpha", "a"), ("_beta", "b"), ("_gamma", "g"))]))


def holt_winters(series: DataFrame, years: Sequence[int], m: int = 2, zooms: int = 0) -> DataFrame:
    """Fit every series of ``(series, year, y)``; one row per series with the
    chosen parameters, final state and fitted values.  Fewer years than two
    seasons are an error.  After the fixed grid, ``zooms`` finer grids around the
    best point so far refine it; they add no shuffle, since the rows of a series
    stay together."""
    years = sorted(years)
    if len(years) < 2 * m:
        raise ValueError(f"{len(years)} years are too few for two seasons of {m}")
    per_series = series.groupBy("series").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "y"))).alias("_m"))
    ys = F.transform(F.array(*[F.lit(y) for y in years]),
                     lambda yr: F.coalesce(F.try_element_at(F.col("_m"), yr), F.lit(0.0)))
    grid = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.lit(z).alias("g"))
                     for x, y, z in product(GRID, GRID, GRID)])
    expanded = (per_series.select("series", ys.alias("ys"))
                .select("series", "ys", F.explode(grid).alias("_p"))
                .select("series", "ys", F.col("_p.a").alias("_alpha"), F.col("_p.b").alias("_beta"),
                        F.col("_p.g").alias("_gamma")))
    best = _best(expanded, m)
    for zoom in range(zooms):
        best = _best(_around(best, zoom), m)
    return best.select("series", F.col("_alpha").alias("alpha"), F.col("_beta").alias("beta"),
                       F.col("_gamma").alias("gamma"), F.col("st").alias("state"))


def hw_forecast(fit: DataFrame, last_year: int, m: int = 2, horizon: int = 3,
                rounded: bool = True) -> DataFrame:
    """(series, step, year, forecast): level + h*trend + matching seasonal,
    rounded to 2 places unless ``rounded`` is False."""
    st = F.col("state")
    steps = F.sequence(F.lit(1), F.lit(horizon))
    out = fit.select("series", "state", F.explode(steps).alias("step"))
    fc = st["l"] + F.col("step").cast("double") * st["b"] + \
        F.element_at(st["s"], F.pmod(F.col("step") - 1, F.lit(m)) + 1)
    out = out.select("series", "step", (F.lit(last_year) + F.col("step")).alias("year"),
                     (E.round_half_even(fc, 2) if rounded else fc).alias("forecast"))
    return out.withColumn("forecast_text", E.money_text(F.col("forecast"), "$")) if rounded else out


def hw_fitted(fit: DataFrame, years: Sequence[int]) -> DataFrame:
    """(series, year, fitted): one-step-ahead fitted values."""
    yrs = F.array(*[F.lit(y) for y in sorted(years)])
    z = fit.select("series", F.explode(F.arrays_zip(yrs.alias("year"), F.col("state.fitted").alias("f")))
                   .alias("z"))
    return z.select("series", F.col("z.year").alias("year"),
                    E.round_half_even(F.col("z.f"), 2).alias("fitted"))


def growth_projection(forecast: DataFrame, growth: float, churn: float, years: int = 3) -> DataFrame:
    """From the first forecast step, each following year is the previous
    value times (1 + growth - churn), truncated to a whole number."""
    factor = 1 + (growth - churn)
    base = forecast.where(F.col("step") == 1).select("series", "year", "forecast")
    k = F.explode(F.sequence(F.lit(1), F.lit(years))).alias("k")
    out = base.select("series", "year", "forecast", k)
    val = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.col("forecast"),
                      lambda acc, _: (acc * F.lit(factor)).cast("bigint").cast("double"))
    return out.select("series", (F.col("year") + F.col("k")).alias("year"), val.alias("projected_revenue"),
                      E.money_text(val).alias("projected_text"))
