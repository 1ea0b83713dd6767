"""Grouped Holt-Winters fold against a plain Python loop over the same grid,
and the truncating growth projection."""

from itertools import product

import pytest

from revlens.operators import forecast

GRID = (0.1, 0.3, 0.5, 0.7, 0.9)


def _loop_fit(ys, m, points=None):
    best = None
    for a, b, g in points or product(GRID, GRID, GRID):
        level = sum(ys[:m]) / m
        trend = (sum(ys[m:2 * m]) / m - level) / m
        season = [y - level for y in ys[:m]]
        sse, fitted = 0.0, []
        for y in ys:
            s_old = season[0]
            f = level + trend + s_old
            new_level = a * (y - s_old) + (1 - a) * (level + trend)
            new_trend = b * (new_level - level) + (1 - b) * trend
            new_s = g * (y - level - trend) + (1 - g) * s_old
            level, trend, season = new_level, new_trend, season[1:] + [new_s]
            sse += (y - f) * (y - f)
            fitted.append(f)
        cand = (sse, a, b, g, level, trend, season, fitted)
        if best is None or cand[:4] < best[:4]:
            best = cand
    return best


def test_holt_winters_matches_loop(spark):
    series = {"A": [100.0, 140.0, 120.0, 170.0, 150.0, 205.0],
              "B": [10.0, 30.0, 12.0, 33.0, 11.0, 35.0, 14.0],
              "C": [5.0, 6.0, 7.0]}                     # too short for two seasons
    years = {k: list(range(2000, 2000 + len(v))) for k, v in series.items()}
    rows = [(k, y, v) for k, vs in series.items() for y, v in zip(years[k], vs)]
    df = spark.createDataFrame(rows, "series string, year int, y double")
    for name in ["A", "B"]:
        fit = forecast.holt_winters(df.where(df.series == name), years[name], m=2).collect()
        assert len(fit) == 1
        sse, a, b, g, level, trend, season, fitted = _loop_fit(series[name], 2)
        got = fit[0]
        assert (got.alpha, got.beta, got.gamma) == (a, b, g)
        assert abs(got.state.sse - sse) < 1e-6 and abs(got.state.l - level) < 1e-9
        assert [round(x, 9) for x in got.state.fitted] == [round(x, 9) for x in fitted]
        fc = forecast.hw_forecast(forecast.holt_winters(df.where(df.series == name), years[name], m=2),
                                  years[name][-1], m=2, horizon=3, rounded=False).collect()
        expect = [level + h * trend + season[(h - 1) % 2] for h in (1, 2, 3)]
        assert [round(r.forecast, 9) for r in sorted(fc, key=lambda r: r.step)] == [round(x, 9) for x in expect]
    with pytest.raises(ValueError):
        forecast.holt_winters(df.where(df.series == "C"), years["C"], m=2)


def test_zoomed_fit_matches_loop_and_is_never_worse(spark):
    series = {"A": [100.0, 140.0, 120.0, 170.0, 150.0, 205.0],
              "B": [10.0, 30.0, 12.0, 33.0, 11.0, 35.0],
              "edge": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
              "flat": [7.0] * 6}
    years = list(range(2000, 2006))
    rows = [(k, y, v) for k, vs in series.items() for y, v in zip(years, vs)]
    df = spark.createDataFrame(rows, "series string, year int, y double")
    fits = [{r.series: r for r in forecast.holt_winters(df, years, 2, zooms).collect()} for zooms in (0, 1, 2)]
    for name, ys in series.items():
        want = _loop_fit(ys, 2)
        for zoom in (0, 1):
            near = [[min(1.0, max(0.0, c + k * 0.05 / 4 ** zoom)) for k in (-2, -1, 0, 1, 2)] for c in want[1:4]]
            want = _loop_fit(ys, 2, list(product(*near)))
            got = fits[zoom + 1][name]
            assert (got.alpha, got.beta, got.gamma) == want[1:4]
            assert abs(got.state.sse - want[0]) < 1e-9
            assert got.state.sse <= fits[zoom][name].state.sse
    plans = [forecast.holt_winters(df, years, 2, zooms)._jdf.queryExecution().executedPlan().toString() for zooms in (0, 2)]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")     # zooms add no shuffle
    assert fits[2]["A"].state.sse < fits[0]["A"].state.sse
    fine = [[x / 50 for x in range(51)]] * 3             # a plain search over 132,651 points
    assert fits[2]["A"].state.sse <= _loop_fit(series["A"], 2, product(*fine))[0] * 1.05


def test_growth_projection_truncates_each_year(spark):
    fc = spark.createDataFrame([("ALL", 1, 2001, 1000.7)], "series string, step int, year int, forecast double")
    got = [(r.year, r.projected_revenue) for r in
           forecast.growth_projection(fc, 0.1, 0.05, 3).orderBy("year").collect()]
    v1 = int(1000.7 * 1.05)
    v2 = int(v1 * 1.05)
    v3 = int(v2 * 1.05)
    assert got == [(2002, float(v1)), (2003, float(v2)), (2004, float(v3))]
