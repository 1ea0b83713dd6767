"""Scalar-expression traps: time-of-day boundaries, floor
days, cycle rates, rounding, key coercion."""

from pyspark.sql import functions as F

from revlens.functions import expr as E
from revlens.functions.keys import coerce_numeric_key

from conftest import AS_OF, ts


def _rows(df):
    return [tuple(r) for r in df.collect()]


def test_domain_status_window_boundaries(spark):
    df = spark.createDataFrame(
        [(1, None), (2, ts("2001-03-17")), (3, ts("2001-03-18")), (4, ts("2001-07-05"))],
        "k int, nxt timestamp_ntz")
    out = dict(_rows(df.select("k", E.status_domain(F.col("nxt"), AS_OF))))
    # midnight of 03-17 is before the limit 03-17 12:00 -> Inactive
    assert out == {1: "Inactive", 2: "Inactive", 3: "Active", 4: "Active"}


def test_hosting_status_null_date_beats_termination(spark):
    df = spark.createDataFrame(
        [(1, None, ts("2001-01-01")), (2, ts("2001-07-01"), ts("2001-01-01")), (3, ts("2001-07-01"), None),
         (4, ts("2001-01-01"), None)],
        "k int, nxt timestamp_ntz, term timestamp_ntz")
    out = dict(_rows(df.select("k", E.status_hosting(F.col("nxt"), F.col("term"), AS_OF))))
    assert out == {1: "Active", 2: "Inactive", 3: "Active", 4: "Inactive"}


def test_floor_days_and_lagging_cycles(spark):
    df = spark.createDataFrame(
        [(1, ts("2001-06-15")), (2, ts("2001-06-16")), (3, ts("2001-07-16")), (4, None)],
        "k int, nxt timestamp_ntz")
    days = dict(_rows(df.select("k", E.floor_days(F.col("nxt"), AS_OF))))
    assert days == {1: -1, 2: 0, 3: 30, 4: None}
    lag = dict(_rows(df.select("k", E.lagging_cycles(F.lit("Active"), F.col("nxt"), AS_OF))))
    assert lag[1] == -1 / 30 and lag[2] == 0.0 and lag[3] == 1.0 and lag[4] is None
    inactive = dict(_rows(df.select("k", E.lagging_cycles(F.lit("Inactive"), F.col("nxt"), AS_OF))))
    assert set(inactive.values()) == {0.0}
    flags = dict(_rows(df.select("k", E.free_flag(E.lagging_cycles(F.lit("Active"), F.col("nxt"), AS_OF)))))
    assert flags == {1: False, 2: False, 3: True, 4: False}


def test_cycle_rate_rules(spark):
    df = spark.createDataFrame(
        [(1, "hosting", True, 365.0, "Annually"), (2, "hosting", True, 91.25, "Quarterly"),
         (3, "hosting", True, 100.0, "One Time"), (4, "hosting", False, 100.0, "Monthly"),
         (5, "domain", False, 120.0, None)],
        "k int, product string, flag boolean, rec double, cycle string")
    out = dict(_rows(df.select("k", E.cycle_rate(F.col("product"), F.col("flag"), F.col("rec"), F.col("cycle")))))
    assert out == {1: 1.0, 2: 1.0, 3: None, 4: 0.0, 5: 10.0}
    cost = dict(_rows(df.select("k", E.free_cost(F.col("flag"), F.lit(2.0), F.lit(None).cast("double")))))
    assert cost[3] is None and cost[4] == 0.0


def test_trailing_year_bounds(spark):
    df = spark.createDataFrame(
        [(1, ts("2000-06-15")), (2, ts("2000-06-16")), (3, ts("2001-06-14")), (4, ts("2001-06-15")), (5, None)],
        "k int, d timestamp_ntz")
    out = dict(_rows(df.select("k", E.in_trailing_year(F.col("d"), AS_OF))))
    assert out == {1: False, 2: True, 3: True, 4: False, 5: False}


def test_round_half_even_and_ratio(spark):
    df = spark.createDataFrame([(2.5, 0.125, 1.0, 0.0)], "a double, b double, c double, z double")
    r = df.select(E.round_half_even(F.col("a"), 0), E.round_half_even(F.col("b"), 2),
                  E.safe_ratio(F.col("c"), F.col("z")), E.money_text(F.lit(1234567.891))).first()
    assert tuple(r) == (2.0, 0.12, None, "$ 1,234,567.89")


def test_bands(spark):
    df = spark.createDataFrame([(1, 0.05, 0.01), (2, 0.2, 0.2), (3, None, None)], "k int, g double, c double")
    out = {r[0]: (r[1], r[2]) for r in df.select("k", E.growth_band(F.col("g")), E.churn_band(F.col("c"))).collect()}
    assert out == {1: ("red", "green"), 2: ("green", "red"), 3: ("green", "red")}


def test_key_coercion(spark):
    df = spark.createDataFrame([("abc",), (" 12 ",), ("1d",), ("nan",), ("2.5f",), ("7",), (None,)], "id string")
    out = [r[0] for r in df.select(coerce_numeric_key(df, "id").alias("id")).collect()]
    assert out == [None, 12.0, None, None, None, 7.0, None]
    nums = spark.createDataFrame([(1,), (None,)], "id bigint")
    assert [r[0] for r in nums.select(coerce_numeric_key(nums, "id")).collect()] == [1, None]
