import math

import pytest
from pyspark.sql import functions as F

from terralake import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_distance_on_great_circles(spark):
    """Arcs along a meridian and the equator have their length by definition; distance is symmetric and obeys the triangle."""
    degree = math.pi * 6371.0088 / 180
    arcs = [((y, 12.0), (y + d, 12.0), d) for y, d in ((-71.5, 3.25), (8.0, 0.004), (40.0, 50.0))]
    arcs += [((0.0, x), (0.0, x + d), d) for x, d in ((-179.5, 1.75), (33.0, 90.0), (-20.0, 179.0))]
    for a, b, d in arcs:
        assert one(spark, fn.haversine_km(*map(F.lit, (*a, *b)))) == pytest.approx(d * degree, rel=1e-9)
    points = spark.range(40).select(*(((F.xxhash64("id", F.lit(k)) % m).cast("double") / 10).alias(c) for k, (c, m) in enumerate((("y1", 900), ("x1", 1800), ("y2", 900), ("x2", 1800), ("y3", 900), ("x3", 1800)))))
    d = lambda i, j: fn.haversine_km(f"y{i}", f"x{i}", f"y{j}", f"x{j}")
    bad = points.filter((F.abs(d(1, 2) - d(2, 1)) > 1e-9) | (d(1, 3) > d(1, 2) + d(2, 3) + 1e-6) | (d(1, 2) < 0) | (d(1, 1) != 0))
    assert bad.isEmpty()


def test_calendar_distance_is_a_circle_of_366_days(spark):
    days = spark.range(1, 367).select(F.col("id").cast("int").alias("a"), F.explode(F.array(*(F.lit(k) for k in (1, 59, 183, 300, 366)))).alias("b"))
    gap = fn.doy_distance("a", "b")
    around = F.least(F.pmod(F.col("a") - F.col("b"), F.lit(366)), F.pmod(F.col("b") - F.col("a"), F.lit(366)))
    assert days.filter((gap != around) | (gap != fn.doy_distance("b", "a")) | (gap > 183)).isEmpty()


def test_centuries_have_a_hundred_years_and_no_zero(spark):
    years = spark.range(-1000, 1001).filter("id != 0").select(F.col("id").cast("int").alias("y")).withColumn("c", fn.century("y"))
    assert years.filter("c = 0 OR sign(c) != sign(y)").isEmpty()
    assert {(r.c, r["count"]) for r in years.groupBy("c").count().collect()} == {(c, 100) for c in range(-10, 11) if c}


def test_days_of_24_clock_hours(spark):
    start = F.lit("2031-03-09 17:20:00").cast("timestamp")
    hours = spark.range(0, 200).withColumn("end", start + F.make_dt_interval(hours=F.col("id").cast("int")))
    day = fn.int_div(fn.hours_crossed(start, "end"), 24) + 1
    assert hours.filter(day != F.floor(F.col("id") / 24) + 1).isEmpty()


def test_hours_are_counted_by_boundaries(spark):
    a, b = (F.lit(x).cast("timestamp") for x in ("2020-01-01 00:59:00", "2020-01-01 02:01:00"))
    assert one(spark, fn.hours_crossed(a, b)) == 2


def test_safe_date(spark):
    date = lambda y, m, d: one(spark, fn.safe_date(*map(F.lit, (y, m, d))).cast("string"))
    assert date(2023, 2, 30) is None
    assert date(2023, 2, 28) == "2023-02-28"
    assert date(-4360, 1, 1) == "-4360-01-01"
    assert date(2023, None, 1) is None


def test_local_date_differs_from_utc_date(spark):
    t = F.lit("2024-01-01 20:00:00").cast("timestamp")
    assert str(one(spark, fn.local_date(t, F.lit("Asia/Tokyo")))) == "2024-01-02"
    assert str(one(spark, fn.local_date(t, F.lit("America/New_York")))) == "2024-01-01"


def test_ratio_of_zero_is_null_and_clamp_bounds(spark):
    assert one(spark, fn.ratio(F.lit(1), F.lit(0))) is None
    scale = spark.range(-30, 31).select((F.col("id") / 20).alias("v")).withColumn("c", fn.clamp("v"))
    assert scale.filter("c NOT BETWEEN 0 AND 1 OR (v BETWEEN 0 AND 1 AND c != v)").isEmpty()


def test_round_to_long_rounds_before_the_cast(spark):
    assert one(spark, fn.round_to_long(F.lit(19.75))) == 20


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert df.agg(fn.safe_corr("x", "y").alias("r")).first().r is None
    assert df.agg(fn.safe_corr("x", "x").alias("r")).first().r == pytest.approx(1.0)


def test_correlation_skips_incomplete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 5.0), (99.0, None), (None, 7.0)], "x double, y double")
    want = df.dropna().agg(F.corr("x", "y").alias("r")).first().r
    assert df.agg(fn.safe_corr("x", "y").alias("r")).first().r == pytest.approx(want)


def test_value_at_extreme_skips_missing_values(spark):
    df = spark.createDataFrame([(None, 9), (5.0, 8), (4.0, 1), (None, 0)], "v double, k int")
    got = df.agg(fn.value_at_max("v", "k").alias("hi"), fn.value_at_min("v", "k").alias("lo")).first()
    assert (got.hi, got.lo) == (5.0, 4.0)


def test_sum_if_is_null_without_a_match(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert df.agg(fn.sum_if(F.col("v") > 9, "v").alias("s")).first().s is None


def test_smoothed_rate_never_reaches_one(spark):
    df = spark.createDataFrame([(True,), (True,), (True,)], "hit boolean")
    assert df.agg(fn.smoothed_rate("hit").alias("p")).first().p == pytest.approx(0.8)


def test_skill_has_the_sign_of_the_gain(spark):
    scores = spark.range(1, 60).select((F.col("id") / 100).alias("model"), F.lit(0.3).alias("base"))
    assert scores.filter(F.signum(fn.skill("model", "base")) != F.signum(F.col("base") - F.col("model"))).isEmpty()


def test_ordered_concat(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "o int, name string")
    assert df.agg(fn.ordered_concat("name", ["o"]).alias("s")).first().s == "a · b"
    assert df.filter("o = 3").agg(fn.ordered_concat("name", ["o"]).alias("s")).first().s is None


def test_ace_uses_synoptic_points_at_storm_force(spark):
    df = spark.createDataFrame([(50.0, True), (50.0, False), (20.0, True), (None, True)], "w double, s boolean")
    assert df.agg(fn.ace("w", "s").alias("a")).first().a == pytest.approx(0.25)


def test_correlation_of_a_constant_is_null_over_many_partitions(spark):
    df = spark.range(0, 4900, 1, 49).select(F.col("id").cast("double").alias("x"), F.lit(1.1).alias("y"))
    assert df.agg(fn.safe_corr("x", "y").alias("r")).first().r is None
