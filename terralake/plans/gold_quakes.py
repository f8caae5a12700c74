"""Gold: magnitude statistics, sequences, proximity and the aftershock model."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralake.functions import (
    classify,
    local_date,
    local_ts,
    ratio,
    round_if,
    safe_corr,
    share_pct,
    sum_if,
)
from terralake.operators.aggregates import with_total
from terralake.operators.geo import decluster, follow_counts, geo_join, within_reach
from terralake.operators.joins import left_zero
from terralake.operators.windows import group_total, with_running_sum
from terralake.plans.silver import Tables

# Completeness magnitude, bin width, main-shock limit and the
# distances (km) and spans (days) of the sequence and proximity models.
COMPLETENESS = 4.5
BIN_WIDTH = 0.1
MAIN_MAGNITUDE = 6.5
SEQUENCE_KM = 150
SEQUENCE_DAYS = 30
DECLUSTER_DAYS = 90
PRESSURE_KM = 500
NEAR_KM = 700


def gold_quake_magnitude_frequency(
    t: Tables, rounding: bool = True, completeness: float = COMPLETENESS
) -> DataFrame:
    """Events per magnitude bin and the number at or above each bin.

    The running sum sees one row per bin, about fifty, never the events.
    """
    complete = t["silver_earthquakes"].filter(F.col("magnitude") >= completeness)
    width = int(round(1 / BIN_WIDTH))
    mag_bin = F.floor(F.col("magnitude") * width).cast("double") / F.lit(float(width))
    binned = complete.groupBy(mag_bin.alias("mag_bin")).agg(F.count(F.lit(1)).alias("n_events"))
    counted = with_running_sum(binned, "n_cumulative", "n_events", ["-mag_bin"])
    log_n = F.log10(F.col("n_cumulative").cast("double"))
    return counted.withColumn("log10_n_cumulative", round_if(log_n, 4, rounding))


def gold_quake_b_value(
    t: Tables, rounding: bool = True, completeness: float = COMPLETENESS
) -> DataFrame:
    """Maximum-likelihood slope of the frequency law, overall and per depth class."""
    r = lambda c, n: round_if(c, n, rounding)
    complete = t["silver_earthquakes"].filter(F.col("magnitude") >= completeness)
    stats = with_total(
        complete,
        "depth_class",
        [
            F.count(F.lit(1)).alias("n_events"),
            F.avg("magnitude").alias("mean"),
            F.max("magnitude").alias("largest"),
        ],
        total="global",
        name="scope",
    )
    above = F.col("mean") - F.lit(completeness - BIN_WIDTH / 2)
    n = F.col("n_events").cast("double")
    b = ratio(F.lit(math.log10(math.e)), above)
    return stats.withColumn("b", b).select(
        "scope",
        "n_events",
        r("mean", 4).alias("mag_mean"),
        r("largest", 1).alias("mag_max"),
        r("b", 3).alias("b_value"),
        r(F.col("b") / F.sqrt(n), 4).alias("b_std_error"),
        r(F.log10(n) + F.col("b") * F.lit(completeness), 3).alias("a_value"),
    )


def _mains(events: DataFrame, magnitude: float) -> DataFrame:
    return events.filter(F.col("magnitude") >= magnitude)


def gold_quake_sequences(
    t: Tables,
    rounding: bool = True,
    main_magnitude: float = MAIN_MAGNITUDE,
    km: float = SEQUENCE_KM,
    days: int = SEQUENCE_DAYS,
    completeness: float = COMPLETENESS,
) -> DataFrame:
    """Aftershocks per main shock and day.

    Day 1 is 24 clock-hour steps. Days without aftershocks have no row.
    """
    quakes = t["silver_earthquakes"]
    mains = _mains(quakes, main_magnitude).select(
        F.col("event_id").alias("mainshock_id"),
        F.col("place").alias("mainshock_place"),
        F.col("magnitude").alias("mainshock_mag"),
        F.col("time").alias("mainshock_time"),
        F.col("lat").alias("m_lat"),
        F.col("lon").alias("m_lon"),
    )
    # Only events near a main shock are shuffled. A main shock cannot be its own
    # aftershock: an aftershock is strictly later.
    where = (("time", "lat", "lon"), ("mainshock_time", "m_lat", "m_lon"))
    later = quakes.filter(F.col("magnitude") >= completeness).select("time", "lat", "lon", "magnitude")
    near = within_reach(later, mains, km, days, *where)
    counts = follow_counts(
        near, mains, km, days, *where, "magnitude", "mainshock_mag", "mainshock_id", "aftershocks", "max_aftershock_mag"
    )
    per_day = mains.drop("m_lat", "m_lon").join(counts, "mainshock_id").withColumn(
        "max_aftershock_mag", round_if("max_aftershock_mag", 1, rounding)
    )
    # At most ``days`` + 1 rows per main shock reach this window.
    return per_day.withColumn("sequence_total", group_total("aftershocks", ["mainshock_id"]))


def _cities(t: Tables, *cols: str) -> DataFrame:
    return t["dim_locations"].select(
        F.col("id").alias("location_id"),
        F.col("lat").alias("city_lat"),
        F.col("lon").alias("city_lon"),
        F.col("timezone").alias("city_zone"),
        *cols,
    )


def gold_quakes_near_city(t: Tables, rounding: bool = True, km: float = NEAR_KM) -> DataFrame:
    """(city, event) pairs within reach, with distance and local time."""
    cities = _cities(t, F.col("name").alias("location_name"), "country")
    near = geo_join(
        t["silver_earthquakes"], cities, km, ("lat", "lon"), ("city_lat", "city_lon")
    )
    return near.select(
        *("location_id", "location_name", "country", "event_id", "time", "magnitude"),
        *("magnitude_type", "depth_km", "depth_class", "place", "tsunami", "alert"),
        *("significance", "url"),
        round_if("distance_km", 1, rounding).alias("distance_km"),
        "lat",
        "lon",
        local_ts("time", "city_zone").alias("local_time"),
    )


def gold_quake_pressure_test(
    t: Tables, rounding: bool = True, km: float = PRESSURE_KM, min_quakes: int = 30
) -> DataFrame:
    """Daily quakes near a city against pressure and temperature, quiet days kept."""
    r = lambda c, n: round_if(c, n, rounding)
    events = t["silver_earthquakes"].select("time", "lat", "lon")
    near = geo_join(events, _cities(t), km, ("lat", "lon"), ("city_lat", "city_lon"))
    per_day = near.groupBy(
        "location_id", local_date("time", "city_zone").alias("local_date")
    ).agg(F.count(F.lit(1)).alias("quakes"))
    days = (
        t["gold_weather_daily"]
        .filter((F.col("kind") == "observed") & F.col("pressure_msl_mean").isNotNull())
        .select("location_id", "local_date", "pressure_msl_mean", "temp_mean")
    )
    joined = left_zero(days, per_day, ["location_id", "local_date"], "quakes")
    stats = with_total(
        joined,
        "location_id",
        [
            F.count(F.lit(1)).alias("n_days"),
            F.sum("quakes").alias("total_quakes"),
            r(share_pct(F.col("quakes") > 0), 1).alias("pct_days_with_quake"),
            r(safe_corr("quakes", "pressure_msl_mean"), 4).alias("r_pressure"),
            r(safe_corr("quakes", "temp_mean"), 4).alias("r_temperature"),
        ],
        total="POOLED",
    )
    enough = (F.col("total_quakes") >= min_quakes) | (F.col("location_id") == "POOLED")
    threshold = F.lit(1.96) / F.sqrt(F.col("n_days").cast("double"))
    return stats.filter(enough).select(
        "*",
        r(threshold, 4).alias("r_significance_threshold"),
        (F.abs("r_pressure") > threshold).alias("pressure_significant"),
        r(F.lit(100.0) * F.col("r_pressure") * F.col("r_pressure"), 4).alias("pct_variance_explained"),
    )


def gold_aftershock_forecast(
    t: Tables,
    rounding: bool = True,
    main_magnitude: float = MAIN_MAGNITUDE,
    km: float = SEQUENCE_KM,
    quiet_days: int = DECLUSTER_DAYS,
) -> DataFrame:
    """First-day count and the count of days 2 to 8 per independent main shock."""
    mains = _mains(t["silver_earthquakes"], main_magnitude).select(
        "event_id", "time", "magnitude", "lat", "lon", "place", "depth_km"
    )
    independent = decluster(mains, km, quiet_days)
    day = F.col("day_after")
    counts = t["gold_quake_sequences"].groupBy(F.col("mainshock_id").alias("event_id")).agg(
        sum_if(day == 1, "aftershocks").alias("n1"),
        sum_if(day.between(2, 8), "aftershocks").alias("y_days_2_8"),
    )
    mag = F.col("magnitude")
    # Magnitude bands.
    bands = [(mag >= 8.0, "M8+"), (mag >= 7.5, "M7.5-7.9"), (mag >= 7.0, "M7.0-7.4")]
    return independent.join(counts, "event_id", "left").select(
        F.col("event_id").alias("mainshock_id"),
        F.col("time").alias("mainshock_time"),
        F.col("magnitude").alias("mainshock_mag"),
        *("lat", "lon", "place", "depth_km"),
        F.year("time").alias("year"),
        "n1",
        "y_days_2_8",
        classify(bands, "M6.5-6.9").alias("mag_band"),
        (F.coalesce("n1", F.lit(0)) > 0).alias("is_predictable"),
    )
