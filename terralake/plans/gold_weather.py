"""Gold: daily weather, normals, anomalies and the heat models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralake.functions import (
    brier,
    classify,
    gain_pct,
    indicator,
    local_date,
    mean_if,
    quantile,
    quantiles,
    ratio,
    round_if,
    skill,
    smoothed_rate,
)
from terralake.operators.aggregates import quantiles_by, with_total
from terralake.operators.joins import circular_window, join_dim, with_scalar
from terralake.operators.rows import having
from terralake.operators.windows import lag_by, moving_mean
from terralake.plans.silver import Tables

# Closed reference period, training period, test period.
BASELINE = ("2006-01-01", "2020-12-31")
TRAINING = ("2006-01-01", "2018-12-31")
HALF_WINDOW_DAYS = 7


def _observed(daily: DataFrame) -> DataFrame:
    return daily.filter(F.col("kind") == "observed")


def _dates(first: str, last: str) -> Column:
    return F.col("local_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def gold_weather_daily(t: Tables, rounding: bool = True, min_hours: int = 20) -> DataFrame:
    """Weather by local day: a UTC day would cut Tokyo's day in two."""
    r = lambda c, n: round_if(c, n, rounding)
    zones = t["dim_locations"].select("id", "timezone")
    hourly = join_dim(t["silver_weather_hourly"], zones, "location_id", "id")
    by_day = hourly.groupBy(
        "location_id", local_date("time", "timezone").alias("local_date"), "kind"
    )
    temp = F.col("temperature_2m")
    daily = by_day.agg(
        F.count(F.lit(1)).alias("hours"),
        r(F.avg(temp), 2).alias("temp_mean"),
        r(F.min(temp), 2).alias("temp_min"),
        r(F.max(temp), 2).alias("temp_max"),
        r(F.max(temp) - F.min(temp), 2).alias("temp_range"),
        r(F.min("apparent_temperature"), 2).alias("apparent_min"),
        r(F.max("apparent_temperature"), 2).alias("apparent_max"),
        r(F.sum("precipitation"), 2).alias("precip_sum"),
        r(F.avg("pressure_msl"), 2).alias("pressure_msl_mean"),
        r(F.min("pressure_msl"), 2).alias("pressure_msl_min"),
        r(F.avg("surface_pressure"), 2).alias("surface_pressure_mean"),
        r(F.avg("relative_humidity_2m"), 1).alias("humidity_mean"),
        r(F.avg("cloud_cover"), 1).alias("cloud_cover_mean"),
        r(F.max("wind_gusts_10m"), 1).alias("wind_gust_max"),
        r(F.sum("shortwave_radiation"), 1).alias("radiation_sum"),
    )
    return having(daily, "hours", min_hours)


def gold_climatology(
    t: Tables,
    rounding: bool = True,
    baseline: tuple[str, str] = BASELINE,
    half_window: int = HALF_WINDOW_DAYS,
) -> DataFrame:
    """Normals by calendar day over a circular window of days.

    Each day is copied to the days it counts for and grouped on equal keys. There
    is one row per location and date here, so a group holds (years x window) rows
    however large the hourly input is.
    """
    r = lambda c, n: round_if(c, n, rounding)
    days = _observed(t["gold_weather_daily"]).filter(_dates(*baseline))
    days = days.select(
        "location_id",
        F.dayofyear("local_date").alias("doy"),
        *("temp_mean", "temp_min", "temp_max", "precip_sum"),
    )
    grouped = circular_window(days, "doy", half_window).groupBy("location_id", "doy")
    stats = grouped.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("temp_mean").alias("mean_avg"),
        F.stddev_samp("temp_mean").alias("mean_sd"),
        quantiles("temp_mean", [0.05, 0.95]).alias("mean_q"),
        F.avg("temp_max").alias("max_avg"),
        quantile("temp_max", 0.95).alias("max_p95"),
        F.max("temp_max").alias("max_record"),
        F.avg("temp_min").alias("min_avg"),
        quantile("temp_min", 0.05).alias("min_p05"),
        F.min("temp_min").alias("min_record"),
        F.avg("precip_sum").alias("precip"),
    )
    return stats.select(
        "location_id",
        "doy",
        "n_samples",
        r("mean_avg", 2).alias("temp_mean_avg"),
        r("mean_sd", 2).alias("temp_mean_sd"),
        r(F.col("mean_q")[0], 2).alias("temp_mean_p05"),
        r(F.col("mean_q")[1], 2).alias("temp_mean_p95"),
        r("max_avg", 2).alias("temp_max_avg"),
        r("max_p95", 2).alias("temp_max_p95"),
        r("max_record", 2).alias("temp_max_record"),
        r("min_avg", 2).alias("temp_min_avg"),
        r("min_p05", 2).alias("temp_min_p05"),
        r("min_record", 2).alias("temp_min_record"),
        r("precip", 2).alias("precip_avg"),
    )


def gold_temperature_anomaly(
    t: Tables, rounding: bool = True, baseline: tuple[str, str] = BASELINE
) -> DataFrame:
    """Each day against the normal of its calendar day."""
    r = lambda c, n: round_if(c, n, rounding)
    days = t["gold_weather_daily"].withColumn("doy", F.dayofyear("local_date"))
    normal = t["gold_climatology"].select(
        "location_id",
        "doy",
        F.col("temp_mean_avg").alias("clim_mean"),
        F.col("temp_mean_sd").alias("clim_sd"),
        F.col("temp_max_p95").alias("clim_max_p95"),
        F.col("temp_max_record").alias("clim_max_record"),
        F.col("temp_min_p05").alias("clim_min_p05"),
        F.col("temp_min_record").alias("clim_min_record"),
        F.col("precip_avg").alias("clim_precip_avg"),
        F.col("n_samples").alias("clim_n_samples"),
    )
    gap = F.col("temp_mean") - F.col("clim_mean")
    joined = days.join(normal, ["location_id", "doy"])
    return joined.select(
        "location_id",
        "local_date",
        "kind",
        "doy",
        "temp_mean",
        "clim_mean",
        r(gap, 2).alias("anomaly_c"),
        r(F.when(F.col("clim_sd") > 0, ratio(gap, "clim_sd")), 2).alias("z_score"),
        "temp_max",
        "clim_max_p95",
        "clim_max_record",
        (F.col("temp_max") > F.col("clim_max_p95")).alias("extreme_heat"),
        (F.col("temp_max") > F.col("clim_max_record")).alias("record_heat"),
        "temp_min",
        "clim_min_p05",
        "clim_min_record",
        (F.col("temp_min") < F.col("clim_min_p05")).alias("extreme_cold"),
        (F.col("temp_min") < F.col("clim_min_record")).alias("record_cold"),
        "precip_sum",
        "clim_precip_avg",
        "clim_n_samples",
        _dates(*baseline).alias("in_baseline"),
    )


def gold_heatwave_features(
    t: Tables,
    rounding: bool = True,
    training: tuple[str, str] = TRAINING,
    half_window: int = HALF_WINDOW_DAYS,
) -> DataFrame:
    """Predictors a week ahead and the target, with thresholds from training days only."""
    r = lambda c, n: round_if(c, n, rounding)
    days = _observed(t["gold_weather_daily"]).select(
        "location_id", "local_date", "temp_max", "temp_mean", F.dayofyear("local_date").alias("doy")
    )
    trained = (
        circular_window(days.filter(_dates(*training)), "doy", half_window)
        .groupBy("location_id", "doy")
        .agg(
            quantile("temp_max", 0.95).alias("temp_max_p95_train"),
            F.avg("temp_mean").alias("temp_mean_avg_train"),
        )
    )
    anomalies = days.join(trained, ["location_id", "doy"]).withColumn(
        "anomaly", F.col("temp_mean") - F.col("temp_mean_avg_train")
    )
    series = (["location_id"], ["local_date"])
    lagged = anomalies.withColumns(
        {
            "lag7": lag_by("anomaly", 7, *series),
            "mean14": moving_mean("anomaly", -20, -7, *series),
            "max_lag7": lag_by("temp_max", 7, *series),
            "year": F.year("local_date"),
            "month": F.month("local_date"),
        }
    )
    for needed in ("lag7", "mean14", "temp_max_p95_train"):
        lagged = lagged.filter(F.col(needed).isNotNull())
    # The index is stored per overlapping season; its position stands for the month.
    oni = t["silver_oni"].select(
        F.col("year").cast("int").alias("year"),
        F.col("season_index").cast("int").alias("month"),
        F.col("anomaly_c").alias("oni"),
        F.col("phase").alias("enso_phase"),
    )
    return lagged.join(oni, ["year", "month"], "left").select(
        "location_id",
        "local_date",
        "doy",
        "year",
        (F.col("temp_max") > F.col("temp_max_p95_train")).alias("is_extreme"),
        "temp_max",
        "temp_max_p95_train",
        r("lag7", 2).alias("anomaly_lag7"),
        r("mean14", 2).alias("anomaly_mean_14d"),
        r("max_lag7", 2).alias("temp_max_lag7"),
        r("oni", 2).alias("oni_anomaly"),
        "enso_phase",
        (F.col("local_date") <= F.lit(training[1]).cast("date")).alias("in_train"),
    )


def _buckets(features: DataFrame) -> DataFrame:
    a = F.col("anomaly_mean_14d")
    # Bucket limits (degrees) and labels.
    ladder = [
        (a < -1, "1. muy fría (<-1)"),
        (a < 0, "2. fría (-1 a 0)"),
        (a < 1, "3. normal (0 a 1)"),
        (a < 2, "4. cálida (1 a 2)"),
    ]
    return features.withColumns(
        {
            "anomaly_bucket": classify(ladder, "5. muy cálida (>2)"),
            "enso_bucket": F.coalesce("enso_phase", F.lit("Neutral")),
        }
    )


def gold_heatwave_model(t: Tables, rounding: bool = True) -> DataFrame:
    """Smoothed frequency of extreme days per (anomaly bucket, phase), training days."""
    r = lambda c, n: round_if(c, n, rounding)
    train = _buckets(t["gold_heatwave_features"].filter("in_train"))
    cells = train.groupBy("anomaly_bucket", "enso_bucket").agg(
        F.count(F.lit(1)).alias("n_train"),
        F.count_if("is_extreme").alias("n_extreme"),
        smoothed_rate("is_extreme").alias("p"),
    )
    # The base rate follows from the cells: features are not read a second time.
    totals = cells.agg(ratio(F.sum("n_extreme"), F.sum("n_train")))
    based = with_scalar(cells, totals, "base")
    return based.select(
        "anomaly_bucket",
        "enso_bucket",
        "n_train",
        "n_extreme",
        r("p", 4).alias("p_extreme"),
        r("base", 4).alias("base_rate"),
        r(ratio("p", "base"), 2).alias("lift"),
    )


def gold_heatwave_backtest(t: Tables, rounding: bool = True) -> DataFrame:
    """Test days scored with the trained cells, per location and pooled.

    Test days whose cell was never trained have no forecast and drop out.
    """
    r = lambda c, n: round_if(c, n, rounding)
    test = _buckets(t["gold_heatwave_features"].filter(~F.col("in_train")))
    model = t["gold_heatwave_model"].select("anomaly_bucket", "enso_bucket", "p_extreme", "base_rate")
    scored = test.join(model, ["anomaly_bucket", "enso_bucket"]).withColumn(
        "y", indicator("is_extreme")
    )
    metrics = with_total(
        scored,
        "location_id",
        [
            F.count(F.lit(1)).alias("n_test"),
            F.count_if("is_extreme").alias("n_extreme"),
            r(mean_if("is_extreme"), 4).alias("observed_rate"),
            r(brier("p_extreme", "y"), 6).alias("brier_model"),
            r(brier("base_rate", "y"), 6).alias("brier_base"),
        ],
        total="GLOBAL",
        name="scope",
    )
    return metrics.select(
        "*",
        r(skill("brier_model", "brier_base"), 4).alias("brier_skill_score"),
        r(gain_pct("brier_model", "brier_base"), 2).alias("pct_improvement"),
        (F.col("brier_model") < F.col("brier_base")).alias("beats_climatology"),
    )


def gold_heat_threshold_drift(
    t: Tables,
    rounding: bool = True,
    calibration: tuple[int, int] = (2006, 2018),
    recent: tuple[int, int] = (2019, 2025),
) -> DataFrame:
    """How often a city now exceeds the heat threshold of its calibration years."""
    r = lambda c, n: round_if(c, n, rounding)
    days = (
        _observed(t["gold_weather_daily"])
        .filter(F.col("temp_max").isNotNull())
        .select("location_id", F.year("local_date").alias("yr"), "temp_max", "temp_mean")
    )
    old = days.filter(F.col("yr").between(*calibration))
    threshold = quantiles_by(old, ["location_id"], "temp_max", {"threshold": 0.95})
    spread = old.groupBy("location_id").agg(F.stddev_samp("temp_mean").alias("sd"))
    calibrated = threshold.join(spread, "location_id")

    fresh = days.filter(F.col("yr").between(*recent))
    new = quantiles_by(
        fresh, ["location_id"], "temp_max", {"q": 0.95}, [F.sum("_n").alias("n_recent_days"), F.max("_value").alias("record")]
    )
    counted = fresh.groupBy("location_id", "temp_max").agg(F.count(F.lit(1)).alias("n"))
    above = F.when(F.col("temp_max") > F.col("threshold"), F.col("n")).otherwise(0)
    exceeded = counted.join(threshold, "location_id").groupBy("location_id").agg(F.sum(above).alias("n_exceeded"))
    now = new.join(calibrated, "location_id").join(exceeded, "location_id")
    share = F.lit(100.0) * ratio("n_exceeded", "n_recent_days")
    factor = share / F.lit(5.0)
    # Exceedance factors over the expected 5% and their labels.
    priority = [(factor >= 5, "1. urgente"), (factor >= 3, "2. alta"), (factor >= 1.8, "3. media")]
    places = t["dim_locations"].select(
        F.col("id").alias("location_id"), F.col("name").alias("location_name"), "country", "koppen", "lat"
    )
    return now.join(places, "location_id").select(
        "location_id",
        "location_name",
        "country",
        "koppen",
        r(F.abs("lat"), 1).alias("abs_lat"),
        r("threshold", 1).alias("threshold_2006_2018"),
        r("q", 1).alias("threshold_2019_2025"),
        r(F.col("q") - F.col("threshold"), 2).alias("threshold_drift_c"),
        "n_recent_days",
        "n_exceeded",
        r(share, 1).alias("pct_exceeded_now"),
        F.lit(5.0).alias("pct_expected"),
        r(factor, 1).alias("amplification"),
        F.round(F.lit(365 * 0.05)).alias("days_per_year_expected"),
        F.round(F.lit(365.0) * ratio("n_exceeded", "n_recent_days")).alias("days_per_year_now"),
        r("sd", 2).alias("temp_variability_sd"),
        r("record", 1).alias("temp_max_record"),
        classify(priority, "4. baja").alias("recalibration_priority"),
    )
