"""Gold: out-of-sample skill of every predictive model, over several cut years.

Training rows end at the cut, test rows start after it. Wherever a statistic is
additive it is reduced to one row per year first, so that the cuts multiply
yearly rows and not days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralake.functions import brier, clamp, gain_pct, indicator, quantiles, ratio, rmse, round_if
from terralake.operators.joins import circular_window, walk_forward
from terralake.operators.reshape import union_named
from terralake.operators.rows import having, tag
from terralake.operators.windows import lag_by
from terralake.plans.silver import Tables

# Cut years, first training year, trend weight, publication gate.
QUAKE_CUTS = (2019, 2020, 2021, 2022, 2023)
HEAT_CUTS = (2012, 2014, 2016, 2018, 2020)
PERSISTENCE_CUTS = (2014, 2016, 2018, 2020)
FIRST_TRAINING_YEAR = 2006
TREND_WEIGHT = 0.05
MIN_TEST_EVENTS = 20
MIN_GAIN_PCT = 5.0


def _slope(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> Column:
    """Least-squares slope from sums."""
    return ratio(n * sxy - sx * sy, n * sxx - sx * sx)


def aftershock_skill(
    t: Tables, cuts: Sequence[int] = QUAKE_CUTS, min_events: int = MIN_TEST_EVENTS
) -> DataFrame:
    """alpha times the first-day count against the mean of the magnitude band."""
    events = t["gold_aftershock_forecast"].filter("is_predictable")
    events = events.select("year", "mag_band", "n1", F.col("y_days_2_8").alias("y"))
    yearly = events.groupBy("year", "mag_band").agg(
        F.sum("y").alias("sum_y"), F.sum("n1").alias("sum_n1"), F.count("y").alias("n_y")
    )
    train, _ = walk_forward(yearly, "year", cuts)
    fit = train.groupBy("cut_year").agg(ratio(F.sum("sum_y"), F.sum("sum_n1")).alias("alpha"))
    band_mean = train.groupBy("cut_year", "mag_band").agg(
        ratio(F.sum("sum_y"), F.sum("n_y")).alias("y_mean")
    )
    _, test = walk_forward(events, "year", cuts)
    scored = test.join(fit, "cut_year").join(band_mean, ["cut_year", "mag_band"])
    skill = scored.groupBy("cut_year").agg(
        F.count(F.lit(1)).alias("n_test"),
        rmse("y", F.col("alpha") * F.col("n1")).alias("value_model"),
        rmse("y", "y_mean").alias("value_baseline"),
    )
    return tag(
        having(skill, "n_test", min_events),
        model_id="pronostico_replicas",
        metric="RMSE replicas dias 2-8",
    )


def heat_skill(
    t: Tables, cuts: Sequence[int] = HEAT_CUTS, first_year: int = FIRST_TRAINING_YEAR
) -> DataFrame:
    """Extreme-heat probability shifted by the local trend against the plain frequency."""
    days = (
        t["gold_weather_daily"]
        .filter((F.col("kind") == "observed") & F.col("temp_max").isNotNull())
        .select(
            "location_id",
            F.year("local_date").alias("yr"),
            F.dayofyear("local_date").alias("doy"),
            "temp_max",
        )
    )
    place = ["cut_year", "location_id"]

    # Threshold and trend from counts per (location, year, temperature).
    counted = days.groupBy("location_id", "yr", "temp_max").agg(F.count(F.lit(1)).alias("n"))
    train, _ = walk_forward(counted, "yr", cuts, first_year)
    x, y, n = F.col("yr") - first_year, F.col("temp_max"), F.col("n")
    fitted = train.groupBy(*place).agg(
        quantiles("temp_max", [0.95], "n").alias("q"),
        _slope(
            F.sum(n), F.sum(n * x), F.sum(n * y), F.sum(n * x * y), F.sum(n * x * x)
        ).alias("b_year"),
    )
    fitted = fitted.select(*place, F.col("q")[0].alias("thr"), "b_year")

    # Frequency by calendar day: sums per day first, then the window over those.
    train_days, test_days = walk_forward(days, "yr", cuts)
    train_days = train_days.filter(F.col("yr") >= first_year)
    hot = F.col("temp_max") > F.col("thr")
    per_doy = train_days.join(fitted, place).groupBy(*place, "doy").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hot).alias("n_hot"), F.sum("yr").alias("s_yr")
    )
    normal = circular_window(per_doy, "doy").groupBy(*place, "doy").agg(
        ratio(F.sum("n_hot"), F.sum("n")).alias("p_base"),
        ratio(F.sum("s_yr"), F.sum("n")).alias("yr_mean"),
    )
    forecast = normal.join(fitted, place)
    scored = test_days.join(forecast, [*place, "doy"]).withColumns(
        {
            "y": indicator(hot),
            "p_trend": clamp(
                F.col("p_base")
                + F.col("b_year") * (F.col("yr") - F.col("yr_mean")) * F.lit(TREND_WEIGHT)
            ),
        }
    )
    skill = scored.groupBy("cut_year").agg(
        F.count(F.lit(1)).alias("n_test"),
        brier("p_trend", "y").alias("value_model"),
        brier("p_base", "y").alias("value_baseline"),
    )
    return tag(skill, model_id="riesgo_calor_corregido", metric="Brier score")


def persistence_skill(
    t: Tables, cuts: Sequence[int] = PERSISTENCE_CUTS, first_year: int = FIRST_TRAINING_YEAR
) -> DataFrame:
    """Anomaly carried over 1 or 7 days against no anomaly.

    Slope and squared error are functions of yearly sums, so the days are read
    and shuffled once, whatever the number of cuts and horizons.
    """
    series = (["location_id"], ["local_date"])
    days = t["gold_temperature_anomaly"].filter(
        (F.col("kind") == "observed") & F.col("anomaly_c").isNotNull()
    )
    days = days.select(
        F.year("local_date").alias("yr"),
        F.col("anomaly_c").alias("a"),
        lag_by("anomaly_c", 1, *series).alias("l1"),
        lag_by("anomaly_c", 7, *series).alias("l7"),
    ).filter(F.col("l1").isNotNull() & F.col("l7").isNotNull())

    def sums(c: str) -> Column:
        a, lagged = F.col("a"), F.col(c)
        return F.struct(
            F.sum(lagged).alias("sx"),
            F.sum(a * lagged).alias("sxy"),
            F.sum(lagged * lagged).alias("sxx"),
        )

    yearly = days.groupBy("yr").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("a").alias("sy"),
        F.sum(F.col("a") * F.col("a")).alias("syy"),
        F.array(
            F.struct(F.lit("persistencia_1d").alias("model_id"), sums("l1").alias("s")),
            F.struct(F.lit("persistencia_7d").alias("model_id"), sums("l7").alias("s")),
        ).alias("h"),
    )
    yearly = yearly.select("yr", "n", "sy", "syy", F.explode("h").alias("h")).select(
        "yr", "n", "sy", "syy", "h.model_id", "h.s.*"
    )
    train, test = walk_forward(yearly, "yr", cuts)
    train = train.filter(F.col("yr") >= first_year)
    keys = ["model_id", "cut_year"]
    total = lambda c: F.sum(c)
    fit = train.groupBy(*keys).agg(
        _slope(total("n"), total("sx"), total("sy"), total("sxy"), total("sxx")).alias("b")
    )
    errors = test.groupBy(*keys).agg(*(total(c).alias(c) for c in ("n", "syy", "sxy", "sxx")))
    b = F.col("b")
    squared = F.col("syy") - 2 * b * F.col("sxy") + b * b * F.col("sxx")
    skill = errors.join(fit, keys).select(
        *keys,
        F.col("n").alias("n_test"),
        F.sqrt(ratio(F.greatest(squared, F.lit(0.0)), "n")).alias("value_model"),
        F.sqrt(ratio("syy", "n")).alias("value_baseline"),
    )
    return tag(skill, metric="RMSE anomalia C")


def gold_model_skill(
    t: Tables,
    rounding: bool = True,
    quake_cuts: Sequence[int] = QUAKE_CUTS,
    heat_cuts: Sequence[int] = HEAT_CUTS,
    persistence_cuts: Sequence[int] = PERSISTENCE_CUTS,
    first_year: int = FIRST_TRAINING_YEAR,
    min_events: int = MIN_TEST_EVENTS,
) -> DataFrame:
    """All models by cut, with the spread over cuts and the publication gate.

    A model is shown only if its median gain is at least 5% and no cut is negative.
    """
    r = lambda c, n: round_if(c, n, rounding)
    cuts = union_named(
        [
            aftershock_skill(t, quake_cuts, min_events),
            heat_skill(t, heat_cuts, first_year),
            persistence_skill(t, persistence_cuts, first_year),
        ]
    )
    gains = cuts.withColumn(
        "improvement_pct", r(gain_pct("value_model", "value_baseline"), 2)
    ).withColumn("scope", F.lit("GLOBAL"))
    # One row per model and cut: a handful of rows per window.
    model = Window.partitionBy("model_id", "scope")
    gain = F.col("improvement_pct")
    median, worst, best = (f(gain).over(model) for f in (F.median, F.min, F.max))
    return gains.select(
        *("model_id", "scope", "cut_year", "metric", "n_test"),
        r("value_model", 5).alias("value_model"),
        r("value_baseline", 5).alias("value_baseline"),
        "improvement_pct",
        r(median, 2).alias("improvement_median"),
        r(worst, 2).alias("improvement_min"),
        r(best, 2).alias("improvement_max"),
        F.count(F.lit(1)).over(model).alias("n_cuts"),
        ((median >= MIN_GAIN_PCT) & (worst > 0)).alias("should_display"),
    )
