"""Numbers that charts derive from the tables, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralake.functions import value_at_min
from terralake.operators.joins import with_scalar
from terralake.plans.silver import Tables


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x over rows that have both."""
    return df.agg(
        F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
        F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
        F.regr_count(F.col(y), F.col(x)).alias("n"),
    )


def season_totals(t: Tables) -> DataFrame:
    """Energy and storms per season over all basins, beside their overall mean."""
    totals = t["gold_cyclone_seasons"].groupBy("season").agg(
        F.sum("ace_total").alias("ace"),
        F.sum("hurricanes").alias("hurricanes"),
        F.sum("major_hurricanes").alias("major_hurricanes"),
    )
    # One row per season: the window over everything is a few dozen rows.
    everything = Window.partitionBy(F.lit(1))
    return totals.withColumn("ace_mean", F.avg("ace").over(everything))


def anchored_line(t: Tables, scope: str = "global") -> DataFrame:
    """Fitted frequency law, anchored on the first bin of the observed curve."""
    bins = t["gold_quake_magnitude_frequency"]
    anchor = bins.agg(
        F.min("mag_bin").alias("m0"), value_at_min("log10_n_cumulative", "mag_bin").alias("y0")
    )
    slope = t["gold_quake_b_value"].filter(F.col("scope") == scope).agg(F.max("b_value"))
    line = with_scalar(bins, slope, "b")
    line = with_scalar(line, anchor.select(F.col("y0")), "y0")
    line = with_scalar(line, anchor.select(F.col("m0")), "m0")
    a = F.col("y0") + F.col("b") * F.col("m0")
    return line.select(
        "mag_bin",
        "log10_n_cumulative",
        (a - F.col("b") * F.col("mag_bin")).alias("log10_n_fitted"),
    )


def overlay_year(t: Tables, location: str) -> DataFrame:
    """The newest year of a place laid over its normal, by calendar day."""
    days = t["gold_weather_daily"].filter(
        (F.col("location_id") == location) & (F.col("kind") == "observed")
    )
    newest = days.agg(F.max(F.year("local_date")))
    current = with_scalar(days, newest, "newest").filter(F.year("local_date") == F.col("newest"))
    current = current.select(
        F.dayofyear("local_date").alias("doy"), F.col("temp_mean").alias("temp_now")
    )
    normal = t["gold_climatology"].filter(F.col("location_id") == location)
    return normal.select("doy", "temp_mean_avg", "temp_mean_p05", "temp_mean_p95").join(
        current, "doy", "left"
    )
