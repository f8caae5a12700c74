"""Publish the read queries as JSON folders with a manifest.

One folder per route. Parts of a multi-part query get a sub-folder each; routes
that depend on a place are written once, partitioned by place. The catalogue of
null findings is left out on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralake.operators.rows import order_columns
from terralake.plans import queries as q
from terralake.plans.build import table_path
from terralake.plans.silver import Tables
from terralake.sources.bronze import path_exists

MANIFEST = "manifest"

# Routes and the arguments they are published with.
ROUTES: dict[str, Callable[[Tables], DataFrame | q.Parts]] = {
    "health": q.q_health,
    "locations": q.q_locations,
    "models/skill": q.q_model_skill,
    "patterns/warming": q.q_warming,
    "patterns/gutenberg-richter": q.q_gutenberg_richter,
    "patterns/omori": q.q_omori,
    "patterns/seismic-weather-myth": q.q_seismic_weather_myth,
    "patterns/deadliest": lambda t: q.q_deadliest(t, limit=26),
    "patterns/per-capita": q.q_per_capita,
    "patterns/enso": q.q_enso,
    "disasters": q.q_disasters,
    "disasters/cascades": lambda t: q.q_disaster_cascades(t, limit=12),
    "disasters/by-century": q.q_disasters_by_century,
    "epidemics": q.q_epidemics,
    "cyclones": q.q_cyclones,
    "cyclones/seasons": q.q_cyclone_seasons,
    "birds/summary": q.q_birds_summary,
    "population/world": q.q_world_population,
    "predict/heatwave": q.q_heatwave,
    "predict/aftershocks": q.q_aftershocks,
    "events": q.q_events,
    "sources": lambda t: q.q_sources(t["dim_locations"].sparkSession),
    "prevention/heat-thresholds": q.q_heat_thresholds,
    "panels/coverage": q.q_panel_coverage,
    "panels/year": q.q_year_panel,
    "panels/month": q.q_month_panel,
}


def first_per_place(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows of every place; cut per task before the shuffle."""
    window = Window.partitionBy("location_id").orderBy(*order_columns(order))
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.filter(F.col("_rank") <= limit)


# Rows that the routes of a place are published with.
ANOMALIES_PER_PLACE, BIRD_DAYS_PER_PLACE = 5000, 90


def place_routes(
    t: Tables, anomalies_since: str, anomalies: int = ANOMALIES_PER_PLACE, bird_days: int = BIRD_DAYS_PER_PLACE
) -> dict[str, DataFrame]:
    """The newest rows of every place, as many as asked for."""
    recent = t["gold_temperature_anomaly"].filter(
        F.col("local_date") >= F.lit(anomalies_since).cast("date")
    )
    normals = t["gold_climatology"].withColumn("_rank", F.col("doy"))
    return {
        "weather-anomaly": first_per_place(recent, ["-local_date", "kind"], anomalies),
        "climatology": normals,
        "birds-daily": first_per_place(t["gold_bird_daily"], ["-obs_date"], bird_days),
    }


def _write(df: DataFrame, out: str, route: str, by_place: bool = False) -> int:
    """Write one route and return its number of rows (lines of its files)."""
    path = table_path(out, route)
    if by_place:
        df = df.repartition("location_id").sortWithinPartitions("location_id", "_rank").drop("_rank")
        df.write.mode("overwrite").partitionBy("location_id").json(path)
    else:
        # These routes are limits or yearly, monthly and per-place summaries.
        df.coalesce(1).write.mode("overwrite").json(path)
    return df.sparkSession.read.text(path).count()


def _previous_routes(spark: SparkSession, out: str) -> set[str]:
    if not path_exists(spark, table_path(out, MANIFEST)):
        return set()
    rows = spark.read.schema("route string, rows bigint").json(table_path(out, MANIFEST))
    return {r.route for r in rows.collect()}


def _retire(spark: SparkSession, out: str, routes: set[str]) -> None:
    """Delete the folders of routes that an earlier manifest lists and this one does not."""
    for route in routes:
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path(out, route))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def export_marts(
    spark: SparkSession, t: Tables, out: str, anomalies_since: str = "2025-01-01",
    anomalies: int = ANOMALIES_PER_PLACE, bird_days: int = BIRD_DAYS_PER_PLACE,
) -> DataFrame:
    """Write all routes and the manifest (route, rows); returns the manifest."""
    written: dict[str, int] = {}
    before = _previous_routes(spark, out)
    for route, query in ROUTES.items():
        result = query(t)
        parts = result.items() if isinstance(result, dict) else [("all", result)]
        for part, df in parts:
            name = f"{route}/{part}"
            written[name] = _write(df, out, name)
    for route, df in place_routes(t, anomalies_since, anomalies, bird_days).items():
        written[route] = _write(df, out, route, by_place=True)
    _retire(spark, out, before - set(written))
    manifest = spark.createDataFrame(sorted(written.items()), "route string, rows bigint")
    manifest.coalesce(1).write.mode("overwrite").json(table_path(out, MANIFEST))
    return manifest
