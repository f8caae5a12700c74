"""Gold: cyclones, seasons, city passages, El Niño effects, world population."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralake.functions import (
    ace,
    greatest_text,
    hours_crossed,
    least_text,
    local_date,
    ratio,
    round_if,
    round_to_long,
    safe_corr,
    value_at_min,
)
from terralake.operators.dedup import latest_by, value_by
from terralake.operators.geo import geo_join
from terralake.operators.joins import bracket, join_dim
from terralake.operators.reshape import union_named
from terralake.plans.silver import Tables

# Radius of a city passage (km), satellite-era seasons, basins of
# the northern hemisphere, season of the index that decides a year's phase.
PASSAGE_KM = 500
SEASONS = (1980, 2024)
NORTHERN = ("NA", "EP", "WP", "NI")
PHASE_SEASON = "ASO"


def gold_cyclones(t: Tables, rounding: bool = True) -> DataFrame:
    """One row per storm. The peak is the earliest point of highest wind."""
    points = t["silver_cyclone_tracks"]
    wind = F.col("wind_kt")
    # Numbers by storm and labels first, in hash aggregates; a storm has few labels.
    by_labels = points.groupBy("sid", "basin", "subbasin", "name").agg(
        F.min("season").alias("season"),
        F.min("time").alias("first_seen"),
        F.max("time").alias("last_seen"),
        F.count(F.lit(1)).alias("track_points"),
        F.max(wind).alias("max_wind_kt"),
        F.min("pressure_mb").alias("min_pressure_mb"),
        F.max("usa_sshs").alias("max_category"),
        ace(wind, "is_synoptic").alias("ace"),
        F.bool_or("is_tropical_storm").alias("reached_tropical_storm"),
        F.bool_or("is_hurricane").alias("reached_hurricane"),
        F.bool_or(F.col("usa_sshs") >= 3).alias("reached_major_hurricane"),
        F.bool_or(F.col("dist2land_km") == 0).alias("made_landfall"),
        F.min("dist2land_km").alias("min_dist_to_land_km"),
    )
    storms = by_labels.groupBy("sid").agg(
        F.min("season").alias("season"),
        least_text("basin").alias("basin"),
        least_text("subbasin").alias("subbasin"),
        greatest_text("name").alias("name"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("track_points").alias("track_points"),
        F.max("max_wind_kt").alias("max_wind_kt"),
        F.min("min_pressure_mb").alias("min_pressure_mb"),
        F.max("max_category").alias("max_category"),
        round_if(F.sum("ace"), 4, rounding).alias("ace"),
        *(F.bool_or(c).alias(c) for c in ("reached_tropical_storm", "reached_hurricane", "reached_major_hurricane", "made_landfall")),
        F.min("min_dist_to_land_km").alias("min_dist_to_land_km"),
    )
    place = points.filter(wind.isNotNull()).select("sid", "wind_kt", "time", F.struct("lat", "lon", "time").alias("at"))
    peaks = value_by(place, ["sid"], "at", [-F.col("wind_kt"), F.col("time")], "peak")
    storms = storms.join(peaks, "sid", "left")
    days = hours_crossed("first_seen", "last_seen") / F.lit(24.0)
    return storms.select(
        *("sid", "season", "basin", "subbasin", "name", "first_seen", "last_seen"),
        round_if(days, 2, rounding).alias("duration_days"),
        *("track_points", "max_wind_kt", "min_pressure_mb", "max_category", "ace"),
        *("reached_tropical_storm", "reached_hurricane", "reached_major_hurricane"),
        *("made_landfall", "min_dist_to_land_km"),
        F.col("peak.lat").alias("peak_lat"),
        F.col("peak.lon").alias("peak_lon"),
        F.col("peak.time").alias("peak_time"),
    )


def gold_cyclone_seasons(t: Tables, rounding: bool = True) -> DataFrame:
    r = lambda c, n: round_if(c, n, rounding)
    storms = t["gold_cyclones"].filter(F.col("basin").isNotNull())
    return storms.groupBy("season", "basin").agg(
        F.count(F.lit(1)).alias("systems"),
        F.count_if("reached_tropical_storm").alias("tropical_storms"),
        F.count_if("reached_hurricane").alias("hurricanes"),
        F.count_if("reached_major_hurricane").alias("major_hurricanes"),
        F.count_if("made_landfall").alias("landfalling"),
        r(F.sum("ace"), 2).alias("ace_total"),
        r(F.avg("ace"), 3).alias("ace_mean_per_system"),
        F.max("max_wind_kt").alias("strongest_wind_kt"),
        F.min("min_pressure_mb").alias("lowest_pressure_mb"),
        r(F.avg("duration_days"), 2).alias("mean_duration_days"),
    )


def gold_cyclones_near_city(t: Tables, rounding: bool = True, km: float = PASSAGE_KM) -> DataFrame:
    """Storms that passed a city, with their state at the closest approach.

    Each measure is taken at the closest point that has it: agencies leave gaps.
    """
    cities = t["dim_locations"].select(
        F.col("id").alias("location_id"),
        F.col("name").alias("location_name"),
        F.col("lat").alias("city_lat"),
        F.col("lon").alias("city_lon"),
    )
    points = t["silver_cyclone_tracks"].select(
        "sid", "time", "lat", "lon", "wind_kt", "pressure_mb", "usa_sshs"
    )
    near = geo_join(points, cities, km, ("lat", "lon"), ("city_lat", "city_lon"))
    first = F.col("time")
    closest = lambda c: value_at_min(c, "distance_km", first)
    passages = near.groupBy("location_id", "location_name", "sid").agg(
        F.min("distance_km").alias("min_distance_km"),
        closest("time").alias("closest_time"),
        closest("wind_kt").alias("wind_at_closest_kt"),
        closest("pressure_mb").alias("pressure_at_closest_mb"),
        closest("usa_sshs").alias("category_at_closest"),
    )
    storms = t["gold_cyclones"].select(
        "sid",
        F.col("name").alias("storm_name"),
        *("season", "basin"),
        F.col("max_wind_kt").alias("storm_max_wind_kt"),
        F.col("max_category").alias("storm_max_category"),
        F.col("ace").alias("storm_ace"),
    )
    zones = t["dim_locations"].select("id", "timezone")
    joined = join_dim(passages.join(storms, "sid"), zones, "location_id", "id")
    return joined.select(
        *("location_id", "location_name", "sid", "storm_name", "season", "basin"),
        *("min_distance_km", "closest_time", "wind_at_closest_kt", "pressure_at_closest_mb"),
        *("category_at_closest", "storm_max_wind_kt", "storm_max_category", "storm_ace"),
        local_date("closest_time", "timezone").alias("local_date"),
    )


def gold_enso_cyclones(
    t: Tables,
    rounding: bool = True,
    basins: tuple[str, ...] = NORTHERN,
    seasons: tuple[int, int] = SEASONS,
) -> DataFrame:
    """Cyclone activity by basin and phase; the correlation is inside each cell."""
    r = lambda c, n: round_if(c, n, rounding)
    phase = t["silver_oni"].filter(F.col("season") == PHASE_SEASON)
    phase = phase.select("year", "anomaly_c", "phase")
    activity = t["gold_cyclone_seasons"].filter(
        F.col("basin").isin(*basins) & F.col("season").between(*seasons)
    )
    activity = activity.withColumnRenamed("season", "year")
    return activity.join(phase, "year").groupBy("basin", "phase").agg(
        F.count(F.lit(1)).alias("seasons"),
        r(F.avg("ace_total"), 1).alias("ace_mean"),
        r(F.avg("hurricanes"), 1).alias("hurricanes_mean"),
        r(F.avg("major_hurricanes"), 1).alias("major_hurricanes_mean"),
        r(F.avg("systems"), 1).alias("systems_mean"),
        r(safe_corr("anomaly_c", "ace_total"), 3).alias("r_oni_vs_ace"),
    )


def gold_world_population(t: Tables, rounding: bool = True, world: str = "WLD") -> DataFrame:
    """Yearly world population: interpolated anchors, then official statistics.

    The first official year is an anchor too. The spine is exploded from the
    anchors' own year range, so nothing is read back to the driver.
    """
    official = t["silver_population"].filter(F.col("country_id") == world)
    official = official.select("year", "population")
    curated = latest_by(
        t["bronze_world_population"].drop("_source", "ingest_date"), ["year"], ["_ingested_at"]
    ).select("year", "population_low", "population_high", "confidence")
    first_year = official.select(F.min("year").alias("year"))
    first = official.join(first_year, "year").select(
        "year",
        F.col("population").alias("population_low"),
        F.col("population").alias("population_high"),
        F.lit("alta").alias("confidence"),
    )
    anchors = curated.unionByName(first)
    start = anchors.agg(F.min("year").alias("lo"))
    stop = first_year.withColumnRenamed("year", "hi")
    years = start.withColumn("hi", stop.scalar()).select(
        F.explode(
            F.when(F.col("lo") <= F.col("hi") - 1, F.sequence("lo", F.col("hi") - 1))
        ).alias("year")
    )
    # Years after the last interpolated one still serve as upper anchors.
    base = years.withColumn("wanted", F.lit(True)).unionByName(
        anchors.select("year", F.lit(False).alias("wanted"))
    )
    base = base.groupBy("year").agg(F.bool_or("wanted").alias("wanted"))
    cols = ["population_low", "population_high", "confidence"]
    spans = bracket(base, anchors, "year", cols).filter("wanted")
    offset = F.col("year") - F.col("lo_year")
    width = F.col("hi_year") - F.col("lo_year")

    def between(c: str):
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        return F.when(width == 0, lo.cast("double")).otherwise(
            lo + (hi - lo) * ratio(offset, width)
        )

    estimated = spans.select(
        "year",
        between("population_low").alias("low"),
        between("population_high").alias("high"),
        (width == 0).alias("is_anchor"),
        F.col("lo_confidence").alias("confidence"),
    ).select(
        "year",
        round_to_long("low").alias("population_low"),
        round_to_long("high").alias("population_high"),
        round_to_long((F.col("low") + F.col("high")) / F.lit(2.0)).alias("population_mid"),
        round_if(ratio("high", "low"), 3, rounding).alias("uncertainty_ratio"),
        "is_anchor",
        "confidence",
        F.lit("estimación histórica").alias("source_kind"),
    )
    people = F.col("population")
    counted = official.select(
        "year",
        people.alias("population_low"),
        people.alias("population_high"),
        people.alias("population_mid"),
        F.lit(1.0).alias("uncertainty_ratio"),
        F.lit(True).alias("is_anchor"),
        F.lit("alta").alias("confidence"),
        F.lit("Banco Mundial").alias("source_kind"),
    )
    return union_named([estimated, counted])
