"""Silver: clean, de-duplicated tables, one row per natural key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralake.functions import century, classify, first_present, ratio, round_if, safe_date
from terralake.operators.dedup import latest_by
from terralake.operators.reshape import union_named
from terralake.operators.rows import filter_present, filter_valid
from terralake.schemas import WEATHER_VARIABLES

Tables = Mapping[str, DataFrame]
_NEWEST = ["_ingested_at"]
_FILE_COLUMNS = ("_source", "ingest_date")


def _newest(df: DataFrame, *keys: str) -> DataFrame:
    return latest_by(df.drop(*_FILE_COLUMNS), keys, _NEWEST)


def silver_weather_hourly(t: Tables) -> DataFrame:
    """Newest reading per (location, hour, kind); readings without temperature go first."""
    cols = ("location_id", "time", "kind", *WEATHER_VARIABLES, "_ingested_at")
    measured = filter_present(t["bronze_weather"], ["temperature_2m"]).select(*cols)
    return _newest(measured, "location_id", "time", "kind")


def silver_earthquakes(t: Tables) -> DataFrame:
    """Newest valid revision per event.

    Validity is tested before ranking: when the newest revision is a deletion,
    the last valid one stays.
    """
    valid = filter_valid(
        t["bronze_quakes"],
        equals={"event_type": "earthquake"},
        not_equals_or_null={"status": "deleted"},
    )
    valid = filter_present(valid, ["magnitude"]).drop(*_FILE_COLUMNS)
    events = latest_by(valid, ["event_id"], ["updated", "_ingested_at"])
    depth = F.col("depth_km")
    # Depth limits (km) and labels; an unknown depth takes the last label.
    ladder = [(depth < 70, "superficial"), (depth < 300, "intermedio")]
    return events.withColumn("depth_class", classify(ladder, "profundo"))


def silver_bird_observations(t: Tables) -> DataFrame:
    valid = filter_valid(t["bronze_birds"], flags=["obs_valid"])
    return _newest(valid, "checklist_id", "species_code", "location_id")


def silver_historical_disasters(t: Tables) -> DataFrame:
    """Three hazard archives as one table; ids repeat between archives."""
    hazards = union_named(
        [t["bronze_noaa_eq"], t["bronze_noaa_tsunami"], t["bronze_noaa_volcano"]]
    )
    newest = filter_present(_newest(hazards, "hazard_type", "source_id"), ["year"])
    month, day = F.col("month"), F.col("day")
    precision = [(month.isNull(), "solo año"), (day.isNull(), "año y mes")]
    deaths = first_present("deaths_total", "deaths")
    return newest.withColumns(
        {
            "event_date": safe_date("year", month, day),
            "date_precision": classify(precision, "fecha completa"),
            "century": century("year"),
            "deaths_best": deaths,
            "deaths_order_best": first_present("deaths_order_total", "deaths_order"),
            "has_exact_deaths": deaths.isNotNull(),
        }
    )


def silver_epidemics(t: Tables, rounding: bool = True, as_of: str | None = None) -> DataFrame:
    """Curated epidemics with duration, midpoint and width of the estimate."""
    newest = _newest(t["bronze_epidemics"], "id")
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    low, high = F.col("deaths_low"), F.col("deaths_high")
    width = F.when(low > 0, ratio(high, low))
    return newest.withColumns(
        {
            "ongoing": F.col("end_year").isNull(),
            "duration_years": F.coalesce("end_year", F.year(today)) - F.col("start_year") + 1,
            "deaths_mid": (low + high) / F.lit(2.0),
            "deaths_uncertainty_ratio": round_if(width, 2, rounding),
            "century": century("start_year"),
        }
    )


def silver_cyclone_tracks(t: Tables) -> DataFrame:
    """Newest point per (storm, time), then main tracks only.

    Synoptic points (00, 06, 12, 18 h) make basins comparable: some report every
    three hours.
    """
    newest = _newest(t["bronze_cyclones"], "sid", "time")
    main = filter_valid(newest, equals={"track_type": "main"})
    wind = first_present("usa_wind_kt", "wmo_wind_kt")
    synoptic = F.hour("time").isin(0, 6, 12, 18) & (F.minute("time") == 0)
    # Tropical-storm and hurricane force in knots.
    return main.withColumns(
        {
            "is_synoptic": synoptic,
            "wind_kt": wind,
            "pressure_mb": first_present("usa_pressure_mb", "wmo_pressure_mb"),
            "is_tropical_storm": wind >= 34,
            "is_hurricane": wind >= 64,
        }
    )


def silver_population(t: Tables) -> DataFrame:
    """Countries and marked aggregates; a newest row without a value drops the year."""
    return filter_present(_newest(t["bronze_population"], "country_id", "year"), ["population"])


def silver_oni(t: Tables) -> DataFrame:
    """El Niño index with its phase and strength. Seasons overlap: never sum them."""
    newest = _newest(t["bronze_oni"], "year", "season")
    a = F.col("anomaly_c")
    # Official limits (degrees) and labels of the phases and strengths.
    phase = [(a >= 0.5, "El Niño"), (a <= -0.5, "La Niña")]
    strength = [
        (a >= 2.0, "El Niño muy fuerte"),
        (a >= 1.5, "El Niño fuerte"),
        (a >= 1.0, "El Niño moderado"),
        (a >= 0.5, "El Niño débil"),
        (a <= -1.5, "La Niña fuerte"),
        (a <= -1.0, "La Niña moderada"),
        (a <= -0.5, "La Niña débil"),
    ]
    return newest.withColumns(
        {"phase": classify(phase, "Neutral"), "intensity": classify(strength, "Neutral")}
    )


def silver_historical_events(t: Tables) -> DataFrame:
    newest = _newest(t["bronze_events"], "id")
    end = F.col("end_year")
    return newest.withColumns(
        {
            "duration_years": F.coalesce(end, "start_year") - F.col("start_year"),
            "is_point_event": end.isNull(),
        }
    )
