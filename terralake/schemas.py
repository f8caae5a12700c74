"""Bronze schemas: one per dataset, used to read files and to type empty sources.

Columns are matched by name, so a file that lacks some of them reads as NULL.
NULL means "not asked for" or "not counted", never zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

WEATHER_VARIABLES = (
    "temperature_2m",
    "apparent_temperature",
    "relative_humidity_2m",
    "dew_point_2m",
    "precipitation",
    "rain",
    "snowfall",
    "pressure_msl",
    "surface_pressure",
    "cloud_cover",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
    "shortwave_radiation",
)
MONTH_COLUMNS = tuple(f"m{m:02d}" for m in range(1, 13))

_TYPES = {
    "s": T.StringType(),
    "d": T.DoubleType(),
    "l": T.LongType(),
    "b": T.BooleanType(),
    "t": T.TimestampType(),
    "n": T.TimestampNTZType(),
}


def _struct(*groups: tuple[str, str]) -> T.StructType:
    """Fields from (type code, space-separated names) groups."""
    return T.StructType(
        [T.StructField(n, _TYPES[code]) for code, names in groups for n in names.split()]
    )


WEATHER = _struct(
    ("s", "location_id"),
    ("d", "lat lon"),
    ("t", "time"),
    ("s", "kind"),
    ("d", " ".join(WEATHER_VARIABLES)),
)
EARTHQUAKES = _struct(
    ("s", "event_id"),
    ("t", "time updated"),
    ("d", "magnitude"),
    ("s", "magnitude_type"),
    ("d", "lat lon depth_km"),
    ("s", "place event_type"),
    ("b", "tsunami"),
    ("l", "significance"),
    ("s", "alert status"),
    ("l", "felt"),
    ("d", "cdi mmi"),
    ("s", "network url"),
)
BIRDS = _struct(
    ("s", "location_id"),
    ("l", "search_radius_km"),
    ("s", "species_code common_name scientific_name"),
    ("n", "obs_datetime"),
    ("b", "obs_date_only"),
    ("l", "how_many"),
    ("d", "lat lon"),
    ("s", "loc_id loc_name"),
    ("b", "obs_valid obs_reviewed"),
    ("s", "checklist_id"),
)
HAZARDS = _struct(
    ("l", "source_id"),
    ("s", "hazard_type"),
    ("l", "year month day hour minute"),
    ("d", "latitude longitude"),
    ("s", "country location_name"),
    ("l", "region_code deaths deaths_order injuries injuries_order"),
    ("d", "damage_musd"),
    ("l", "damage_order houses_destroyed deaths_total deaths_order_total injuries_total"),
    ("d", "damage_musd_total eq_magnitude eq_depth_km eq_intensity tsunami_max_water_height_m"),
    ("l", "tsunami_num_runups volcano_vei"),
    ("s", "volcano_name"),
    ("d", "volcano_elevation_m"),
    ("s", "volcano_morphology"),
    ("l", "caused_earthquake_id caused_tsunami_id"),
    ("b", "published"),
)
EPIDEMICS = _struct(
    ("s", "id name pathogen disease"),
    ("l", "start_year end_year deaths_low deaths_high"),
    ("s", "regions estimate_confidence source note"),
)
TRACKS = _struct(
    ("s", "sid"),
    ("l", "season number"),
    ("s", "basin subbasin name"),
    ("t", "time"),
    ("s", "nature track_type"),
    ("d", "lat lon wmo_wind_kt wmo_pressure_mb"),
    ("s", "wmo_agency"),
    ("d", "usa_wind_kt usa_pressure_mb"),
    ("l", "usa_sshs"),
    ("d", "dist2land_km landfall_km storm_speed_kt storm_dir_deg"),
)
POPULATION = _struct(
    ("s", "country_id country_name iso2"),
    ("l", "year population"),
    ("b", "is_aggregate"),
    ("s", "region income_level"),
)
WORLD_POPULATION = _struct(
    ("l", "year population_low population_high"),
    ("s", "confidence source note"),
)
ONI = _struct(("l", "year"), ("s", "season"), ("l", "season_index"), ("d", "sst_c anomaly_c"))
MILESTONES = _struct(
    ("s", "id name category"), ("l", "start_year end_year"), ("s", "description relevance")
)
PHENOLOGY = _struct(
    ("l", "species_key"),
    ("s", "species_name common_name location_id"),
    ("d", "bbox_degrees"),
    ("b", "is_control"),
    ("l", "year total_records"),
    ("l", " ".join(MONTH_COLUMNS)),
)
LOCATIONS = _struct(
    ("s", "id name country"),
    ("d", "lat lon"),
    ("s", "timezone koppen"),
    ("l", "seismic_level"),
    ("s", "flyway"),
)
PROVENANCE = _struct(("t", "_ingested_at"), ("s", "_source ingest_date"))


@dataclass(frozen=True)
class Dataset:
    """Where a bronze dataset lies and what its rows look like."""

    source: str
    name: str
    schema: T.StructType


# Bronze folder (source, dataset) of every table the models read.
DATASETS = {
    "bronze_weather": Dataset("open_meteo", "weather_hourly", WEATHER),
    "bronze_quakes": Dataset("usgs", "earthquakes", EARTHQUAKES),
    "bronze_birds": Dataset("ebird", "observations", BIRDS),
    "bronze_noaa_eq": Dataset("noaa", "earthquakes", HAZARDS),
    "bronze_noaa_tsunami": Dataset("noaa", "tsunamis", HAZARDS),
    "bronze_noaa_volcano": Dataset("noaa", "volcanos", HAZARDS),
    "bronze_epidemics": Dataset("curated", "epidemics", EPIDEMICS),
    "bronze_cyclones": Dataset("ibtracs", "track_points", TRACKS),
    "bronze_population": Dataset("worldbank", "population", POPULATION),
    "bronze_world_population": Dataset("curated", "world_population", WORLD_POPULATION),
    "bronze_oni": Dataset("noaa_cpc", "oni", ONI),
    "bronze_events": Dataset("curated", "historical_events", MILESTONES),
    "bronze_phenology": Dataset("gbif", "phenology", PHENOLOGY),
}


def with_provenance(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, *PROVENANCE.fields])
