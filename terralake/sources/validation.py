"""Row rules at the edge. Bad rows are split off with the names of broken rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralake.schemas import DATASETS


# Recognised flyways.
FLYWAYS = (
    "atlantico-este",
    "mediterraneo-mar-negro",
    "africa-oriental-asia-occidental",
    "asia-central",
    "asia-oriental-australasia",
    "americas-pacifico",
    "americas-central",
    "americas-misisipi",
    "americas-atlantico",
    "ninguna",
)


def required(c: str) -> Column:
    return F.col(c).isNotNull()


def within(c: str, low: float, high: float) -> Column:
    """In range; a missing value passes."""
    return F.col(c).isNull() | F.col(c).between(low, high)


def one_of(c: str, *values: str) -> Column:
    return F.col(c).isNull() | F.col(c).isin(*values)


def _req(*names: str) -> dict[str, Column]:
    return {f"{n} required": required(n) for n in names}


def _in(low: float, high: float, *names: str) -> dict[str, Column]:
    return {f"{n} in [{low}, {high}]": within(n, low, high) for n in names}


def _enum(c: str, *values: str) -> dict[str, Column]:
    return {f"{c} known": one_of(c, *values)}


def rules_for(table: str) -> dict[str, Column]:
    """Named rules of a bronze table. The ranges and label sets below."""
    levels = ("alta", "media", "baja")
    hazards = {
        **_req("source_id", "hazard_type", "year", "published"),
        **_enum("hazard_type", "earthquake", "tsunami", "volcano"),
        **_in(0, 4, "deaths_order", "injuries_order", "damage_order", "deaths_order_total"),
        **_in(0, 8, "volcano_vei"),
    }
    return {
        "bronze_weather": _req("location_id", "lat", "lon", "time", "kind"),
        "bronze_quakes": _req("event_id", "time", "lat", "lon", "tsunami"),
        "bronze_birds": _req("location_id", "search_radius_km", "species_code", "obs_datetime", "lat", "lon"),
        "bronze_noaa_eq": hazards,
        "bronze_noaa_tsunami": hazards,
        "bronze_noaa_volcano": hazards,
        "bronze_epidemics": {
            **_req("id", "name", "start_year", "regions", "estimate_confidence", "source"),
            **_enum("estimate_confidence", *levels),
        },
        "bronze_cyclones": {
            **_req("sid", "season", "time", "lat", "lon"),
            **_in(-90, 90, "lat"),
            **_in(-180, 180, "lon"),
            **_in(-5, 5, "usa_sshs"),
        },
        "bronze_population": _req("country_id", "country_name", "year", "is_aggregate"),
        "bronze_world_population": {
            **_req("year", "population_low", "population_high", "confidence", "source"),
            **_enum("confidence", *levels),
        },
        "bronze_oni": {
            **_req("year", "season", "season_index", "sst_c", "anomaly_c"),
            **_in(1, 12, "season_index"),
        },
        "bronze_events": {
            **_req("id", "name", "category", "start_year", "description", "relevance"),
            **_enum("category", "guerra", "economia", "tecnologia", "salud", "clima", "observacion"),
        },
        "bronze_phenology": _req(
            "species_key", "species_name", "common_name", "location_id", "bbox_degrees", "year",
            "total_records",
        ),
        "dim_locations": {
            **_req("id", "name", "country", "timezone", "koppen", "flyway", "lat", "lon"),
            **_in(-90, 90, "lat"),
            **_in(-180, 180, "lon"),
            **_in(0, 3, "seismic_level"),
            **_enum("flyway", *FLYWAYS),
        },
    }[table]


def checked(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The rows with ``failed``: the names of the broken rules, none for good rows.

    A rule that evaluates to NULL counts as broken.
    """
    broken = F.array_compact(
        F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    )
    return df.withColumn("failed", broken)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``failed``) of checked rows."""
    return rows.filter(F.size("failed") == 0).drop("failed"), rows.filter(F.size("failed") > 0)


def validate(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    return split(checked(df, rules))


def extra_columns(df: DataFrame, table: str) -> list[str]:
    """Columns a batch must not carry; reject the batch when the list is not empty."""
    return [c for c in df.columns if c not in DATASETS[table].schema.fieldNames()]


def checked_bronze(df: DataFrame, table: str) -> DataFrame:
    unknown = extra_columns(df, table)
    if unknown:
        raise ValueError(f"unexpected columns for {table}: {unknown}")
    return checked(df, rules_for(table))


def validate_bronze(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    return split(checked_bronze(df, table))
