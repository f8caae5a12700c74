"""Earth-data inputs derived from the driver's tables.

Every input is a projection or an aggregation of a whole table; nothing is
sampled, so work grows with the tables. Copies are kept on purpose: catalogues
such as epidemics or index values get one bronze row per customer or order, so
that de-duplication meets very hot keys.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralake.functions import int_div
from terralake.plans.build import MODELS, LazyTables, save
from terralake.schemas import DATASETS, MONTH_COLUMNS
from terralake.session import ensure_checkpoint_dir, use_utc
from terralake.sources.parsers import ONI_SEASONS

# Periods that suit the data's years (1995-01 to 2001-11).
OPTIONS: dict[str, Mapping[str, object]] = {
    "gold_weather_daily": {"min_hours": 5},
    "gold_climatology": {"baseline": ("1995-01-01", "1998-12-31")},
    "gold_temperature_anomaly": {"baseline": ("1995-01-01", "1998-12-31")},
    "gold_heatwave_features": {"training": ("1995-01-01", "1998-12-31")},
    "gold_heat_threshold_drift": {"calibration": (1995, 1998), "recent": (1999, 2001)},
    "gold_enso_cyclones": {"seasons": (1995, 2001)},
    "gold_model_skill": {
        "quake_cuts": (1996, 1997, 1998, 1999),
        "heat_cuts": (1996, 1997, 1998, 1999),
        "persistence_cuts": (1996, 1997, 1998, 1999),
        "first_year": 1995,
        "min_events": 1,
    },
    "silver_epidemics": {"as_of": "2026-01-01"},
}


class Driver:
    """Lazy access to the driver's tables of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.dir = sf_dir.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        zoneless = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def _mod(c: Column | str, n: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c) % n


def _days(c: Column, n: Column) -> Column:
    return c + F.make_dt_interval(days=n)


def _latitude(k: Column) -> Column:
    return _mod(k * 31, 600) / F.lit(100.0)


def _longitude(k: Column) -> Column:
    return _mod(k * 17, 1200) / F.lit(100.0)


def _bronze(df: DataFrame, table: str, ingested: Column) -> DataFrame:
    """Fill the dataset's schema by name and stamp the provenance."""
    stamped = df.withColumn("_ingested_at", ingested)
    have = set(stamped.columns)
    dataset = DATASETS[table]
    cols = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in dataset.schema.fields
    ]
    return stamped.select(
        *cols, "_ingested_at", F.lit(dataset.source).alias("_source"), F.lit("2026-01-01").alias("ingest_date")
    )


def locations(d: Driver) -> DataFrame:
    k, region = F.col("n_nationkey"), F.col("n_regionkey")
    # Shifted so that two of the twelve places with weather lie near the events.
    place = (k + 8) % 25
    zones = F.array(
        *(F.lit(z) for z in ("UTC", "America/New_York", "Asia/Tokyo", "Europe/Madrid", "Asia/Kolkata"))
    )
    climates = F.array(*(F.lit(c) for c in ("Af", "BWh", "Cfb", "Dfc", "ET")))
    return d["nation"].select(
        k.cast("string").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("R"), region.cast("string")).alias("country"),
        (place * 5 - 60).cast("double").alias("lat"),
        (place * 14 - 170).cast("double").alias("lon"),
        F.get(zones, region).alias("timezone"),
        F.get(climates, k % 5).alias("koppen"),
        (k % 4).cast("bigint").alias("seismic_level"),
        F.lit("ninguna").alias("flyway"),
    )


def bronze_weather(d: Driver) -> DataFrame:
    """Events as hourly readings; every fourth one arrives again, corrected."""
    e, k = d["events"], F.col("event_id")
    real = lambda c: c.cast("double")
    rows = e.select(
        "event_id",
        _mod("user_id", 12).cast("string").alias("location_id"),
        F.col("ts").alias("time"),
        F.when(_mod("user_id", 5) == 0, "forecast").otherwise("observed").alias("kind"),
        F.col("value").alias("temperature_2m"),
        (F.col("value") - 2).alias("apparent_temperature"),
        real(_mod(k, 7)).alias("precipitation"),
        real(_mod(k, 40) + 990).alias("pressure_msl"),
        real(_mod(k, 40) + 900).alias("surface_pressure"),
        real(_mod(k, 100)).alias("relative_humidity_2m"),
        real(_mod(k * 7, 101)).alias("cloud_cover"),
        real(_mod(k * 13, 90)).alias("wind_gusts_10m"),
        real(_mod(k * 11, 800)).alias("shortwave_radiation"),
        F.col("ts").alias("arrived"),
    )
    again = rows.filter(_mod(k, 4) == 0).withColumns(
        {"temperature_2m": F.col("temperature_2m") + 1, "arrived": _days(F.col("arrived"), F.lit(1))}
    )
    both = rows.unionByName(again)
    return _bronze(both, "bronze_weather", F.col("arrived"))


def daily(d: Driver) -> DataFrame:
    """Line items as days of twelve places; line 7 is a forecast."""
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    by_day = d["lineitem"].groupBy(
        _mod("l_suppkey", 12).cast("string").alias("location_id"),
        F.to_date("l_shipdate").alias("local_date"),
        F.when(F.col("l_linenumber") == 7, "forecast").otherwise("observed").alias("kind"),
    )
    return by_day.agg(
        F.count(F.lit(1)).alias("hours"),
        F.avg(q).alias("temp_mean"),
        F.min(q).alias("temp_min"),
        F.max(q).alias("temp_max"),
        (F.max(q) - F.min(q)).alias("temp_range"),
        (F.min(q) - 2).alias("apparent_min"),
        (F.max(q) + 2).alias("apparent_max"),
        F.sum("l_discount").alias("precip_sum"),
        F.avg(price).alias("pressure_msl_mean"),
        F.min(price).alias("pressure_msl_min"),
        (F.avg(price) - 10).alias("surface_pressure_mean"),
        F.avg(F.col("l_tax")).alias("humidity_mean"),
        F.avg(F.col("l_linenumber").cast("double")).alias("cloud_cover_mean"),
        F.max(_mod("l_partkey", 100).cast("double")).alias("wind_gust_max"),
        F.sum("l_tax").alias("radiation_sum"),
    )


def bronze_quakes(d: Driver) -> DataFrame:
    """Orders as earthquakes; every third one is revised, some revisions delete it."""
    k = F.col("o_orderkey")
    share = _mod(k * 7919, 9973) / F.lit(9973.0)
    magnitude = F.floor((F.lit(4.5) - F.log10(F.lit(1.0) - share)) * 10).cast("double") / 10
    origin = F.timestamp_seconds(F.unix_seconds("o_orderdate") + _mod(k * 37, 86400))
    rows = d["orders"].select(
        k.alias("k"),
        F.concat(F.lit("q"), k.cast("string")).alias("event_id"),
        origin.alias("time"),
        _days(origin, F.lit(1)).alias("updated"),
        magnitude.alias("magnitude"),
        F.lit("mb").alias("magnitude_type"),
        _latitude(k).alias("lat"),
        _longitude(k).alias("lon"),
        F.when(_mod(k, 29) != 0, _mod(k * 13, 700).cast("double")).alias("depth_km"),
        F.concat(F.lit("P"), _mod(k, 100).cast("string")).alias("place"),
        F.when(_mod(k, 50) == 7, "quarry blast").otherwise("earthquake").alias("event_type"),
        (_mod(k, 20) == 0).alias("tsunami"),
        _mod(k, 1000).alias("significance"),
        F.when(_mod(k, 4) > 0, "reviewed").alias("status"),
        _mod(k, 17).alias("felt"),
        F.lit("us").alias("network"),
    )
    deleted = F.when(_mod("k", 15) == 3, "deleted").otherwise("reviewed")
    revised = rows.filter(_mod("k", 3) == 0).withColumns(
        {
            "updated": _days(F.col("updated"), F.lit(2)),
            "magnitude": F.when(_mod("k", 6) == 0, F.col("magnitude") + 0.1).otherwise(F.col("magnitude")),
            "status": deleted,
        }
    )
    return _bronze(rows.unionByName(revised), "bronze_quakes", F.col("updated"))


def bronze_cyclones(d: Driver) -> DataFrame:
    """A customer's orders as the track of one storm."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    basins = F.array(*(F.lit(b) for b in ("NA", "EP", "WP", "NI")))
    real = lambda x: x.cast("double")
    rows = d["orders"].select(
        k.alias("k"),
        c.cast("string").alias("sid"),
        F.year("o_orderdate").cast("bigint").alias("season"),
        F.get(basins, (c % 4).cast("int")).alias("basin"),
        F.lit("MM").alias("subbasin"),
        F.concat(F.lit("S"), _mod(c, 30).cast("string")).alias("name"),
        F.timestamp_seconds(F.unix_seconds("o_orderdate") + _mod(k, 8) * 10800).alias("time"),
        F.lit("TS").alias("nature"),
        F.when(_mod(k, 17) == 0, "spur").otherwise("main").alias("track_type"),
        _latitude(k).alias("lat"),
        _longitude(k).alias("lon"),
        F.when(_mod(k, 13) != 0, real(_mod(k * 3, 100) + 25)).alias("wmo_wind_kt"),
        F.when(_mod(k, 9) != 0, real(F.lit(1010) - _mod(k * 3, 100))).alias("wmo_pressure_mb"),
        F.when(_mod(k, 11) != 0, real(_mod(k * 7, 140) + 20)).alias("usa_wind_kt"),
        F.when(_mod(k, 10) != 0, real(F.lit(1010) - _mod(k * 7, 140))).alias("usa_pressure_mb"),
        F.when(_mod(k, 7) != 0, _mod(k, 8) - 2).alias("usa_sshs"),
        real(_mod(k, 5) * 50).alias("dist2land_km"),
        F.col("o_orderdate").alias("arrived"),
    )
    again = rows.filter(_mod("k", 5) == 0).withColumns(
        {"usa_wind_kt": F.col("usa_wind_kt") + 5, "arrived": _days(F.col("arrived"), F.lit(30))}
    )
    return _bronze(rows.unionByName(again), "bronze_cyclones", F.col("arrived"))


def bronze_hazards(d: Driver, kind: int) -> DataFrame:
    """Parts as historic hazards of one archive: 0 quakes, 1 tsunamis, 2 volcanoes."""
    p = F.col("p_partkey")
    i = F.col("i")
    parts = d["part"].filter(_mod(p, 3) == kind).withColumn("i", int_div(p, 3))
    shift = F.when(_mod(i, 5) == 0, F.lit(0)).otherwise(F.lit(kind))
    deaths = (_mod(i, 97) + shift) * 100
    month, day = _mod(F.col("p_size"), 13), _mod(p * 3, 32)
    tsunami, volcano = kind == 1, kind == 2
    rows = parts.select(
        i.alias("source_id"),
        F.lit(("earthquake", "tsunami", "volcano")[kind]).alias("hazard_type"),
        (_mod(i * 7, 6400) - 4360).alias("year"),
        F.when(month > 0, month).alias("month"),
        F.when(day > 0, day).alias("day"),
        F.when(_mod(i, 23) != 0, _latitude(i)).alias("latitude"),
        F.when(_mod(i, 23) != 0, _longitude(i)).alias("longitude"),
        F.col("p_brand").alias("country"),
        F.when(_mod(p, 6) != 0, F.col("p_name")).alias("location_name"),
        F.when(_mod(i, 10) != 9, deaths).alias("deaths"),
        F.when(_mod(i, 11) != 3, deaths + _mod(i, 7) * 50).alias("deaths_total"),
        _mod(i, 5).alias("deaths_order"),
        _mod(p, 400).alias("injuries_total"),
        F.col("p_retailprice").alias("damage_musd_total"),
        _mod(p, 90).alias("houses_destroyed"),
        (F.lit(None) if kind else _mod(i, 40) / F.lit(10.0) + 5).alias("eq_magnitude"),
        (_mod(p, 60).cast("double") if tsunami else F.lit(None)).alias("tsunami_max_water_height_m"),
        (_mod(p, 30) if tsunami else F.lit(None)).alias("tsunami_num_runups"),
        (_mod(i, 9) if volcano else F.lit(None)).alias("volcano_vei"),
        (F.concat(F.lit("V"), i.cast("string")) if volcano else F.lit(None)).alias("volcano_name"),
        (F.when(_mod(i, 2) == 0, i) if tsunami else F.lit(None)).alias("caused_earthquake_id"),
        (F.when(_mod(i, 2) == 1, i) if volcano else F.lit(None)).alias("caused_tsunami_id"),
        F.lit(True).alias("published"),
    )
    table = ("bronze_noaa_eq", "bronze_noaa_tsunami", "bronze_noaa_volcano")[kind]
    return _bronze(rows, table, F.lit("2026-01-01").cast("timestamp"))


def _arrival(k: Column) -> Column:
    return F.timestamp_seconds(k + 1_000_000_000)


def bronze_epidemics(d: Driver) -> DataFrame:
    """One catalogue entry per (nation, segment), one copy per customer."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    tail = F.when(_mod(n, 7) != 0, n * 4 + 1900 + _mod(n, 10))
    rows = d["customer"].select(
        k.alias("k"),
        F.concat(F.col("c_mktsegment"), F.lit("-"), n.cast("string")).alias("id"),
        F.concat(F.lit("E"), n.cast("string"), F.substring("c_mktsegment", 1, 2)).alias("name"),
        F.lit("agent").alias("pathogen"),
        F.col("c_mktsegment").alias("disease"),
        (n * 4 + 1900).alias("start_year"),
        tail.alias("end_year"),
        F.when(_mod(n, 13) != 0, (_mod(k, 50) + 1) * 1000).alias("deaths_low"),
        F.when(_mod(n, 13) != 0, (_mod(k, 50) + 1) * 3000).alias("deaths_high"),
        F.col("c_mktsegment").alias("regions"),
        F.lit("media").alias("estimate_confidence"),
        F.lit("list").alias("source"),
    )
    return _bronze(rows, "bronze_epidemics", _arrival(F.col("k")))


def bronze_events(d: Driver) -> DataFrame:
    """One milestone per nation, one copy per customer."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    kinds = F.array(*(F.lit(c) for c in ("guerra", "economia", "tecnologia", "salud", "clima", "observacion")))
    rows = d["customer"].select(
        k.alias("k"),
        F.concat(F.lit("m"), n.cast("string")).alias("id"),
        F.concat(F.lit("M"), n.cast("string")).alias("name"),
        F.get(kinds, n % 6).alias("category"),
        (n % 20 + 1988).alias("start_year"),
        F.when(_mod(n, 3) != 0, n % 20 + 1988 + _mod(n, 4)).alias("end_year"),
        F.concat(F.lit("d"), k.cast("string")).alias("description"),
        F.lit("r").alias("relevance"),
    )
    return _bronze(rows, "bronze_events", _arrival(F.col("k")))


def bronze_population(d: Driver) -> DataFrame:
    """Orders as revisions of country-years; the world total starts in 1998."""
    k, c, y = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate")
    world = (_mod(c, 20) == 0) & (y >= 1998)
    rows = d["orders"].select(
        k.alias("k"),
        F.when(world, "WLD").otherwise(F.concat(F.lit("C"), _mod(c, 20).cast("string"))).alias("country_id"),
        F.lit("x").alias("country_name"),
        y.alias("year"),
        F.when(world | (_mod(k, 9) != 0), (_mod(k, 5000) + 10000) * 1000).alias("population"),
        world.alias("is_aggregate"),
    )
    return _bronze(rows, "bronze_population", _arrival(F.col("k")))


def bronze_world_population(d: Driver) -> DataFrame:
    """Orders as revisions of ten anchors, 1900 to 1990."""
    k = F.col("o_orderkey")
    rows = d["orders"].select(
        k.alias("k"),
        (_mod("o_custkey", 10) * 10 + 1900).alias("year"),
        ((_mod(k, 900) + 1000) * 1000).alias("population_low"),
        ((_mod(k, 900) + 1000) * 1200).alias("population_high"),
        F.lit("media").alias("confidence"),
        F.lit("s").alias("source"),
    )
    return _bronze(rows, "bronze_world_population", _arrival(F.col("k")))


def bronze_oni(d: Driver) -> DataFrame:
    """Orders as revisions of monthly index values between -2 and +2."""
    k, m = F.col("o_orderkey"), F.month("o_orderdate")
    seasons = F.array(*(F.lit(s) for s in ONI_SEASONS))
    anomaly = (_mod(k * 37, 41) - 20) / F.lit(10.0)
    rows = d["orders"].select(
        k.alias("k"),
        F.year("o_orderdate").alias("year"),
        F.get(seasons, m - 1).alias("season"),
        m.alias("season_index"),
        (anomaly + 26).alias("sst_c"),
        anomaly.alias("anomaly_c"),
    )
    return _bronze(rows, "bronze_oni", _arrival(F.col("k")))


def bronze_phenology(d: Driver) -> DataFrame:
    """Orders counted per (priority, place, year) in twelve month columns."""
    month = F.month("o_orderdate")
    counts = d["orders"].groupBy(
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("species_key"),
        _mod("o_custkey", 12).cast("string").alias("location_id"),
        F.year("o_orderdate").alias("year"),
    ).agg(
        F.count(F.lit(1)).alias("total_records"),
        *(F.count_if(month == i).alias(c) for i, c in enumerate(MONTH_COLUMNS, 1)),
    )
    rows = counts.withColumns({"species_name": F.lit("s"), "is_control": F.col("species_key") >= 4})
    return _bronze(rows, "bronze_phenology", F.lit("2026-01-01").cast("timestamp"))


def bronze_birds(d: Driver) -> DataFrame:
    """Orders as checklists, line items as species seen on them."""
    orders = d["orders"].select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    lines = d["lineitem"].select(
        "l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_returnflag", "l_shipdate"
    )
    k = F.col("l_orderkey")
    seen = F.timestamp_seconds(F.unix_seconds("o_orderdate") + _mod(k, 24) * 3600)
    rows = lines.join(orders, "l_orderkey").select(
        _mod("o_custkey", 12).cast("string").alias("location_id"),
        F.lit(25).alias("search_radius_km"),
        F.concat(F.lit("sp"), _mod("l_partkey", 50).cast("string")).alias("species_code"),
        seen.cast("timestamp_ntz").alias("obs_datetime"),
        F.lit(False).alias("obs_date_only"),
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("bigint")).alias("how_many"),
        _latitude(k).alias("lat"),
        _longitude(k).alias("lon"),
        (F.col("l_returnflag") != "R").alias("obs_valid"),
        F.lit(True).alias("obs_reviewed"),
        k.cast("string").alias("checklist_id"),
        F.col("l_shipdate").alias("arrived"),
    )
    return _bronze(rows, "bronze_birds", F.col("arrived"))


INPUTS = {
    "dim_locations": locations,
    "gold_weather_daily": daily,
    "bronze_weather": bronze_weather,
    "bronze_quakes": bronze_quakes,
    "bronze_birds": bronze_birds,
    "bronze_noaa_eq": lambda d: bronze_hazards(d, 0),
    "bronze_noaa_tsunami": lambda d: bronze_hazards(d, 1),
    "bronze_noaa_volcano": lambda d: bronze_hazards(d, 2),
    "bronze_epidemics": bronze_epidemics,
    "bronze_cyclones": bronze_cyclones,
    "bronze_population": bronze_population,
    "bronze_world_population": bronze_world_population,
    "bronze_oni": bronze_oni,
    "bronze_events": bronze_events,
    "bronze_phenology": bronze_phenology,
}


class Domain(LazyTables):
    """Inputs and models over the driver's tables; nothing is rounded here.

    Tables that a query reads are staged as Parquet under the shared checkpoint
    folder, as the full build does, once per session and scale.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.driver = Driver(spark, sf_dir)
        self.spark = self.driver.spark
        # A folder of its own: another session's Domain never replaces files that this one's frames read.
        folder = f"{ensure_checkpoint_dir(self.spark)}/tables-{uuid.uuid4().hex}"
        self._lock = threading.RLock()
        super().__init__(
            {}, rounding=False, options=OPTIONS, stage=lambda df, name: save(df, folder, name)
        )

    def __getitem__(self, name: str) -> DataFrame:
        with self._lock:
            if name not in self._done and name in INPUTS:
                derived = INPUTS[name](self.driver)
                # Stands in for a built table, and nearly every weather query reads it.
                self.put(name, self._stage(derived, name) if name in MODELS else derived)
            return super().__getitem__(name)


_DOMAINS: dict[tuple[str, str], Domain] = {}


def domain_for(spark: SparkSession, sf_dir: str) -> Domain:
    """One Domain per application and folder, so that staged tables are shared."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _DOMAINS or _DOMAINS[key].spark is not spark:
        _DOMAINS[key] = Domain(spark, sf_dir)
    return _DOMAINS[key]
