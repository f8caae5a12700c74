"""Raw payloads to bronze rows, parsed on the executors.

An unreadable page fails the job; `split_pages` sets such pages aside beforehand, with the reason.

API answers are read as whole documents (one page of an API per file, so their
size is bounded by the page size); the cyclone archive and the ONI list are read
line by line and split across tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralake.schemas import (
    BIRDS,
    EARTHQUAKES,
    HAZARDS,
    MONTH_COLUMNS,
    ONI,
    PHENOLOGY,
    POPULATION,
    TRACKS,
    WEATHER,
    WEATHER_VARIABLES,
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``name`` (file name without suffix) and ``value`` (its text)."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(stem.alias("name"), "value")


# Where the pages of each payload hold their records.
def _array_at(path: str) -> Column:
    return F.try_variant_get(F.try_parse_json("value"), path, "array<variant>").isNotNull()


def _something_at(path: str) -> Column:
    return F.try_variant_get(F.try_parse_json("value"), path, "variant").isNotNull()


PAGE_ROOTS: dict[str, Callable[[], Column]] = {
    "weather": lambda: _array_at("$") | _something_at("$.hourly"),
    "quakes": lambda: _array_at("$.features"),
    "birds": lambda: _array_at("$"),
    "hazards": lambda: _array_at("$.items"),
    "worldbank": lambda: _something_at("$[1]"),
    "phenology": lambda: _something_at("$.count") | _something_at("$.facets"),
}


def split_pages(raw: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """(readable pages, rejected pages with ``failed``): broken JSON, or no records where they should be.

    Blank pages are readable and hold nothing.
    """
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    sound = blank | F.coalesce(PAGE_ROOTS[payload](), F.lit(False))
    reason = F.when(F.try_parse_json("value").isNull(), "page is no JSON").otherwise(f"page holds no {payload} records")
    return raw.filter(sound), raw.filter(~sound).withColumn("failed", F.array(reason))


def _readable(raw: DataFrame, payload: str) -> DataFrame:
    """The pages, each checked when it is read: an unreadable one fails the job instead of giving no rows."""
    blank = F.coalesce(F.trim("value"), F.lit("")) == ""
    sound = blank | F.coalesce(PAGE_ROOTS[payload](), F.lit(False))
    told = F.raise_error(F.concat(F.lit(f"unreadable {payload} page: "), F.substring("value", 1, 60))).cast("string")
    return raw.withColumn("value", F.when(sound, F.col("value")).otherwise(told))


def conform(df: DataFrame, schema) -> DataFrame:
    """Columns in schema order and type."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def _blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def _number(c: Column | str) -> Column:
    return _blank_to_null(c).try_cast("double")


def _count(c: Column | str) -> Column:
    """Counts arrive as integers, floats or text; keep the whole part."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string").try_cast("double").cast("bigint")


def parse_weather(raw: DataFrame, location_ids: Sequence[str], locations: DataFrame, kind: str) -> DataFrame:
    """Hourly blocks: parallel arrays zipped by position.

    A document holds one block or a list of blocks, in the order in which the
    locations were requested. Variables that were not requested become NULL.
    """
    arrays = ", ".join(f"{v}: array<double>" for v in WEATHER_VARIABLES)
    block = f"array<struct<hourly: struct<time: array<string>, {arrays}>>>"
    requested = F.array(*(F.lit(i) for i in location_ids))
    blocks = _readable(raw, "weather").select(F.posexplode(F.from_json("value", block)).alias("_pos", "b")).select(
        F.get(requested, F.col("_pos")).alias("location_id"), F.col("b.hourly").alias("h")
    )
    hours = F.size("h.time")
    filled = [
        F.coalesce(F.col(f"h.{v}"), F.array_repeat(F.lit(None).cast("double"), hours)).alias(v)
        for v in WEATHER_VARIABLES
    ]
    rows = (
        blocks.filter(F.col("h.time").isNotNull())
        .select("location_id", F.col("h.time").alias("time"), *filled)
        .select("location_id", F.explode(F.arrays_zip("time", *WEATHER_VARIABLES)).alias("r"))
        .select("location_id", "r.*")
        .withColumns({"time": F.try_to_timestamp("time"), "kind": F.lit(kind)})
    )
    # Rows of an unknown place keep no coordinates, which validation rejects.
    places = locations.select(F.col("id").alias("location_id"), "lat", "lon")
    return conform(rows.join(places, "location_id", "left"), WEATHER)


def parse_quakes(raw: DataFrame) -> DataFrame:
    """GeoJSON features; those without coordinates or origin time are dropped."""
    feature = (
        "struct<id: string, geometry: struct<coordinates: array<double>>, properties: struct<"
        "mag: double, magType: string, time: bigint, updated: bigint, place: string, type: string, "
        "tsunami: int, sig: bigint, alert: string, status: string, felt: bigint, cdi: double, "
        "mmi: double, net: string, url: string>>"
    )
    doc = F.from_json("value", f"struct<features: array<{feature}>>")
    f = _readable(raw, "quakes").select(F.explode(doc["features"]).alias("f")).select("f.id", "f.properties.*", "f.geometry.coordinates")
    named = f.select(
        F.col("id").alias("event_id"),
        F.timestamp_millis("time").alias("time"),
        F.timestamp_millis("updated").alias("updated"),
        F.col("mag").alias("magnitude"),
        F.col("magType").alias("magnitude_type"),
        F.get("coordinates", F.lit(1)).alias("lat"),
        F.get("coordinates", F.lit(0)).alias("lon"),
        F.get("coordinates", F.lit(2)).alias("depth_km"),
        "place",
        F.col("type").alias("event_type"),
        F.coalesce(F.col("tsunami") != 0, F.lit(False)).alias("tsunami"),
        F.col("sig").alias("significance"),
        "alert",
        "status",
        "felt",
        "cdi",
        "mmi",
        F.col("net").alias("network"),
        "url",
    )
    usable = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("time").isNotNull()
    return conform(named.filter(usable), EARTHQUAKES)


def parse_birds(raw: DataFrame, radius_km: int) -> DataFrame:
    """Observation lists, one document per location (``name`` is the location id)."""
    item = (
        "array<struct<speciesCode: string, comName: string, sciName: string, obsDt: string, "
        "howMany: bigint, lat: double, lng: double, locId: string, locName: string, "
        "obsValid: boolean, obsReviewed: boolean, subId: string>>"
    )
    o = _readable(raw, "birds").select("name", F.explode(F.from_json("value", item)).alias("o")).select("name", "o.*")
    text = F.trim("obsDt")
    minute, day = (
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
        for shape, fmt in (
            (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "yyyy-M-d H:m"),
            (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        )
    )
    named = o.select(
        F.col("name").alias("location_id"),
        F.lit(radius_km).alias("search_radius_km"),
        F.col("speciesCode").alias("species_code"),
        F.col("comName").alias("common_name"),
        F.col("sciName").alias("scientific_name"),
        F.coalesce(minute, day).alias("obs_datetime"),
        minute.isNull().alias("obs_date_only"),
        F.col("howMany").alias("how_many"),
        "lat",
        F.col("lng").alias("lon"),
        F.col("locId").alias("loc_id"),
        F.col("locName").alias("loc_name"),
        F.coalesce("obsValid", F.lit(True)).alias("obs_valid"),
        F.coalesce("obsReviewed", F.lit(False)).alias("obs_reviewed"),
        F.col("subId").alias("checklist_id"),
    )
    return conform(named.filter(F.col("obs_datetime").isNotNull()), BIRDS)


def parse_hazards(raw: DataFrame, hazard: str) -> DataFrame:
    """Pages of hazard records; three layouts become one schema."""
    item = (
        "struct<id: bigint, year: bigint, month: bigint, day: bigint, hour: bigint, minute: bigint, "
        "latitude: double, longitude: double, country: string, locationName: string, "
        "location: string, regionCode: bigint, deaths: string, deathsAmountOrder: bigint, "
        "injuries: string, injuriesAmountOrder: bigint, damageMillionsDollars: double, "
        "damageAmountOrder: bigint, housesDestroyed: string, deathsTotal: string, "
        "deathsAmountOrderTotal: bigint, injuriesTotal: string, damageMillionsDollarsTotal: double, "
        "eqMagnitude: double, eqDepth: double, intensity: double, maxWaterHeight: double, "
        "numRunups: string, vei: bigint, name: string, elevation: double, morphology: string, "
        "earthquakeEventId: bigint, tsunamiEventId: bigint, publish: boolean>"
    )
    doc = F.from_json("value", f"struct<items: array<{item}>>")
    i = _readable(raw, "hazards").select(F.explode(doc["items"]).alias("i")).select("i.*")
    volcano_name = F.col("name") if hazard == "volcano" else F.lit(None)
    named = i.select(
        F.col("id").alias("source_id"),
        F.lit(hazard).alias("hazard_type"),
        *("year", "month", "day", "hour", "minute", "latitude", "longitude", "country"),
        F.coalesce(_blank_to_null("locationName"), _blank_to_null("location")).alias("location_name"),
        F.col("regionCode").alias("region_code"),
        _count("deaths").alias("deaths"),
        F.col("deathsAmountOrder").alias("deaths_order"),
        _count("injuries").alias("injuries"),
        F.col("injuriesAmountOrder").alias("injuries_order"),
        F.col("damageMillionsDollars").alias("damage_musd"),
        F.col("damageAmountOrder").alias("damage_order"),
        _count("housesDestroyed").alias("houses_destroyed"),
        _count("deathsTotal").alias("deaths_total"),
        F.col("deathsAmountOrderTotal").alias("deaths_order_total"),
        _count("injuriesTotal").alias("injuries_total"),
        F.col("damageMillionsDollarsTotal").alias("damage_musd_total"),
        F.col("eqMagnitude").alias("eq_magnitude"),
        F.col("eqDepth").alias("eq_depth_km"),
        F.col("intensity").alias("eq_intensity"),
        F.col("maxWaterHeight").alias("tsunami_max_water_height_m"),
        _count("numRunups").alias("tsunami_num_runups"),
        F.col("vei").alias("volcano_vei"),
        volcano_name.alias("volcano_name"),
        F.col("elevation").alias("volcano_elevation_m"),
        F.col("morphology").alias("volcano_morphology"),
        F.col("earthquakeEventId").alias("caused_earthquake_id"),
        F.col("tsunamiEventId").alias("caused_tsunami_id"),
        F.coalesce("publish", F.lit(True)).alias("published"),
    )
    return conform(named.filter(F.col("year").isNotNull()), HAZARDS)


# Bronze column -> header of the published cyclone CSV.
TRACK_TEXT = {
    "sid": "SID",
    "basin": "BASIN",
    "subbasin": "SUBBASIN",
    "name": "NAME",
    "nature": "NATURE",
    "track_type": "TRACK_TYPE",
    "wmo_agency": "WMO_AGENCY",
}
TRACK_NUMBERS = {
    "season": "SEASON",
    "number": "NUMBER",
    "lat": "LAT",
    "lon": "LON",
    "wmo_wind_kt": "WMO_WIND",
    "wmo_pressure_mb": "WMO_PRES",
    "usa_wind_kt": "USA_WIND",
    "usa_pressure_mb": "USA_PRES",
    "usa_sshs": "USA_SSHS",
    "dist2land_km": "DIST2LAND",
    "landfall_km": "LANDFALL",
    "storm_speed_kt": "STORM_SPEED",
    "storm_dir_deg": "STORM_DIR",
}


def parse_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Cyclone track points. The units row under the header fails the time test."""
    raw = spark.read.csv(path, header=True)
    time = F.try_to_timestamp(F.trim("ISO_TIME"), F.lit("yyyy-MM-dd HH:mm:ss"))
    points = raw.select(
        time.alias("time"),
        *(_blank_to_null(h).alias(c) for c, h in TRACK_TEXT.items()),
        *(_number(h).alias(c) for c, h in TRACK_NUMBERS.items()),
    )
    needed = ("sid", "time", "lat", "lon", "season")
    for c in needed:
        points = points.filter(F.col(c).isNotNull())
    lon = F.col("lon")
    wrapped = F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)
    scale = F.when(F.col("usa_sshs").between(-5, 5), F.col("usa_sshs"))
    return conform(points.withColumns({"lon": wrapped, "usa_sshs": scale}), TRACKS)


# Overlapping three-month seasons in calendar order.
ONI_SEASONS = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")


def parse_oni(spark: SparkSession, path: str) -> DataFrame:
    """Lines of four fields whose first is a known season; others are headers."""
    index = F.create_map(*(F.lit(x) for i, s in enumerate(ONI_SEASONS, 1) for x in (s, i)))
    fields = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(fields.alias("f")).filter(F.size("f") == 4)
    rows = lines.select(
        F.col("f")[1].try_cast("bigint").alias("year"),
        F.col("f")[0].alias("season"),
        F.try_element_at(index, F.col("f")[0]).alias("season_index"),
        F.col("f")[2].try_cast("double").alias("sst_c"),
        F.col("f")[3].try_cast("double").alias("anomaly_c"),
    )
    for c in ONI.fieldNames():
        rows = rows.filter(F.col(c).isNotNull())
    return conform(rows, ONI)


def parse_country_metadata(raw: DataFrame) -> DataFrame:
    """Country list; region code NA ("not applicable") marks aggregates."""
    item = (
        "array<struct<id: string, iso2Code: string, region: struct<id: string, value: string>, "
        "incomeLevel: struct<value: string>>>"
    )
    rows = F.from_json(F.get_json_object("value", "$[1]"), item)
    c = _readable(raw, "worldbank").select(F.explode(rows).alias("c")).select("c.*")
    return c.select(
        F.col("id").alias("code"),
        F.col("iso2Code").alias("iso2"),
        F.coalesce(F.col("region.id") == "NA", F.lit(False)).alias("is_aggregate"),
        _blank_to_null(F.col("region.value")).alias("region"),
        _blank_to_null(F.col("incomeLevel.value")).alias("income_level"),
    )


def parse_population(raw: DataFrame, metadata: DataFrame) -> DataFrame:
    """Population by country-year. An unknown code counts as an aggregate: the
    safe error, since an aggregate taken for a country would inflate sums."""
    item = (
        "array<struct<countryiso3code: string, country: struct<id: string, value: string>, "
        "date: string, value: double>>"
    )
    rows = F.from_json(F.get_json_object("value", "$[1]"), item)
    i = _readable(raw, "worldbank").select(F.explode(rows).alias("i")).select("i.*")
    named = i.select(
        F.nullif("countryiso3code", F.lit("")).alias("code"),
        F.coalesce(F.nullif("countryiso3code", F.lit("")), "country.id", F.lit("?")).alias("country_id"),
        F.coalesce(F.trim("country.value"), F.lit("")).alias("country_name"),
        F.col("date").try_cast("bigint").alias("year"),
        F.nullif(F.col("value"), F.lit(0.0)).cast("bigint").alias("population"),
    )
    known = named.join(metadata, "code", "left")
    return conform(
        known.withColumn("is_aggregate", F.coalesce("is_aggregate", F.lit(True))), POPULATION
    )


def parse_phenology(raw: DataFrame) -> DataFrame:
    """Facet counts per month; the request's keys are columns beside ``value``.

    The month map is read by key, so no pivot and no shuffle; absent months are 0.
    """
    schema = "struct<count: bigint, facets: array<struct<counts: array<struct<name: string, count: bigint>>>>>"
    doc = _readable(raw, "phenology").withColumn("d", F.from_json("value", schema))
    counts = F.coalesce(F.get("d.facets", F.lit(0))["counts"], F.array().cast("array<struct<name: string, count: bigint>>"))
    months = F.map_from_entries(
        F.transform(counts, lambda c: F.struct(c["name"].cast("int"), c["count"]))
    )
    keyed = doc.withColumn("m", months)
    named = keyed.withColumns(
        {
            "total_records": F.coalesce("d.count", F.lit(0)),
            **{
                c: F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0))
                for i, c in enumerate(MONTH_COLUMNS, 1)
            },
        }
    )
    return conform(named, PHENOLOGY)
