"""Inputs rendered as the raw payloads that sources deliver, and read again.

Whole bronze tables become pages, CSV and text lines, every so many of them broken; what the parsers
and rules make of them is compared with the rows they were rendered from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralake.functions import int_div
from terralake.schemas import DATASETS
from terralake.session import ensure_checkpoint_dir
from terralake.sources import bronze, parsers, validation
from workload.domain import Domain

#: Of this many pages or lines, one is broken.
EVERY, BROKEN = 13, 5


def new_folder(d: Domain) -> str:
    return f"{ensure_checkpoint_dir(d.spark)}/payloads-{uuid.uuid4().hex}"


def _page(number: Column) -> Column:
    return F.pmod(number, F.lit(EVERY)) == BROKEN


def _pages(rows: DataFrame, keys: list[Column], item: Column, number: str, wrap=lambda items: items) -> DataFrame:
    """One JSON page for each key, with ``value``; pages of some numbers are cut off in the middle."""
    grouped = rows.groupBy(*keys).agg(F.collect_list(item).alias("items"))
    text = F.to_json(wrap(F.col("items")))
    return grouped.withColumn("value", F.when(_page(F.col(number)), F.left(text, F.length(text) - 3)).otherwise(text))


def quake_pages(d: Domain) -> DataFrame:
    """GeoJSON pages of the events of ten numbers each."""
    millis = lambda c: F.unix_millis(c)
    feature = F.struct(
        F.col("event_id").alias("id"),
        F.struct(F.array("lon", "lat", "depth_km").alias("coordinates")).alias("geometry"),
        F.struct(
            F.col("magnitude").alias("mag"), millis("time").alias("time"), millis("updated").alias("updated"), "place",
            F.col("event_type").alias("type"), F.col("tsunami").cast("int").alias("tsunami"), F.col("significance").alias("sig"), "status",
        ).alias("properties"),
    )
    number = int_div(F.substring("event_id", 2, 20).cast("bigint"), F.lit(10)).alias("page")
    return _pages(d["bronze_quakes"], [number], feature, "page", lambda items: F.struct(items.alias("features")))


def src6_quakes(d: Domain) -> DataFrame:
    good, _ = parsers.split_pages(quake_pages(d), "quakes")
    return parsers.parse_quakes(good).select("event_id", "time", "updated", "magnitude", "lat", "lon", "depth_km", "place", "event_type", "tsunami", "significance", "status")


SRC6 = f"""SELECT event_id, time, updated, magnitude, lat, lon, depth_km, place, event_type, tsunami, significance, status
    FROM bronze_quakes WHERE (substr(event_id, 2)::BIGINT // 10) % {EVERY} <> {BROKEN}"""


def src6_rejected(d: Domain) -> DataFrame:
    _, bad = parsers.split_pages(quake_pages(d), "quakes")
    return bad.select("page", F.concat_ws("; ", "failed").alias("failed"))


SRC6_REJECTED = f"""SELECT DISTINCT substr(event_id, 2)::BIGINT // 10 AS page, 'page is no JSON' AS failed FROM bronze_quakes
    WHERE page % {EVERY} = {BROKEN}"""


def src5_weather(d: Domain) -> DataFrame:
    """Hourly blocks by place and hour, at the place's position in the list that was asked for."""
    places = [str(i) for i in range(12)]
    variables = ["temperature_2m", "precipitation", "pressure_msl"]
    observed = d["bronze_weather"].filter("kind = 'observed'").withColumn("hour", F.date_trunc("hour", "time"))
    grouped = observed.groupBy("location_id", "hour").agg(
        F.collect_list(F.struct(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"), *variables)).alias("r")
    )
    position = F.col("location_id").cast("int")
    block = F.struct(F.struct(*(F.col(f"r.{c}").alias(c) for c in ("time", *variables))).alias("hourly"))
    # Blocks of the places asked for before this one are empty.
    empty = F.struct(F.struct(*(F.array().cast(f"array<{'string' if c == 'time' else 'double'}>").alias(c) for c in ("time", *variables))).alias("hourly"))
    text = F.to_json(F.concat(F.array_repeat(empty, position), F.array(block)))
    number = position + F.hour("hour")
    raw = grouped.select(F.when(_page(number), F.left(text, F.length(text) - 3)).otherwise(text).alias("value"))
    good, _ = parsers.split_pages(raw, "weather")
    return parsers.parse_weather(good, places, d["dim_locations"], "observed").select("location_id", "lat", "lon", "time", "kind", *variables)


SRC5 = f"""SELECT location_id, lat, lon, time, kind, temperature_2m, precipitation, pressure_msl FROM bronze_weather JOIN dim_locations ON id = location_id
    WHERE kind = 'observed' AND (location_id::BIGINT + hour(time)) % {EVERY} <> {BROKEN}"""


def src7_birds(d: Domain) -> DataFrame:
    """Lists of observations by place and checklist; times to the minute, to the day, or unreadable."""
    number = F.col("checklist_id").cast("bigint")
    shape = F.pmod(number, F.lit(3))
    when = F.when(shape == 0, F.date_format("obs_datetime", "yyyy-MM-dd HH:mm")).when(shape == 1, F.date_format("obs_datetime", "yyyy-MM-dd")).otherwise("soon")
    item = F.struct(
        F.col("species_code").alias("speciesCode"), when.alias("obsDt"), F.col("how_many").alias("howMany"),
        F.col("obs_valid").alias("obsValid"), F.col("checklist_id").alias("subId"),
    )
    raw = _pages(d["bronze_birds"], [F.col("location_id").alias("name"), number.alias("page")], item, "page")
    good, _ = parsers.split_pages(raw, "birds")
    return parsers.parse_birds(good, 25).select("location_id", "species_code", "obs_datetime", "obs_date_only", "how_many", "obs_valid", "checklist_id")


SRC7 = f"""SELECT location_id, species_code, CASE WHEN checklist_id::BIGINT % 3 = 1 THEN date_trunc('day', obs_datetime) ELSE obs_datetime END::TIMESTAMP AS obs_datetime,
        checklist_id::BIGINT % 3 = 1 AS obs_date_only, how_many, obs_valid, checklist_id
    FROM bronze_birds WHERE checklist_id::BIGINT % 3 < 2 AND checklist_id::BIGINT % {EVERY} <> {BROKEN}"""


def src8_hazards(d: Domain) -> DataFrame:
    """Pages of ten events; counts as whole numbers, as decimals or as text."""
    count = F.when(F.col("source_id") % 2 == 0, F.concat(F.col("deaths").cast("string"), F.lit(".0"))).otherwise(F.col("deaths").cast("string"))
    item = F.struct(
        F.col("source_id").alias("id"), "year", "month", "day", "latitude", "longitude", "country", F.col("location_name").alias("locationName"),
        count.alias("deaths"), F.col("deaths_total").alias("deathsTotal"), F.col("eq_magnitude").alias("eqMagnitude"), F.col("published").alias("publish"),
    )
    raw = _pages(d["bronze_noaa_eq"], [int_div("source_id", F.lit(10)).alias("page")], item, "page", lambda items: F.struct(items.alias("items")))
    good, _ = parsers.split_pages(raw, "hazards")
    return parsers.parse_hazards(good, "earthquake").select("source_id", "hazard_type", "year", "month", "day", "country", "deaths", "deaths_total", "eq_magnitude")


SRC8 = f"""SELECT p_partkey // 3 AS source_id, 'earthquake' AS hazard_type, p_partkey // 3 * 7 % 6400 - 4360 AS year,
        CASE WHEN p_size % 13 > 0 THEN p_size % 13 END::BIGINT AS month, CASE WHEN p_partkey * 3 % 32 > 0 THEN p_partkey * 3 % 32 END AS day, p_brand AS country,
        CASE WHEN p_partkey // 3 % 10 <> 9 THEN p_partkey // 3 % 97 * 100 END AS deaths,
        CASE WHEN p_partkey // 3 % 11 <> 3 THEN p_partkey // 3 % 97 * 100 + p_partkey // 3 % 7 * 50 END AS deaths_total,
        p_partkey // 3 % 40 / 10.0::DOUBLE + 5 AS eq_magnitude
    FROM part WHERE p_partkey % 3 = 0 AND p_partkey // 30 % {EVERY} <> {BROKEN}"""


#: Columns that each archive has beside the common ones, as its pages name them.
LAYOUTS = {
    "earthquake": {"location_name": "locationName", "eq_magnitude": "eqMagnitude"},
    "tsunami": {"location_name": "locationName", "tsunami_max_water_height_m": "maxWaterHeight", "tsunami_num_runups": "numRunups", "caused_earthquake_id": "earthquakeEventId"},
    "volcano": {"location_name": "location", "volcano_vei": "vei", "volcano_name": "name", "caused_tsunami_id": "tsunamiEventId"},
}
COMMON = {"source_id": "id", "year": "year", "month": "month", "day": "day", "latitude": "latitude", "longitude": "longitude", "country": "country", "deaths": "deaths", "deaths_total": "deathsTotal", "houses_destroyed": "housesDestroyed"}
OWN = sorted({c for names in LAYOUTS.values() for c in names})


def src8_layouts(d: Domain) -> DataFrame:
    """All three archives, each in pages of its own layout, read into one schema."""
    read = []
    for table, (hazard, own) in zip(("bronze_noaa_eq", "bronze_noaa_tsunami", "bronze_noaa_volcano"), LAYOUTS.items()):
        item = F.struct(*(F.col(c).alias(n) for c, n in {**COMMON, **own}.items()))
        raw = _pages(d[table], [int_div("source_id", F.lit(10)).alias("page")], item, "page", lambda items: F.struct(items.alias("items")))
        good, _ = parsers.split_pages(raw, "hazards")
        read.append(parsers.parse_hazards(good, hazard).select("hazard_type", *COMMON, *OWN))
    return read[0].unionByName(read[1]).unionByName(read[2])


SRC8_LAYOUTS = f"""SELECT hazard_type, {", ".join(COMMON)}, {", ".join(OWN)}
    FROM bronze_hazards WHERE source_id // 10 % {EVERY} <> {BROKEN}"""


def src9_tracks(d: Domain) -> DataFrame:
    """A CSV with a row of units below its header; longitudes east of 180 and rows without a place among it."""
    names = {**parsers.TRACK_TEXT, **parsers.TRACK_NUMBERS}
    points = d["bronze_cyclones"].withColumn("lon", F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon")))
    points = points.withColumn("lat", F.when(F.minute("time") % 2 == 1, F.lit(None)).otherwise(F.col("lat")))
    rows = points.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("ISO_TIME"), *(F.col(c).cast("string").alias(h) for c, h in names.items()))
    units = d.spark.createDataFrame([(" ",) + ("degrees",) * len(names)], rows.schema)
    path = new_folder(d)
    units.union(rows).write.csv(path, header=True)
    return parsers.parse_tracks(d.spark, path).select("sid", "season", "basin", "time", "lat", "lon", "usa_wind_kt", "usa_sshs")


SRC9 = """SELECT sid, season, basin, time, lat, lon, usa_wind_kt, CASE WHEN usa_sshs BETWEEN -5 AND 5 THEN usa_sshs END AS usa_sshs
    FROM bronze_cyclones WHERE sid IS NOT NULL AND time IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND season IS NOT NULL AND minute(time) % 2 = 0"""


def src10_oni(d: Domain) -> DataFrame:
    """Lines of four fields among a header and lines of three."""
    fields = [F.col("season"), F.col("year").cast("string"), F.col("sst_c").cast("string"), F.col("anomaly_c").cast("string")]
    whole, cut = F.concat_ws("  ", *fields), F.concat_ws("  ", *fields[:3])
    lines = d["bronze_oni"].select(F.when(_page(F.col("year") + F.col("season_index")), cut).otherwise(whole).alias("value"))
    header = d.spark.createDataFrame([(" SEAS  YR   TOTAL   ANOM",)], "value string")
    path = new_folder(d)
    header.union(lines).write.text(path)
    return parsers.parse_oni(d.spark, path)


SRC10 = f"SELECT year, season, season_index, sst_c, anomaly_c FROM bronze_oni WHERE (year + season_index) % {EVERY} <> {BROKEN}"


def src11_population(d: Domain) -> DataFrame:
    """Pages of [summary, rows] by country, year and hundred revisions, with a list of countries that lacks some."""
    # Every row has its own page number, a digest of what it holds.
    number = F.pmod(F.xxhash64("country_id", "year", "population"), F.lit(1 << 20))
    item = F.struct(
        F.col("country_id").alias("countryiso3code"), F.struct(F.col("country_id").alias("id"), F.lit("x").alias("value")).alias("country"),
        F.col("year").cast("string").alias("date"), F.col("population").cast("double").alias("value"),
    )
    pages = d["bronze_population"].groupBy("country_id", "year", number.alias("page")).agg(F.collect_list(item).alias("items"))
    text = F.concat(F.lit('[{"page":1},'), F.to_json("items"), F.lit("]"))
    raw = pages.select(F.when(_page(F.col("year")), F.left(text, F.length(text) - 1)).otherwise(text).alias("value"))
    good, _ = parsers.split_pages(raw, "worldbank")
    countries = d["bronze_population"].select("country_id").distinct().filter("country_id NOT LIKE 'C1_'").select(
        F.concat(F.lit('[{"page":1},'), F.to_json(F.array(F.struct(
            F.col("country_id").alias("id"), F.struct(F.when(F.col("country_id") == "WLD", "NA").otherwise("EU").alias("id"), F.lit("a region").alias("value")).alias("region"),
        ))), F.lit("]")).alias("value")
    )
    return parsers.parse_population(good, parsers.parse_country_metadata(countries)).select("country_id", "country_name", "year", "population", "is_aggregate", "region")


SRC11 = f"""SELECT country_id, 'x' AS country_name, year, population::BIGINT AS population, country_id = 'WLD' OR country_id LIKE 'C1_' AS is_aggregate,
        CASE WHEN country_id NOT LIKE 'C1_' THEN 'a region' END AS region
    FROM bronze_population WHERE year % {EVERY} <> {BROKEN}"""


def src12_phenology(d: Domain) -> DataFrame:
    """Facet counts by month, months without records left out."""
    # Orders counted as the input does, month by month.
    counted = d.driver["orders"].groupBy(
        F.left("o_orderpriority", F.lit(1)).cast("bigint").alias("species_key"), (F.col("o_custkey") % 12).cast("string").alias("location_id"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
    ).agg(F.count(F.lit(1)).alias("n"))
    pages = counted.groupBy("species_key", "location_id", "year").agg(
        F.sum("n").alias("count"), F.collect_list(F.struct(F.col("month").cast("string").alias("name"), F.col("n").alias("count"))).alias("counts")
    )
    value = F.to_json(F.struct("count", F.array(F.struct("counts")).alias("facets")))
    raw = pages.select(
        "species_key", F.lit("s").alias("species_name"), F.lit("c").alias("common_name"), "location_id", F.lit(1.0).alias("bbox_degrees"), "year", value.alias("value")
    )
    kept = ["species_key", "location_id", "year", "total_records", *parsers.MONTH_COLUMNS]
    given = {f.name for f in DATASETS["bronze_phenology"].schema.fields} | {"value"}
    missing = [F.lit(None).alias(c) for c in given - set(raw.columns) - set(parsers.MONTH_COLUMNS) - {"total_records"}]
    return parsers.parse_phenology(raw.select("*", *missing)).select(*kept)


SRC12 = "SELECT species_key, location_id, year, sum(cnt)::BIGINT AS total_records, " + ", ".join(
    f"coalesce(sum(cnt) FILTER (month = {i}), 0)::BIGINT AS {c}" for i, c in enumerate(parsers.MONTH_COLUMNS, 1)
) + " FROM bird_months GROUP BY ALL"


def _track_rows(d: Domain) -> DataFrame:
    """Track points, some of which break one rule or several."""
    rows = d["bronze_cyclones"].select(*DATASETS["bronze_cyclones"].schema.fieldNames())
    hour, minute = F.hour("time"), F.minute("time")
    return rows.withColumns(
        {
            "lat": F.when(hour % 4 == 1, F.col("lat") + 100).otherwise(F.col("lat")),
            "lon": F.when(minute % 5 == 2, F.lit(None)).otherwise(F.col("lon")),
            "usa_sshs": F.when(hour % 6 == 3, F.lit(9)).otherwise(F.col("usa_sshs")),
        }
    )


def val1_rules(d: Domain) -> DataFrame:
    """Rows by the rules they break; none for good ones."""
    good, bad = validation.validate_bronze(_track_rows(d), "bronze_cyclones")
    rows = good.select(F.lit("").alias("failed")).union(bad.select(F.concat_ws("; ", F.array_sort("failed"))))
    return rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


VAL1 = """SELECT array_to_string(list_sort(list_filter([
        CASE WHEN sid IS NULL THEN 'sid required' END, CASE WHEN season IS NULL THEN 'season required' END, CASE WHEN time IS NULL THEN 'time required' END,
        CASE WHEN la IS NULL THEN 'lat required' END, CASE WHEN lo IS NULL THEN 'lon required' END,
        CASE WHEN la NOT BETWEEN -90 AND 90 THEN 'lat in [-90, 90]' END, CASE WHEN lo NOT BETWEEN -180 AND 180 THEN 'lon in [-180, 180]' END,
        CASE WHEN cat NOT BETWEEN -5 AND 5 THEN 'usa_sshs in [-5, 5]' END], lambda x: x IS NOT NULL)), '; ') AS failed, count(*) AS n
    FROM (SELECT *, CASE WHEN hour(time) % 4 = 1 THEN lat + 100 ELSE lat END AS la, CASE WHEN minute(time) % 5 = 2 THEN NULL ELSE lon END AS lo,
          CASE WHEN hour(time) % 6 = 3 THEN 9 ELSE usa_sshs END AS cat FROM bronze_cyclones) GROUP BY 1"""


def _two_batches(d: Domain) -> str:
    root = new_folder(d)
    rows = d["bronze_oni"].select(*DATASETS["bronze_oni"].schema.fieldNames())
    bronze.write_bronze(rows.filter("season_index <= 6"), root, "bronze_oni")
    bronze.write_bronze(rows.filter("season_index > 6"), root, "bronze_oni")
    bronze.write_bronze(_track_rows(d), root, "bronze_cyclones")
    bronze.write_bronze(rows.filter("year < 0"), root, "bronze_oni")
    return root


def snk1_append_and_read(d: Domain) -> DataFrame:
    return bronze.read_bronze(d.spark, _two_batches(d), "bronze_oni").select("year", "season", "season_index", "sst_c", "anomaly_c", "_source", F.col("_ingested_at").isNotNull().alias("stamped"))


SNK1 = "SELECT year, season, season_index, sst_c, anomaly_c, 'noaa_cpc' AS _source, true AS stamped FROM bronze_oni"


def snk3_statistics(d: Domain) -> DataFrame:
    return bronze.bronze_stats(d.spark, _two_batches(d)).filter("files > 0").select("source", "dataset", "rows")


def src2_missing(d: Domain) -> DataFrame:
    """Years of a dataset that is there, beside one that was never ingested."""
    root = _two_batches(d)
    oni, people = (bronze.read_bronze(d.spark, root, n) for n in ("bronze_oni", "bronze_population"))
    by_year = people.groupBy("year").agg(F.sum("population").alias("population"), F.count("country_id").alias("countries"))
    seasons = oni.groupBy("year").agg(F.count(F.lit(1)).alias("seasons"))
    return seasons.join(by_year, "year", "left").select("year", "seasons", "population", F.coalesce("countries", F.lit(0)).alias("countries"))


SRC2 = "SELECT year, count(*) AS seasons, NULL::BIGINT AS population, 0::BIGINT AS countries FROM bronze_oni GROUP BY year"

SNK3 = """SELECT 'noaa_cpc' AS source, 'oni' AS dataset, count(*) AS rows FROM bronze_oni
    UNION ALL SELECT 'ibtracs', 'track_points', count(*) FROM bronze_cyclones"""
