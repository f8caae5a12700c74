import json
from datetime import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F

from terralake.schemas import DATASETS, EARTHQUAKES, WEATHER
from terralake.sources import parsers
from terralake.sources.bronze import bronze_stats, empty_bronze, read_bronze, write_bronze
from terralake.sources.seeds import FLAGSHIP_IDS, dim_locations, seed
from terralake.sources.validation import rules_for, validate, validate_bronze


def types(schema):
    return [(f.name, f.dataType) for f in schema.fields]


def documents(spark, tmp_path, **texts):
    for name, value in texts.items():
        (tmp_path / f"{name.replace('_', '-')}.json").write_text(json.dumps(value))
    return parsers.read_documents(spark, str(tmp_path))


def test_weather_blocks_single_and_list(spark, tmp_path):
    """Blocks stand for places by position; a variable that is missing is NULL, a place without hours has no rows."""
    places = dim_locations(spark)
    asked = [r.id for r in places.orderBy("id").limit(3).collect()]

    def block(k, hours):
        return {"hourly": {"time": [f"2031-0{k}-11T{h:02d}:30" for h in range(hours)], "cloud_cover": [float(10 * k + h) if h != 1 else None for h in range(hours)]}}

    for folder, payload, hours in (("object", block(1, 4), [4]), ("list", [block(1, 2), {}, block(3, 5)], [2, 0, 5])):
        (tmp_path / folder).mkdir()
        made = parsers.parse_weather(documents(spark, tmp_path / folder, page=payload), asked, places, "forecast")
        assert types(made.schema) == types(WEATHER)
        got = {(r.location_id, r.time.month, r.time.hour): r for r in made.collect()}
        assert set(got) == {(asked[k], k + 1, h) for k, n in enumerate(hours) for h in range(n)}
        at = {r.id: (r.lat, r.lon) for r in places.collect()}
        for (place, k, h), r in got.items():
            assert (r.lat, r.lon) == at[place] and r.kind == "forecast" and r.temperature_2m is None
            assert r.cloud_cover == (None if h == 1 else 10 * k + h)


def feature(k, **changes):
    """A feature whose every field follows from its number."""
    properties = {"mag": k / 2, "magType": f"t{k}", "time": k * 86_400_000, "updated": k * 86_400_000 + 1, "place": f"place {k}", "type": "earthquake",
                  "tsunami": k % 2, "sig": 10 * k, "alert": "green", "status": "automatic", "felt": 3 * k, "cdi": k / 4, "mmi": k / 8, "net": "n", "url": f"u{k}"}
    coordinates = changes.pop("coordinates", [k * 2.0, -k * 1.0, k * 7.0])
    return {"id": f"e{k}", "geometry": {"coordinates": coordinates} if coordinates is not None else {}, "properties": {f: v for f, v in (properties | changes).items() if v is not ...}}


def test_quakes(spark, tmp_path):
    whole = [feature(k) for k in range(1, 6)]
    thin = [feature(6, coordinates=[1.5, 2.5], alert=None, felt=..., tsunami=..., updated=None)]
    useless = [feature(7, time=...), feature(8, coordinates=[]), feature(9, coordinates=[None, 3.0, 1.0]), feature(10, coordinates=None)]
    df = parsers.parse_quakes(documents(spark, tmp_path, one={"features": useless[:2] + whole}, two={"features": thin + useless[2:]}))
    assert types(df.schema) == types(EARTHQUAKES)
    got = {r.event_id: r for r in df.collect()}
    assert set(got) == {f"e{k}" for k in range(1, 7)}
    for k in range(1, 6):
        r = got[f"e{k}"]
        assert (r.magnitude, r.lon, r.lat, r.depth_km, r.tsunami) == (k / 2, 2.0 * k, -1.0 * k, 7.0 * k, bool(k % 2))
        assert (r.significance, r.felt, r.place, r.network) == (10 * k, 3 * k, f"place {k}", "n")
        assert r.time.timestamp() == k * 86_400 and (r.updated - r.time).microseconds == 1000
    r = got["e6"]
    assert (r.lon, r.lat, r.depth_km, r.alert, r.felt, r.updated, r.tsunami) == (1.5, 2.5, None, None, None, None, False)


def test_birds(spark, tmp_path):
    times = {"2030-11-02 18:05": (datetime(2030, 11, 2, 18, 5), False), "2030-11-03": (datetime(2030, 11, 3), True), "2031-4-7 6:09": (datetime(2031, 4, 7, 6, 9), False)}
    unreadable = ["2030-13-01", "2031-02-29", "dusk", "", "2030-11-02T18:05"]
    items = [{"speciesCode": f"s{k}", "lat": k + 0.5, "lng": -k - 0.5, "subId": f"c{k}", "obsDt": t} for k, t in enumerate([*times, *unreadable])]
    items[1] |= {"howMany": 17, "obsValid": False, "obsReviewed": True}
    got = parsers.parse_birds(documents(spark, tmp_path, some_place=items), 40).orderBy("species_code").collect()
    assert [(r.obs_datetime, r.obs_date_only) for r in got] == list(times.values())
    assert {(r.location_id, r.search_radius_km) for r in got} == {("some-place", 40)}
    assert [(r.lat, r.lon, r.checklist_id) for r in got] == [(k + 0.5, -k - 0.5, f"c{k}") for k in range(3)]
    assert [(r.how_many, r.obs_valid, r.obs_reviewed) for r in got] == [(None, True, False), (17, False, True), (None, True, False)]


def test_hazards(spark, tmp_path):
    """Counts come as integers, decimals or text; the first place name that is not blank is taken."""
    counts = {"whole": (37, 37), "decimal": (52.0, 52), "text": ("64", 64), "words": ("many", None), "none": (None, None)}
    names = [({"locationName": "Port"}, "Port"), ({"locationName": "  ", "location": "Hill"}, "Hill"), ({"location": "Bay"}, "Bay"), ({}, None), ({"locationName": ""}, None)]
    items = [{"id": k, "year": -50 * k, "deaths": given, "injuriesTotal": given, "vei": k, "name": f"mount {k}", **place} for k, ((given, _), (place, _)) in enumerate(zip(counts.values(), names))]
    items += [{"id": 98, "deaths": 1}, {"id": 99, "year": 12, "publish": False}]
    raw = documents(spark, tmp_path, page={"items": items})
    got = {r.source_id: r for r in parsers.parse_hazards(raw, "volcano").collect()}
    assert set(got) == {0, 1, 2, 3, 4, 99}
    for k, ((_, number), (_, place)) in enumerate(zip(counts.values(), names)):
        r = got[k]
        assert (r.deaths, r.injuries_total, r.location_name, r.year, r.volcano_vei) == (number, number, place, -50 * k, k)
        assert (r.volcano_name, r.published, r.month) == (f"mount {k}", True, None)
    assert not got[99].published
    assert parsers.parse_hazards(raw, "tsunami").filter("volcano_name IS NOT NULL OR hazard_type <> 'tsunami'").isEmpty()


@pytest.mark.parametrize(
    "payload, parse",
    [
        ("weather", lambda raw, spark: parsers.parse_weather(raw, ["london"], dim_locations(spark), "observed")),
        ("quakes", lambda raw, spark: parsers.parse_quakes(raw)),
        ("birds", lambda raw, spark: parsers.parse_birds(raw, 1)),
        ("hazards", lambda raw, spark: parsers.parse_hazards(raw, "tsunami")),
        ("worldbank", lambda raw, spark: parsers.parse_country_metadata(raw)),
        ("phenology", lambda raw, spark: parsers.parse_phenology(raw)),
    ],
)
def test_unreadable_pages_are_told(spark, payload, parse):
    """A page that is cut off, is no JSON or holds something else is set aside with a reason, or fails the job."""
    sound = {"weather": '{"hourly":{"time":["2031-01-01T00:00"]}}', "quakes": '{"features":[]}', "birds": "[]", "hazards": '{"items":[]}', "worldbank": '[{"page":1},[]]', "phenology": '{"count":2,"facets":[]}'}[payload]
    pages = {"sound": sound, "blank": " ", "cut": sound[:-1], "words": "service unavailable", "other": '{"error":"quota"}'}
    keys = ["species_key", "species_name", "common_name", "location_id", "bbox_degrees", "is_control", "year"]
    raw = spark.createDataFrame(list(pages.items()), "name string, value string").withColumns({k: F.lit(None).cast("string") for k in keys})
    good, bad = parsers.split_pages(raw, payload)
    assert {r.name for r in good.collect()} == {"sound", "blank"}
    assert {r.name: r.failed for r in bad.collect()} == {"cut": ["page is no JSON"], "words": ["page is no JSON"], "other": [f"page holds no {payload} records"]}
    parse(good, spark).collect()
    for name in ("cut", "words", "other"):
        with pytest.raises(Exception, match=f"unreadable {payload} page"):
            parse(raw.filter(F.col("name") == name), spark).collect()


def test_rows_of_an_unknown_place_are_rejected(spark, tmp_path):
    raw = documents(spark, tmp_path, a=[{"hourly": {"time": ["2031-01-01T00:00"]}}] * 2)
    good, bad = validate_bronze(parsers.parse_weather(raw, ["nowhere"], dim_locations(spark), "observed"), "bronze_weather")
    assert good.isEmpty() and sorted(r.failed for r in bad.collect()) == [["lat required", "lon required"], ["location_id required", "lat required", "lon required"]]


TRACK_HEADER = [
    "SID", "SEASON", "NUMBER", "BASIN", "SUBBASIN", "NAME", "ISO_TIME", "NATURE", "LAT", "LON", "WMO_WIND", "WMO_PRES", "WMO_AGENCY",
    "TRACK_TYPE", "DIST2LAND", "LANDFALL", "IFLAG", "USA_WIND", "USA_PRES", "USA_SSHS", "STORM_SPEED", "STORM_DIR",
]


def _track(**changes):
    row = dict.fromkeys(TRACK_HEADER, "") | {"SID": "S1", "SEASON": "2040", "BASIN": "WP", "ISO_TIME": "2040-06-30 06:00:00", "LAT": "11.25", "LON": "131.5", "TRACK_TYPE": "main"}
    return ",".join((row | changes)[h] for h in TRACK_HEADER)


def test_tracks(spark, tmp_path):
    """One line for each way in which a field may come; lines without a needed field, and units, are no points."""
    lines = {"plain": {"USA_WIND": "35.0", "USA_SSHS": "0"}, "east": {"LON": "181.5"}, "far east": {"LON": "270.25", "USA_SSHS": "-9"}, "west": {"LON": "-180.5"}, "blanks": {"WMO_WIND": "  ", "USA_WIND": "?"}}
    lost = [{h: v} for h in ("SID", "ISO_TIME", "LAT", "LON", "SEASON") for v in ("", " ")] + [{"ISO_TIME": "30/06/2040"}, {"LAT": "north"}]
    units = "," + ",".join(["Year"] + ["unit"] * (len(TRACK_HEADER) - 2))
    path = tmp_path / "tracks.csv"
    path.write_text("\n".join([",".join(TRACK_HEADER), units, *(_track(NAME=n, **c) for n, c in lines.items()), *(_track(NAME="lost", **c) for c in lost), "S1,2040"]) + "\n")
    got = {r.name: r for r in parsers.parse_tracks(spark, str(path)).collect()}
    assert set(got) == set(lines)
    assert (got["plain"].sid, got["plain"].season, got["plain"].basin, got["plain"].time, got["plain"].lat) == ("S1", 2040, "WP", datetime(2040, 6, 30, 6), 11.25)
    assert (got["plain"].usa_wind_kt, got["plain"].usa_sshs) == (35.0, 0)
    assert [got[n].lon for n in lines] == pytest.approx([131.5, -178.5, -89.75, 179.5, 131.5])
    assert got["far east"].usa_sshs is None and (got["blanks"].wmo_wind_kt, got["blanks"].usa_wind_kt) == (None, None)


def test_oni(spark, tmp_path):
    """Every season of two years, among lines that are none."""
    values = {(y, k): (24 + k / 8, (k - y % 2 * 6) / 8) for y in (2040, 2041) for k in range(1, 13)}
    lines = [f" {parsers.ONI_SEASONS[k - 1]}  {y}  {total}   {anomaly}" for (y, k), (total, anomaly) in values.items()]
    noise = ["SEAS  YR   TOTAL   ANOM", "", " QQQ 2040 1 2", " DJF 2040 24.0", " DJF 2040 24.0 0.5 7", " JJA year 24.0 0.5", " JJA 2040 warm 0.5"]
    path = tmp_path / "oni.txt"
    path.write_text("\n".join(line for pair in zip(lines, noise * 4) for line in pair) + "\n")
    assert {(r.year, r.season_index): (r.sst_c, r.anomaly_c) for r in parsers.parse_oni(spark, str(path)).collect()} == values


def test_population(spark, tmp_path):
    """A country, an aggregate, one that the list lacks and one without a code; zero and absent values are unknown."""
    (tmp_path / "m").mkdir(), (tmp_path / "p").mkdir()
    listed = [{"id": "AAA", "iso2Code": "AA", "region": {"id": "R1", "value": " North "}, "incomeLevel": {"value": "Low"}}, {"id": "SUM", "iso2Code": "S1", "region": {"id": "NA", "value": "Aggregates"}, "incomeLevel": {"value": " "}}]
    entry = lambda code, iso, name, year, value: {"countryiso3code": code, "country": {"id": iso, "value": name}, "date": year, "value": value}
    rows_ = [entry("AAA", "AA", "Aland ", "2040", 1234567), entry("AAA", "AA", "Aland", "2041", 0), entry("SUM", "S1", "All", "2040", None), entry("BBB", "BB", "Bland", "2040", 5), entry("", "Q1", "Group", "x", 9)]
    metadata = parsers.parse_country_metadata(documents(spark, tmp_path / "m", x=[{"page": 1}, listed]))
    got = {(r.country_id, r.year): r for r in parsers.parse_population(documents(spark, tmp_path / "p", x=[{"page": 1}, rows_]), metadata).collect()}
    assert {k: (r.population, r.is_aggregate, r.region) for k, r in got.items()} == {
        ("AAA", 2040): (1234567, False, "North"), ("AAA", 2041): (None, False, "North"), ("SUM", 2040): (None, True, "Aggregates"), ("BBB", 2040): (5, True, None), ("Q1", None): (9, True, None)}
    assert got["AAA", 2040].country_name == "Aland" and got["SUM", 2040].income_level is None


def test_phenology(spark):
    facet = {"count": 30, "facets": [{"counts": [{"name": "3", "count": 20}, {"name": "12", "count": 10}]}]}
    keys = (9515886, "Hirundo rustica", "Golondrina", "madrid", 1.0, False, 2015)
    raw = spark.createDataFrame(
        [(*keys, json.dumps(facet)), (*keys[:-1], 2016, json.dumps({"count": 0, "facets": []}))],
        "species_key bigint, species_name string, common_name string, location_id string, bbox_degrees double, is_control boolean, year bigint, value string",
    )
    a, b = parsers.parse_phenology(raw).orderBy("year").collect()
    assert (a.total_records, a.m01, a.m03, a.m12) == (30, 0, 20, 10)
    assert (b.total_records, b.m03) == (0, 0)


def test_validation_splits_and_names_the_broken_rules(spark):
    quake = {"source_id": 1, "hazard_type": "earthquake", "year": 1900, "published": True}
    df = spark.createDataFrame(
        [(1, "earthquake", 1900, 2, None, True), (2, "meteor", 1900, 9, 3, True), (3, "volcano", None, None, 8, True)],
        "source_id bigint, hazard_type string, year bigint, deaths_order bigint, volcano_vei bigint, published boolean",
    )
    df = df.withColumns({c: F.lit(None).cast("bigint") for c in ("injuries_order", "damage_order", "deaths_order_total")})
    good, bad = validate(df, rules_for("bronze_noaa_eq"))
    assert rows(good.select("source_id")) == [(1,)] and quake["source_id"] == 1
    failed = {r.source_id: set(r.failed) for r in bad.collect()}
    assert failed == {2: {"hazard_type known", "deaths_order in [0, 4]"}, 3: {"year required"}}


def test_validation_rejects_unknown_columns(spark):
    with pytest.raises(ValueError, match="surprise"):
        validate_bronze(empty_bronze(spark, "bronze_oni").select(F.lit(1).alias("surprise")), "bronze_oni")


def test_bronze_appends_and_matches_columns_by_name(spark, tmp_path):
    root = str(tmp_path)
    wide = spark.sql("SELECT 'madrid' location_id, timestamp'2024-01-01 00:00:00' time, 'observed' kind, 1.5D temperature_2m, 3D wind_speed_10m")
    narrow = spark.sql("SELECT 2.5D temperature_2m, 'forecast' kind, 'london' location_id, timestamp'2024-01-01 00:00:00' time")
    assert write_bronze(wide, root, "bronze_weather", datetime(2024, 1, 2, 3))
    assert write_bronze(narrow, root, "bronze_weather", datetime(2024, 1, 3, 3))
    assert not write_bronze(narrow.filter("false"), root, "bronze_weather")
    got = read_bronze(spark, root, "bronze_weather").orderBy("_ingested_at").collect()
    assert [(r.location_id, r.temperature_2m, r.wind_speed_10m, r._source, str(r.ingest_date)) for r in got] == [
        ("madrid", 1.5, 3.0, "open_meteo", "2024-01-02"), ("london", 2.5, None, "open_meteo", "2024-01-03")]
    assert list((tmp_path / "open_meteo/weather_hourly/ingest_date=2024-01-02").glob("*.zstd.parquet"))
    stats = {(r.source, r.dataset): r for r in bronze_stats(spark, root).collect()}
    assert (stats["open_meteo", "weather_hourly"].files, stats["open_meteo", "weather_hourly"].rows) == (2, 2) and stats["open_meteo", "weather_hourly"].bytes > 0
    assert (stats["noaa_cpc", "oni"].files, stats["noaa_cpc", "oni"].rows, stats["noaa_cpc", "oni"].bytes) == (0, 0, 0) and len(stats) == 13


@pytest.mark.parametrize("table", sorted(DATASETS))
def test_a_dataset_that_was_never_ingested_is_empty_and_typed(spark, tmp_path, table):
    df = read_bronze(spark, str(tmp_path), table)
    assert df.isEmpty()
    assert df.schema.fieldNames()[-3:] == ["_ingested_at", "_source", "ingest_date"]
    assert [f.dataType for f in df.schema.fields[:-3]] == [f.dataType for f in DATASETS[table].schema.fields]


def test_seeds(spark):
    from terralake.plans.checks import check_seeds
    from zoneinfo import ZoneInfo

    assert [r.name for r in check_seeds(spark).collect() if not r.passed] == []
    sizes = {"dim_locations": 49, "epidemics": 22, "world_population": 17, "historical_events": 20, "sources": 9, "null_findings": 10}
    assert {name: seed(spark, name).count() for name in sizes} == sizes
    places = dim_locations(spark).collect()
    for place in places:
        ZoneInfo(place.timezone)
    assert max(p.lat for p in places) > 65 and min(p.lat for p in places) < -50
    flagships = dim_locations(spark, flagships_only=True).collect()
    assert len(flagships) == len(FLAGSHIP_IDS) == 12 and len({p.koppen for p in flagships}) >= 9
    middle = {r.year: (r.population_low + r.population_high) / 2 for r in seed(spark, "world_population").collect()}
    assert middle[1400] < middle[1300]
    restricted = {r.id for r in seed(spark, "sources").collect() if r.commercial_use != "permitido"}
    assert restricted == {"open-meteo", "ebird", "gbif"}


def test_ingest_appends_good_rows_and_returns_the_rest(spark, tmp_path):
    from terralake.sources.ingest import ingest

    path = tmp_path / "oni.txt"
    path.write_text(" DJF 1950  25.01  -1.32\n JFM 1950 25.4 -1.1\n")
    parsed = parsers.parse_oni(spark, str(path))
    spoiled = parsed.withColumn("season_index", F.when(F.col("season") == "JFM", 13).otherwise(F.col("season_index")))
    rejected = ingest(spoiled.select(*parsed.columns), str(tmp_path / "lake"), "bronze_oni")
    assert rows(read_bronze(spark, str(tmp_path / "lake"), "bronze_oni").select("season")) == [("DJF",)]
    assert rows(rejected.select("season", "failed")) == [("JFM", ["season_index in [1, 12]"])]


def test_unreadable_hour_is_left_to_validation(spark, tmp_path):
    raw = documents(spark, tmp_path, a={"hourly": {"time": ["not a time"], "temperature_2m": [1.0]}})
    good, bad = validate_bronze(parsers.parse_weather(raw, ["madrid"], dim_locations(spark), "observed"), "bronze_weather")
    assert good.isEmpty() and bad.first().failed == ["time required"]
