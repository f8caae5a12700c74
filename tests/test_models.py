from datetime import datetime

import pytest
from helpers import BUILD_OPTIONS, executed_plan, rows
from pyspark.sql import functions as F

from terralake.plans import queries as q
from terralake.plans import silver
from terralake.plans.build import MODELS, LazyTables, build, clustered, load
from terralake.plans.checks import CHECKS, check
from terralake.schemas import DATASETS, with_provenance
from terralake.sources.bronze import bronze_tables, empty_bronze
from terralake.sources.seeds import dim_locations
from workload.domain import OPTIONS


def bronze(spark, table, *records):
    schema = with_provenance(DATASETS[table].schema)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in records], schema)


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def test_newest_revision_deleted_brings_back_the_last_valid_one(spark):
    base = {"event_id": "a", "event_type": "earthquake", "time": at(1), "lat": 0.0, "lon": 0.0, "magnitude": 5.0}
    t = {"bronze_quakes": bronze(
        spark, "bronze_quakes",
        base | {"updated": at(2), "_ingested_at": at(3), "status": "reviewed", "magnitude": 5.2},
        base | {"updated": at(4), "_ingested_at": at(5), "status": "deleted"},
        base | {"updated": None, "_ingested_at": at(9), "status": None},
        base | {"event_id": "b", "event_type": "quarry blast", "updated": at(2)},
        base | {"event_id": "c", "magnitude": None, "updated": at(2)},
        base | {"event_id": "d", "depth_km": 69.9}, base | {"event_id": "e", "depth_km": 70.0}, base | {"event_id": "f", "depth_km": None},
    )}
    got = {r.event_id: (r.magnitude, r.depth_class) for r in silver.silver_earthquakes(t).collect()}
    assert got == {"a": (5.2, "profundo"), "d": (5.0, "superficial"), "e": (5.0, "intermedio"), "f": (5.0, "profundo")}


def test_tracks_and_population_filter_after_ranking(spark):
    point = {"sid": "s", "season": 2020, "time": at(1, 6), "lat": 0.0, "lon": 0.0, "wmo_wind_kt": 30.0}
    t = {
        "bronze_cyclones": bronze(
            spark, "bronze_cyclones",
            point | {"track_type": "main", "_ingested_at": at(1)}, point | {"track_type": "spur", "_ingested_at": at(2)},
            point | {"time": at(1, 3), "track_type": "main", "usa_wind_kt": 64.0}, point | {"time": at(1, 12), "track_type": "main"},
        ),
        "bronze_population": bronze(
            spark, "bronze_population",
            {"country_id": "A", "year": 2000, "population": 5, "_ingested_at": at(1)},
            {"country_id": "A", "year": 2000, "population": None, "_ingested_at": at(2)},
        ),
    }
    got = {r.time.hour: (r.is_synoptic, r.wind_kt, r.is_hurricane) for r in silver.silver_cyclone_tracks(t).collect()}
    assert got == {3: (False, 64.0, True), 12: (True, 30.0, False)}
    assert silver.silver_population(t).count() == 0


@pytest.mark.parametrize("anomaly, phase, strength", [
    (2.6, "El Niño", "El Niño muy fuerte"), (0.5, "El Niño", "El Niño débil"), (0.49, "Neutral", "Neutral"), (0.0, "Neutral", "Neutral"),
    (-0.49, "Neutral", "Neutral"), (-0.5, "La Niña", "La Niña débil"), (-1.9, "La Niña", "La Niña fuerte"),
])
def test_enso_phase(spark, anomaly, phase, strength):
    t = {"bronze_oni": bronze(spark, "bronze_oni", {"year": 2000, "season": "ASO", "season_index": 9, "sst_c": 0.0, "anomaly_c": anomaly})}
    got = silver.silver_oni(t).first()
    assert (got.phase, got.intensity) == (phase, strength)


def test_disaster_dates_and_best_counts(spark):
    base = {"hazard_type": "earthquake", "published": True}
    t = {
        "bronze_noaa_eq": bronze(
            spark, "bronze_noaa_eq",
            base | {"source_id": 1, "year": -4360, "month": 1, "day": 2, "deaths": 5, "deaths_total": 9},
            base | {"source_id": 2, "year": 2023, "month": 2, "day": 30, "deaths": 5},
            base | {"source_id": 3, "year": 2023, "month": 2}, base | {"source_id": 4, "year": 2023}, base | {"source_id": 5},
        ),
        "bronze_noaa_tsunami": empty_bronze(spark, "bronze_noaa_tsunami"),
        "bronze_noaa_volcano": bronze(spark, "bronze_noaa_volcano", {"source_id": 1, "hazard_type": "volcano", "year": 1, "published": True}),
    }
    got = silver.silver_historical_disasters(t).withColumn("event_date", F.col("event_date").cast("string"))
    seen = {(r.hazard_type, r.source_id): (r.event_date, r.date_precision, r.century, r.deaths_best) for r in got.collect()}
    assert seen == {
        ("earthquake", 1): ("-4360-01-02", "fecha completa", -44, 9), ("earthquake", 2): (None, "fecha completa", 21, 5),
        ("earthquake", 3): (None, "año y mes", 21, None), ("earthquake", 4): (None, "solo año", 21, None),
        ("volcano", 1): (None, "solo año", 1, None),
    }


def test_models_run_before_anything_was_ingested(spark, tmp_path):
    inputs = bronze_tables(spark, str(tmp_path / "nothing")) | {"dim_locations": dim_locations(spark)}
    lazy = LazyTables(inputs)
    for name in MODELS:
        df = lazy[name]
        assert df.columns, name
    assert lazy["gold_quakes_near_city"].count() == 0
    assert lazy["gold_year_panel"].count() == 127 and lazy["gold_month_panel"].count() == 924


def test_build_is_idempotent(spark, built):
    first = {name: built["tables"][name].count() for name in MODELS}
    again = build(spark, f"{built['root']}/bronze", f"{built['root']}/out2", OPTIONS | BUILD_OPTIONS)
    assert {name: again[name].count() for name in MODELS} == first
    assert [n for n, c in first.items() if c == 0] == []
    for name in ("gold_quake_sequences", "gold_disasters_ranked", "gold_cyclones", "gold_world_population", "gold_year_panel"):
        a, b = built["tables"][name], again[name]
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), name
    assert set(load(spark, f"{built['root']}/out2")) == {"dim_locations", *MODELS}


def test_rounding_is_applied_in_the_build(built):
    row = built["tables"]["gold_quake_b_value"].filter("scope = 'global'").first()
    assert row.b_value == round(row.b_value, 3) and row.b_std_error == round(row.b_std_error, 4)
    assert row.b_value == pytest.approx(1.0, abs=0.3)


def test_no_model_plans_a_nested_loop(spark, built):
    lazy = LazyTables({k: v for k, v in built["tables"].items()} | bronze_tables(spark, f"{built['root']}/bronze"), options=OPTIONS)
    for name in MODELS:
        plan = executed_plan(lazy.model(name))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_first_year_has_regime_zero_and_no_change_flag(built):
    first = built["tables"]["gold_year_panel"].orderBy("year").first()
    assert first.coverage_regime == 0 and first.coverage_regime_change is None


def test_checks_that_do_not_depend_on_real_data(built):
    real_only = {
        "heat_risk_is_withheld", "aftershocks_are_summed", "aftershocks_are_heavy_tailed", "declustering_keeps_most_mains",
        "coverage_grows", "deseasoning_lowers_acf", "most_cities_amplified", "regimes_are_contiguous",
        "models_have_enough_cuts", "some_model_varies_over_cuts", "deseasoned_mean_is_zero",
    }
    result = check(built["tables"], skip=real_only).collect()
    assert [r.name for r in result if not r.passed] == []
    assert {r.name for r in result} | real_only == {c.__name__ for c in CHECKS}
    everything = check(built["tables"]).collect()
    assert len(everything) == len(CHECKS) and all(r.observed for r in everything)


def test_a_check_fails_on_bad_data(spark, built):
    table = built["tables"]["gold_model_skill"].withColumns({"should_display": F.lit(True), "improvement_min": F.lit(-1.0)})
    names = {r.name for r in check(dict(built["tables"]) | {"gold_model_skill": table}).collect() if not r.passed}
    assert "published_models_never_harm" in names


def test_queries_run_on_built_tables(spark, built):
    t = built["tables"]
    assert {r.dataset for r in q.q_health(t).collect()} >= {"earthquakes", "birds"}
    assert q.q_locations(t).count() == 49
    assert q.q_cyclones(t, limit=10**9).count() == t["gold_cyclones"].filter("max_wind_kt >= 0").count()
    quakes = t["silver_earthquakes"].filter("magnitude >= -100").count()
    assert q.q_quakes(t, min_magnitude=-100, limit=10**7).count() == quakes
    for refused in (lambda: q.q_quakes(t, limit=0), lambda: q.q_quakes(t, near="x", radius_km=3000), lambda: q.q_cyclones_near(t, "x", 501)):
        with pytest.raises(ValueError):
            refused()
    assert q.q_aftershocks(t)["recent_sequences"].isEmpty()
    deaths = [r.deaths for r in q.q_disasters(t, hazard="volcano", min_deaths=10, limit=5).collect()]
    assert deaths == sorted(deaths, reverse=True) and len(deaths) == 5
    assert q.q_nulls(spark).count() == 10 and q.q_sources(spark).count() == 9
    assert rows(q.q_year_panel(t, 1994, 1996, regime=10**6)["rows"]) == []


def test_export_writes_the_same_rows_twice_and_retires_stale_routes(spark, built, tmp_path):
    from terralake.plans.export import ROUTES, export_marts
    from pathlib import Path

    def content(root):
        return {
            str(p.relative_to(root).parent): "".join(f.read_text() for f in sorted(p.parent.glob("*.json")))
            for p in sorted(root.rglob("*.json")) if "manifest" not in str(p)
        }

    a, b = tmp_path / "a", tmp_path / "b"
    manifest = {r.route: r.rows for r in export_marts(spark, built["tables"], str(a), "1990-01-01").collect()}
    retired = b / "patterns" / "old"
    retired.mkdir(parents=True)
    (retired / "part-0.json").write_text("{}")
    (b / "manifest").mkdir()
    (b / "manifest" / "part-0.json").write_text('{"route":"patterns/old","rows":1}\n')
    export_marts(spark, built["tables"], str(b), "1990-01-01")
    assert content(a) == content(b) and not retired.exists()
    assert not any("null" in route for route in manifest) and len(manifest) > len(ROUTES)
    assert manifest["locations/all"] == 49 and manifest["panels/month/all"] == 77 * 12
    assert Path(a / "locations" / "all").exists()


def test_a_filter_on_one_place_reads_few_files(spark, tmp_path):
    """Ranges of the order make files of few places, also where one place holds a third of all rows; nothing is lost."""
    from pyarrow import parquet
    from terralake.plans.build import save

    place = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.lpad((F.col("id") % 40).cast("string"), 2, "0")))
    days = spark.range(0, 40_000, 1, 8).select(place.alias("location_id"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 9000).cast("int")).alias("local_date"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        saved = save(days, str(tmp_path), "gold_weather_daily")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    spans = [parquet.read_metadata(f.removeprefix("file://")).row_group(0).column(0).statistics for f in saved.inputFiles()]
    assert len(spans) == 16 and sum(s.min <= "p07" <= s.max for s in spans) <= 2 and 4 <= sum(s.min <= "hot" <= s.max for s in spans) <= 8
    one = saved.filter("location_id = 'p07'")
    expected = days.filter("location_id = 'p07'").count()
    assert len(one.collect()) == expected
    plan = one._jdf.queryExecution().executedPlan()
    scanned = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    assert expected <= scanned <= 40_000 / 4
    assert sorted(rows(saved)) == sorted(rows(days))


def test_near_events_lie_in_few_files(spark, tmp_path):
    """Files of the curve through space and time span small boxes."""
    from terralake.functions.scalar import space_time_cell

    at = spark.createDataFrame([(-90.0, -180.0, "1900-01-01"), (89.9, 179.9, "2099-12-01"), (95.0, 500.0, "2500-01-01"), (None, None, None), (10.0, 10.0, "2010-01-10"), (10.01, 10.01, "2010-01-11")], "lat double, lon double, time string")
    cells = [r[0] for r in at.select(space_time_cell("lat", "lon", F.col("time").cast("timestamp"))).collect()]
    assert cells[0] == cells[3] == 0 and cells[2] == 2**30 - 1 >= cells[1] > 2**29 and cells[4] == cells[5]
    grid = spark.range(64 * 64).select((F.col("id") % 64 * 2.8 - 89).alias("lat"), (F.floor(F.col("id") / 64) * 5.6 - 179).alias("lon"), F.lit("2001-05-05").cast("timestamp").alias("time"))
    keyed = grid.repartitionByRange(16, space_time_cell("lat", "lon", "time"))
    boxes = keyed.groupBy(F.spark_partition_id()).agg(((F.max("lat") - F.min("lat")) * (F.max("lon") - F.min("lon"))).alias("box")).collect()
    assert sorted(r.box for r in boxes)[len(boxes) // 2] < 180 * 360 / 6


def test_the_order_of_a_table_is_computed_once_a_row(spark):
    """A sort compares columns: with an expression as its key it would compute that for each two rows."""
    quakes = spark.range(100).selectExpr(
        "id AS event_id", "id % 7 * 10D AS lat", "id % 11 * 10D AS lon", "timestamp_seconds(id * 86400) AS time"
    )
    ordered = clustered(quakes, "silver_earthquakes")
    assert ordered.columns == quakes.columns and sorted(rows(ordered)) == sorted(rows(quakes))
    orders = [line for line in executed_plan(ordered).splitlines() if " Sort " in line or "rangepartitioning" in line]
    assert len(orders) >= 2 and not any("shiftleft" in line or "floor" in line.lower() for line in orders)


def test_a_failed_second_build_leaves_the_old_table(spark, tmp_path):
    from terralake.plans.build import save, versions

    save(spark.range(5).toDF("v"), str(tmp_path), "silver_oni")
    broken = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("bigint").alias("v"))
    with pytest.raises(Exception, match="lost"):
        save(broken, str(tmp_path), "silver_oni")
    assert sorted(rows(load(spark, str(tmp_path))["silver_oni"])) == [(k,) for k in range(5)]
    begun = load(spark, str(tmp_path))["silver_oni"]
    save(spark.range(7).toDF("v"), str(tmp_path), "silver_oni")
    assert begun.count() == 5 and load(spark, str(tmp_path))["silver_oni"].count() == 7
    save(spark.range(9).toDF("v"), str(tmp_path), "silver_oni")
    assert len(versions(spark, str(tmp_path), "silver_oni")) == 2


def test_a_second_session_does_not_touch_staged_tables(spark):
    from helpers import SF
    from workload.domain import Domain

    first = Domain(spark, SF)
    table = first["silver_oni"]
    n = table.count()
    assert Domain(spark.newSession(), SF)["silver_oni"].count() == n == table.count()


def test_a_cluster_without_a_shared_folder_is_refused():
    from terralake.session import ensure_checkpoint_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session)
