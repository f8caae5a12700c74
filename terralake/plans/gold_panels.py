"""Gold: year and month panels over all sources, and what each column can support."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralake.functions import (
    ace,
    classify,
    mean_if,
    ordered_concat,
    ratio,
    round_if,
    safe_corr,
    sum_if,
)
from terralake.operators.dedup import latest_by
from terralake.operators.joins import panel, stab
from terralake.operators.reshape import month_spine, months_to_rows, spine, union_named, unpivot
from terralake.operators.rows import tag
from terralake.operators.windows import deseason, lag_by, with_regime
from terralake.plans.silver import Tables
from terralake.schemas import MONTH_COLUMNS

# Years covered by the panels.
YEAR_PANEL = (1900, 2026)
MONTH_PANEL = (1950, 2026)


def _present(names: Sequence[str]) -> Column:
    """How many of the listed columns have a value."""
    flags = [F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names]
    total = flags[0]
    for flag in flags[1:]:
        total = total + flag
    return total


def _climate(t: Tables, keys: Sequence[Column], r) -> DataFrame:
    days = t["gold_temperature_anomaly"].filter(F.col("kind") == "observed")
    return days.groupBy(*keys).agg(
        r(F.avg("anomaly_c"), 3).alias("temp_anomaly_mean"),
        r(F.lit(100.0) * mean_if("extreme_heat"), 2).alias("pct_extreme_heat_days"),
        F.count_if("record_heat").alias("heat_records"),
        F.count_distinct("location_id").alias("climate_cities"),
    )


def gold_year_panel(
    t: Tables, rounding: bool = True, years: tuple[int, int] = YEAR_PANEL
) -> DataFrame:
    """One row per year. Every source is reduced to yearly rows before it is joined."""
    r = lambda c, n: round_if(c, n, rounding)
    first, last = years
    base = spine(t["silver_earthquakes"].sparkSession, first, last)

    climate = _climate(t, [F.year("local_date").alias("year")], r)
    basin_ace = lambda b: r(sum_if(F.col("basin") == b, "ace_total"), 1)
    cyclones = t["gold_cyclone_seasons"].groupBy(F.col("season").alias("year")).agg(
        r(F.sum("ace_total"), 1).alias("cyclone_ace_global"),
        F.sum("systems").alias("cyclone_systems"),
        F.sum("hurricanes").alias("hurricanes"),
        F.sum("major_hurricanes").alias("major_hurricanes"),
        F.sum("landfalling").alias("landfalling"),
        basin_ace("NA").alias("ace_atlantic"),
        basin_ace("EP").alias("ace_east_pacific"),
        basin_ace("WP").alias("ace_west_pacific"),
    )
    index = t["silver_oni"]
    enso = index.filter(F.col("season") == "ASO").select(
        "year",
        r("anomaly_c", 2).alias("oni_aso"),
        F.col("phase").alias("enso_phase"),
        F.col("intensity").alias("enso_intensity"),
    )
    enso_year = index.groupBy("year").agg(r(F.avg("anomaly_c"), 3).alias("oni_year_mean"))
    quakes = t["silver_earthquakes"].groupBy(F.year("time").alias("year")).agg(
        F.count(F.lit(1)).alias("quakes_m45"),
        F.count_if(F.col("magnitude") >= 7).alias("quakes_m7"),
        r(F.max("magnitude"), 1).alias("max_magnitude"),
        F.count_if("tsunami").alias("tsunamigenic"),
    )
    sequences = t["gold_aftershock_forecast"].filter("is_predictable").groupBy("year").agg(
        F.count(F.lit(1)).alias("aftershock_sequences")
    )
    disasters = t["silver_historical_disasters"].groupBy("year").agg(
        F.count(F.lit(1)).alias("noaa_disasters"),
        F.sum("deaths_best").alias("disaster_deaths"),
        F.max("deaths_best").alias("deadliest_event_deaths"),
    )
    people = t["gold_world_population"].select(
        "year",
        F.col("population_mid").alias("world_population"),
        F.col("source_kind").alias("population_source"),
    )
    in_order = lambda c: ordered_concat(c, ["start_year", "id"])
    ongoing = stab(
        t["silver_epidemics"], "start_year", F.coalesce("end_year", F.lit(last)), first, last
    )
    epidemics = ongoing.groupBy("year").agg(
        F.count(F.lit(1)).alias("epidemics_active"), in_order("name").alias("epidemic_names")
    )
    marked = stab(
        t["silver_historical_events"], "start_year", F.coalesce("end_year", "start_year"), first, last
    )
    milestones = marked.groupBy("year").agg(
        in_order("name").alias("milestones"),
        F.bool_or(F.col("category") == "observacion").alias("coverage_change"),
    )
    joined = panel(
        base,
        [climate, cyclones, enso, enso_year, quakes, sequences, disasters, people, epidemics, milestones],
        ["year"],
    )
    wide = joined.select(
        "year",
        *("temp_anomaly_mean", "pct_extreme_heat_days", "heat_records"),
        *("cyclone_ace_global", "cyclone_systems", "hurricanes", "major_hurricanes", "landfalling"),
        *("ace_atlantic", "ace_east_pacific", "ace_west_pacific"),
        *("oni_aso", "enso_phase", "enso_intensity", "oni_year_mean"),
        *("quakes_m45", "quakes_m7", "max_magnitude", "tsunamigenic", "aftershock_sequences"),
        *("noaa_disasters", "disaster_deaths", "deadliest_event_deaths"),
        *("world_population", "population_source", "epidemics_active", "epidemic_names", "milestones"),
        _present(
            ["temp_anomaly_mean", "cyclone_ace_global", "oni_aso", "quakes_m45", "noaa_disasters",
             "world_population", "epidemics_active"]
        ).alias("sources_available"),
        F.coalesce("coverage_change", F.lit(False)).alias("milestone_year"),
    )
    return with_regime(wide, "sources_available", ["year"])


def gold_month_panel(
    t: Tables, rounding: bool = True, years: tuple[int, int] = MONTH_PANEL
) -> DataFrame:
    """One row per month, with deseasonalised copies of the seasonal columns."""
    r = lambda c, n: round_if(c, n, rounding)
    base = month_spine(t["silver_earthquakes"].sparkSession, *years)
    month_of = lambda c: [F.year(c).alias("year"), F.month(c).alias("month")]

    oni = t["silver_oni"].select(
        "year",
        F.col("season_index").alias("month"),
        F.col("anomaly_c").alias("oni"),
        F.col("phase").alias("oni_phase"),
        F.col("intensity").alias("oni_intensity"),
    )
    climate = _climate(t, month_of("local_date"), r).drop("heat_records")
    # Storm by storm first: no point is copied for the distinct counts.
    by_storm = t["silver_cyclone_tracks"].groupBy(*month_of("time"), "sid").agg(
        ace("wind_kt", "is_synoptic").alias("ace"), F.bool_or("is_hurricane").alias("hurricane"), F.max("wind_kt").alias("wind")
    )
    tracks = by_storm.groupBy("year", "month").agg(
        r(F.sum("ace"), 3).alias("cyclone_ace"),
        F.count("sid").alias("cyclones_active"),
        F.count_if(F.col("hurricane") & F.col("sid").isNotNull()).alias("hurricanes_active"),
        F.max("wind").alias("max_wind_kt"),
    )
    formed = t["gold_cyclones"].groupBy(*month_of("first_seen")).agg(
        F.count(F.lit(1)).alias("cyclones_formed")
    )
    quakes = t["silver_earthquakes"].groupBy(*month_of("time")).agg(
        F.count(F.lit(1)).alias("quakes_m45"), r(F.max("magnitude"), 1).alias("max_magnitude")
    )
    dated = t["silver_historical_disasters"].filter(F.col("month").isNotNull())
    disasters = dated.groupBy("year", "month").agg(
        F.count(F.lit(1)).alias("noaa_disasters"), F.sum("deaths_best").alias("disaster_deaths")
    )
    newest = latest_by(
        t["bronze_phenology"].drop("_source", "ingest_date"),
        ["species_key", "location_id", "year"],
        ["_ingested_at"],
    )
    counts = months_to_rows(newest.select("year", "is_control", *MONTH_COLUMNS), MONTH_COLUMNS)
    migratory = ~F.coalesce("is_control", F.lit(False))
    birds = counts.groupBy("year", "month").agg(
        F.sum("cnt").alias("bird_records"),
        sum_if(migratory, "cnt").alias("bird_records_migratory"),
    )
    joined = panel(base, [oni, climate, tracks, formed, quakes, disasters, birds], ["year", "month"])
    seasonal = lambda c, n: r(deseason(c, ["month"]), n).alias(f"{c}_deseason")
    return joined.select(
        *("year", "month", "month_start", "oni", "oni_phase", "oni_intensity"),
        *("temp_anomaly_mean", "pct_extreme_heat_days", "climate_cities"),
        *("cyclone_ace", "cyclones_active", "hurricanes_active", "max_wind_kt", "cyclones_formed"),
        *("quakes_m45", "max_magnitude", "noaa_disasters", "disaster_deaths"),
        *("bird_records", "bird_records_migratory"),
        seasonal("cyclone_ace", 3),
        seasonal("cyclones_formed", 3),
        seasonal("hurricanes_active", 3),
        seasonal("bird_records", 1),
        _present(
            ["oni", "temp_anomaly_mean", "cyclone_ace", "quakes_m45", "noaa_disasters", "bird_records"]
        ).alias("sources_available"),
    )


# The numeric columns whose coverage is described.
YEAR_MEASURES = (
    "temp_anomaly_mean", "pct_extreme_heat_days", "heat_records", "cyclone_ace_global",
    "cyclone_systems", "hurricanes", "major_hurricanes", "landfalling", "ace_atlantic",
    "ace_east_pacific", "ace_west_pacific", "oni_aso", "oni_year_mean", "quakes_m45", "quakes_m7",
    "max_magnitude", "tsunamigenic", "aftershock_sequences", "noaa_disasters", "disaster_deaths",
    "world_population", "epidemics_active",
)
MONTH_MEASURES = (
    "oni", "temp_anomaly_mean", "pct_extreme_heat_days", "cyclone_ace", "cyclone_ace_deseason",
    "cyclones_active", "hurricanes_active", "cyclones_formed", "max_wind_kt", "quakes_m45",
    "max_magnitude", "noaa_disasters", "disaster_deaths", "bird_records",
)


def effective_n(n: Column, acf1: Column) -> Column:
    """Independent observations left in n values whose lag-1 correlation is acf1."""
    rho2 = F.coalesce(acf1, F.lit(0.0)) * F.coalesce(acf1, F.lit(0.0))
    return n * (F.lit(1.0) - rho2) / (F.lit(1.0) + rho2)


def gold_panel_coverage(t: Tables, rounding: bool = True) -> DataFrame:
    """Sample size, autocorrelation and honest significance threshold per column."""
    r = lambda c, n: round_if(c, n, rounding)
    yearly = t["gold_year_panel"].withColumn("month", F.lit(1))
    long = union_named(
        [
            tag(unpivot(yearly, ["year", "month"], YEAR_MEASURES), panel="gold_year_panel"),
            tag(unpivot(t["gold_month_panel"], ["year", "month"], MONTH_MEASURES), panel="gold_month_panel"),
        ]
    )
    keys = ["panel", "column_name"]
    paired = long.withColumn("previous", lag_by("value", 1, keys, ["year", "month"]))
    stats = paired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        safe_corr("value", "previous").alias("rho"),
    )
    n = F.col("n_observations").cast("double")
    n_eff = effective_n(n, F.col("rho"))
    naive = F.lit(1.96) / F.sqrt(n)
    honest = F.lit(1.96) / F.sqrt(F.greatest(F.lit(3.0), n_eff))
    # Limits of the effective sample and their verdicts.
    verdicts = [
        (n_eff < 15, "NO analizable: n efectivo minimo"),
        (n_eff < 30, "dudoso: solo efectos enormes"),
        (n_eff < 60, "analizable con cautela"),
    ]
    return stats.select(
        *keys,
        "first_year",
        "last_year",
        "n_observations",
        r("rho", 4).alias("acf1"),
        F.greatest(F.lit(3), F.round(n_eff).cast("int")).alias("n_effective"),
        r(naive, 3).alias("r_threshold_naive"),
        r(honest, 3).alias("r_threshold_honest"),
        r(ratio(honest, naive), 2).alias("naive_underestimates_by"),
        (n_eff >= 30).alias("analyzable"),
        classify(verdicts, "analizable").alias("verdict"),
    )
