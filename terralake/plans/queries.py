"""Read queries over the built tables.

A query returns a DataFrame, or a dict of them where it has several parts. Every
order ends in a unique key. Row limits are arguments without a ceiling; what cannot be
answered in full is refused with a ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralake.functions import mean_if, ratio, ratio_of_sums, round_if, safe_corr
from terralake.operators.joins import with_scalar
from terralake.operators.reshape import union_all
from terralake.operators.rows import distinct_top_k, opt, since, sort_by, sort_first, top_k, where_opt
from terralake.plans.gold_cyclones import PASSAGE_KM
from terralake.plans.gold_quakes import NEAR_KM
from terralake.plans.silver import Tables
from terralake.sources.seeds import seed

Parts = dict[str, DataFrame]


def _limit(n: int) -> int:
    if n < 1:
        raise ValueError(f"a limit must be at least 1, not {n}")
    return n


def _within(km: float, built_km: float) -> float:
    if km > built_km:
        raise ValueError(f"the built table reaches {built_km} km, not {km}; build it with a larger radius")
    return km


def _date(value: str) -> Column:
    return F.lit(value).cast("date")


def _eq(c: str):
    return lambda v: F.col(c) == F.lit(v)


def _at_least(c: str):
    return lambda v: F.col(c) >= v


def _at_most(c: str):
    return lambda v: F.col(c) <= v


# --- Freshness, places, weather -------------------------------------------


def q_health(t: Tables) -> DataFrame:
    """Newest instant per dataset: a pipeline can be alive and weeks behind."""
    newest = lambda table, c, name: t[table].agg(
        F.lit(name).alias("dataset"), F.max(c).cast("string").alias("latest")
    )
    day = lambda kind: F.when(F.col("kind") == kind, F.col("local_date"))
    return union_all(
        [
            newest("gold_weather_daily", day("observed"), "weather_observed"),
            newest("gold_weather_daily", day("forecast"), "weather_forecast"),
            newest("silver_earthquakes", "time", "earthquakes"),
            newest("gold_bird_daily", "obs_date", "birds"),
        ]
    )


def q_locations(t: Tables) -> DataFrame:
    """Places, flagged when they have enough history for a climatology."""
    known = t["gold_climatology"].select(F.col("location_id").alias("id")).distinct()
    known = known.withColumn("has_climatology", F.lit(True))
    places = t["dim_locations"].join(known, "id", "left")
    cols = ("id", "name", "country", "lat", "lon", "timezone", "koppen", "seismic_level", "flyway")
    flag = F.coalesce("has_climatology", F.lit(False)).alias("has_climatology")
    return sort_by(places.select(*cols, flag), ["name", "id"])


def q_weather_daily(
    t: Tables, location: str, start: str | None = None, end: str | None = None,
    kind: str | None = None, limit: int = 400,
) -> DataFrame:
    rows = where_opt(
        t["gold_weather_daily"],
        _eq("location_id")(location),
        opt(start, lambda d: F.col("local_date") >= _date(d)),
        opt(end, lambda d: F.col("local_date") <= _date(d)),
        opt(kind, _eq("kind")),
    ).select(
        "location_id", "local_date", "kind", "temp_mean", "temp_min", "temp_max", "temp_range",
        "apparent_max", "precip_sum", "pressure_msl_mean", "humidity_mean", "wind_gust_max", "hours",
    )
    return top_k(rows, ["-local_date", "kind"], _limit(limit))


def q_weather_anomaly(
    t: Tables, location: str, start: str | None = None, end: str | None = None, limit: int = 400
) -> DataFrame:
    rows = where_opt(
        t["gold_temperature_anomaly"],
        _eq("location_id")(location),
        opt(start, lambda d: F.col("local_date") >= _date(d)),
        opt(end, lambda d: F.col("local_date") <= _date(d)),
    ).select(
        "location_id", "local_date", "kind", "temp_mean", "clim_mean", "anomaly_c", "z_score",
        "temp_max", "clim_max_p95", "clim_max_record", "extreme_heat", "record_heat",
        "extreme_cold", "record_cold", "in_baseline", "clim_n_samples",
    )
    return top_k(rows, ["-local_date", "kind"], _limit(limit))


def q_climatology(t: Tables, location: str) -> DataFrame:
    rows = t["gold_climatology"].filter(_eq("location_id")(location)).drop("location_id")
    return sort_by(rows, ["doy"])


# --- Earthquakes ------------------------------------------------------------

_QUAKE_COLUMNS = ("magnitude", "magnitude_type", "depth_km", "depth_class", "place")


def q_quakes(
    t: Tables, near: str | None = None, radius_km: float = NEAR_KM, min_magnitude: float = 4.5,
    days_back: int | None = None, limit: int = 200, as_of: str | None = None, built_km: float = NEAR_KM,
) -> DataFrame:
    """Newest events, worldwide or around a city, at most as far off as the pairs that were built."""
    tail = ("lat", "lon", "tsunami", "alert", "url")
    if near is None:
        rows = t["silver_earthquakes"].select("event_id", "time", *_QUAKE_COLUMNS, *tail)
    else:
        rows = where_opt(
            t["gold_quakes_near_city"], _eq("location_id")(near), _at_most("distance_km")(_within(radius_km, built_km))
        ).select("event_id", "time", "local_time", *_QUAKE_COLUMNS, "distance_km", *tail)
    rows = since(rows.filter(F.col("magnitude") >= min_magnitude), "time", days_back, as_of)
    return top_k(rows, ["-time", "event_id"], _limit(limit))


def q_gutenberg_richter(t: Tables) -> Parts:
    return {
        "distribution": sort_by(t["gold_quake_magnitude_frequency"], ["mag_bin"]),
        "b_values": sort_by(t["gold_quake_b_value"], ["-n_events", "scope"]),
    }


def q_omori(t: Tables, min_sequence: int = 20, rounding: bool = True) -> Parts:
    """Decay by day. Means are high on late days: sequences without a row do not count."""
    days = t["gold_quake_sequences"]
    decay = days.filter(F.col("day_after") <= 30).groupBy("day_after").agg(
        F.count_distinct("mainshock_id").alias("sequences_active"),
        F.sum("aftershocks").alias("aftershocks_total"),
        round_if(F.avg("aftershocks"), 2, rounding).alias("aftershocks_mean"),
    )
    largest = distinct_top_k(
        days.filter(F.col("sequence_total") >= min_sequence),
        ["mainshock_id", "mainshock_place", "mainshock_mag", "mainshock_time", "sequence_total"],
        ["-sequence_total", "mainshock_id"],
        20,
    )
    return {"decay": sort_by(decay, ["day_after"]), "largest_sequences": largest}


def q_seismic_weather_myth(t: Tables) -> DataFrame:
    return sort_by(t["gold_quake_pressure_test"], ["-total_quakes", "location_id"])


def q_aftershocks(t: Tables, limit: int = 30, rounding: bool = True) -> Parts:
    """Forecast of days 2 to 8, empty unless the model passes its publication gate."""
    r = lambda c, n: round_if(c, n, rounding)
    skill = t["gold_model_skill"].filter(_eq("model_id")("pronostico_replicas"))
    gate = skill.select(
        "improvement_median", "improvement_min", "improvement_max", "n_cuts", "should_display"
    ).distinct()
    known = t["gold_aftershock_forecast"].filter("is_predictable")
    alpha = known.agg(ratio_of_sums("y_days_2_8", "n1"))
    open_gate = gate.agg(F.coalesce(F.bool_and("should_display"), F.lit(False)))
    rows = with_scalar(with_scalar(known, alpha, "alpha"), open_gate, "shown").filter("shown")
    expected = F.col("alpha") * F.col("n1")
    # Factors of the forecast interval; the distribution is heavy-tailed.
    forecast = rows.select(
        *("mainshock_id", "mainshock_time", "mainshock_mag", "place", "lat", "lon", "depth_km"),
        *("mag_band", "n1"),
        F.col("y_days_2_8").alias("observed_days_2_8"),
        r(expected, 1).alias("predicted_days_2_8"),
        r(F.lit(0.55) * expected, 0).alias("predicted_low"),
        r(F.lit(1.85) * expected, 0).alias("predicted_high"),
    )
    recent = top_k(forecast, ["-mainshock_time", "mainshock_id"], _limit(limit))
    return {"recent_sequences": recent, "skill": gate}


# --- Climate ----------------------------------------------------------------


def q_warming(t: Tables, rounding: bool = True) -> DataFrame:
    r = lambda c, n: round_if(c, n, rounding)
    days = t["gold_temperature_anomaly"].filter(_eq("kind")("observed"))
    by_year = days.groupBy(F.year("local_date").alias("year")).agg(
        r(F.avg("anomaly_c"), 3).alias("anomaly_mean_c"),
        r(F.lit(100.0) * mean_if("extreme_heat"), 1).alias("pct_extreme_heat_days"),
        F.count_if("record_heat").alias("heat_records"),
        F.count_distinct("location_id").alias("locations"),
        F.count(F.lit(1)).alias("days"),
    )
    return sort_by(by_year, ["year"])


def q_heatwave(t: Tables, min_train: int = 100) -> Parts:
    model = t["gold_heatwave_model"].filter(F.col("n_train") >= min_train)
    pooled = _eq("scope")("GLOBAL")
    return {
        "model": sort_by(model, ["-p_extreme", "anomaly_bucket", "enso_bucket"]),
        "backtest": sort_first(t["gold_heatwave_backtest"], pooled, ["-brier_skill_score", "scope"]),
    }


def q_heat_thresholds(t: Tables, rounding: bool = True) -> Parts:
    drift = t["gold_heat_threshold_drift"]
    link = drift.agg(
        round_if(safe_corr("temp_variability_sd", "amplification"), 3, rounding).alias("r"),
        F.count(F.lit(1)).alias("n"),
    )
    return {"cities": sort_by(drift, ["-amplification", "location_id"]), "variability_correlation": link}


# --- Birds ------------------------------------------------------------------


def q_birds_summary(t: Tables, rounding: bool = True) -> Parts:
    """Richness per place, and how much of it is latitude and how much effort."""
    r = lambda c, n: round_if(c, n, rounding)
    places = t["dim_locations"].select(
        F.col("id").alias("location_id"), F.col("name").alias("location_name"),
        "country", "lat", "lon", "koppen", "flyway",
    )
    days = t["gold_bird_daily"]
    best = days.groupBy("location_id").agg(
        *(F.max(c).alias(c) for c in ("species_richness", "checklists", "observations", "temp_mean"))
    )
    rows = best.join(places, "location_id").select(
        "location_id", "location_name", "country", "lat", "lon", "koppen", "flyway",
        F.abs("lat").alias("abs_lat"), "species_richness", "checklists", "observations", "temp_mean",
    )
    joined = days.join(places.select("location_id", "lat"), "location_id")
    raw = joined.agg(
        safe_corr(F.abs("lat"), "species_richness").alias("lat_r"),
        safe_corr("checklists", "species_richness").alias("effort_r"),
        F.count(F.lit(1)).alias("n"),
    )
    explained = lambda c: F.lit(100.0) * F.col(c) * F.col(c)
    correlations = raw.select(
        r("lat_r", 3).alias("r_latitude"),
        r(explained("lat_r"), 1).alias("pct_variance_latitude"),
        r("effort_r", 3).alias("r_effort"),
        r(explained("effort_r"), 1).alias("pct_variance_effort"),
        "n",
    )
    return {"locations": sort_by(rows, ["-species_richness", "location_id"]), "correlations": correlations}


def q_birds(t: Tables, location: str, limit: int = 90) -> DataFrame:
    rows = t["gold_bird_daily"].filter(_eq("location_id")(location)).select(
        "location_id", "obs_date", "species_richness", "observations", "checklists",
        "individuals_counted", "temp_mean", "temp_max", "precip_sum", "temp_anomaly_c",
    )
    return top_k(rows, ["-obs_date"], _limit(limit))


# --- Disasters and epidemics --------------------------------------------------


def q_disasters(
    t: Tables, hazard: str | None = None, min_deaths: int = 0, from_year: int | None = None,
    to_year: int | None = None, limit: int = 100,
) -> DataFrame:
    rows = where_opt(
        t["gold_disasters_ranked"],
        _at_least("deaths")(min_deaths),
        opt(hazard, _eq("hazard_type")),
        opt(from_year, _at_least("year")),
        opt(to_year, _at_most("year")),
    ).select(
        "hazard_type", "source_id", "year", "month", "day", "date_precision", "century", "country",
        "location_name", "latitude", "longitude", "deaths", "deaths_direct", "deaths_from_cascade",
        "damage_musd", "eq_magnitude", "eq_intensity", "volcano_vei", "volcano_name",
        "generated_tsunami", "tsunami_wave_m",
    )
    return top_k(rows, ["-deaths", "hazard_type", "source_id"], _limit(limit))


def q_disaster_cascades(
    t: Tables, min_deaths: int = 1000, limit: int = 60, rounding: bool = True
) -> DataFrame:
    share = F.lit(100.0) * ratio("deaths_from_cascade", "deaths")
    ranked = t["gold_disasters_ranked"].filter(
        (F.col("deaths_from_cascade") > 0) & (F.col("deaths") >= min_deaths)
    )
    order = ["-deaths_from_cascade", "year", "location_name", "hazard_type", "source_id"]
    return top_k(ranked, order, _limit(limit)).select(
        "year", "hazard_type", "country", "location_name", "eq_magnitude", "volcano_vei",
        "deaths_direct", F.col("deaths").alias("deaths_total"), "deaths_from_cascade",
        "tsunami_wave_m", round_if(share, 1, rounding).alias("pct_from_cascade"),
    )


def q_disasters_by_century(t: Tables, rounding: bool = True) -> DataFrame:
    totals = t["gold_disasters_by_century"].groupBy("century").agg(
        F.sum("events").alias("events"),
        F.sum("events_with_exact_deaths").alias("events_with_exact_deaths"),
        round_if(
            F.lit(100.0) * ratio_of_sums("events_with_exact_deaths", "events"), 1, rounding
        ).alias("pct_with_exact_deaths"),
        F.sum("deaths_counted").alias("deaths_counted"),
    )
    return sort_by(totals, ["century"])


def q_epidemics(t: Tables) -> DataFrame:
    rows = t["silver_epidemics"].select(
        "id", "name", "pathogen", "disease", "start_year", "end_year", "ongoing", "duration_years",
        "deaths_low", "deaths_high", "deaths_mid", "deaths_uncertainty_ratio", "regions",
        "estimate_confidence", "source", "note", "century",
    )
    return rows.orderBy(F.coalesce("deaths_mid", F.lit(0.0)).desc(), "id")


def q_deadliest(t: Tables, limit: int = 30) -> DataFrame:
    rows = t["gold_epidemics_vs_disasters"].select(
        "family", "event_key", "event_name", "subtype", "year", "end_year", "duration_years",
        "location", "deaths_low", "deaths_high", "deaths_representative",
        "deaths_uncertainty_ratio", "estimate_confidence", "estimate_kind",
    )
    return top_k(rows, ["-deaths_representative", "event_key"], _limit(limit))


def q_per_capita(t: Tables, limit: int = 25) -> DataFrame:
    order = ["-deaths_per_million", "event_key"]
    return top_k(t["gold_catastrophes_per_capita"], order, _limit(limit)).select(
        "family", "event_name", "subtype", "year", "deaths_representative", "world_population",
        "deaths_per_million", "one_in_every", "pct_of_humanity", "deaths_per_million_low",
        "deaths_per_million_high", "estimate_kind", "population_source",
    )


def q_events(t: Tables, category: str | None = None) -> DataFrame:
    rows = where_opt(t["silver_historical_events"], opt(category, _eq("category"))).select(
        "id", "name", "category", "start_year", "end_year", "duration_years", "is_point_event",
        "description", "relevance",
    )
    return sort_by(rows, ["start_year", "id"])


# --- Cyclones, population, El Niño --------------------------------------------


def q_cyclones(
    t: Tables, basin: str | None = None, season: int | None = None, min_wind_kt: float = 0,
    limit: int = 100,
) -> DataFrame:
    rows = where_opt(
        t["gold_cyclones"],
        _at_least("max_wind_kt")(min_wind_kt),
        opt(basin, _eq("basin")),
        opt(season, _eq("season")),
    ).select(
        "sid", "name", "season", "basin", "first_seen", "last_seen", "duration_days", "max_wind_kt",
        "min_pressure_mb", "max_category", "ace", "reached_hurricane", "reached_major_hurricane",
        "made_landfall", "peak_lat", "peak_lon", "peak_time",
    )
    return top_k(rows, ["-max_wind_kt", "min_pressure_mb", "sid"], _limit(limit))


def q_cyclone_seasons(
    t: Tables, basin: str | None = None, seasons: tuple[int, int] = (1980, 2024), rounding: bool = True
) -> Parts:
    r = lambda c: round_if(c, 4, rounding)
    era = t["gold_cyclone_seasons"].filter(F.col("season").between(*seasons))
    yearly = era.groupBy("season").agg(
        F.sum("ace_total").alias("ace_year"), F.sum("major_hurricanes").alias("major")
    )
    n = F.count(F.lit(1))
    trend = yearly.agg(
        r(safe_corr("season", "ace_year")).alias("r_ace"),
        r(safe_corr("season", "major")).alias("r_major_hurricanes"),
        n.alias("n_years"),
        r(ratio(F.lit(1.96), F.sqrt(n.cast("double")))).alias("significance_threshold"),
    )
    rows = where_opt(era, opt(basin, _eq("basin"))).select(
        "season", "basin", "systems", "tropical_storms", "hurricanes", "major_hurricanes",
        "landfalling", "ace_total", "strongest_wind_kt", "lowest_pressure_mb", "mean_duration_days",
    )
    return {"seasons": sort_by(rows, ["season", "basin"]), "trend": trend}


def q_cyclones_near(
    t: Tables, location: str, max_distance_km: float = PASSAGE_KM, limit: int = 200, built_km: float = PASSAGE_KM
) -> DataFrame:
    """Storms that passed a city, at most as far off as the passages that were built."""
    rows = where_opt(
        t["gold_cyclones_near_city"],
        _eq("location_id")(location),
        _at_most("min_distance_km")(_within(max_distance_km, built_km)),
    )
    return top_k(rows, ["-closest_time", "sid"], _limit(limit))


def q_world_population(t: Tables, from_year: int = -10000, to_year: int = 2030) -> DataFrame:
    rows = t["gold_world_population"].filter(F.col("year").between(from_year, to_year))
    return sort_by(rows, ["year", "source_kind"])


def q_enso(t: Tables, since_year: int = 2020) -> Parts:
    recent = t["silver_oni"].filter(F.col("year") >= since_year).select(
        "year", "season", "season_index", "anomaly_c", "phase", "intensity"
    )
    return {
        "by_basin": sort_by(t["gold_enso_cyclones"], ["basin", "phase"]),
        "oni_recent": top_k(recent, ["-year", "-season_index"], 24),
    }


# --- Model governance and panels ------------------------------------------------


def q_model_skill(t: Tables) -> Parts:
    skill = t["gold_model_skill"]
    models = skill.select(
        "model_id", "scope", "metric", "n_cuts", "improvement_median", "improvement_min",
        "improvement_max", "should_display",
    ).distinct()
    by_cut = skill.select(
        "model_id", "cut_year", "n_test", "value_model", "value_baseline", "improvement_pct"
    )
    return {
        "models": sort_by(models, ["-improvement_median", "model_id", "scope"]),
        "by_cut": sort_by(by_cut, ["model_id", "cut_year"]),
    }


def q_panel_coverage(t: Tables, panel: str | None = None) -> DataFrame:
    rows = where_opt(t["gold_panel_coverage"], opt(panel, _eq("panel")))
    return sort_by(rows, ["panel", "-n_effective", "column_name"])


def q_year_panel(
    t: Tables, from_year: int = 1900, to_year: int = 2026, regime: int | None = None
) -> Parts:
    years = t["gold_year_panel"]
    rows = where_opt(
        years, F.col("year").between(from_year, to_year), opt(regime, _eq("coverage_regime"))
    )
    regimes = years.groupBy("coverage_regime").agg(
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count(F.lit(1)).alias("years"),
        F.max("sources_available").alias("sources"),
    )
    return {"rows": sort_by(rows, ["year"]), "regimes": sort_by(regimes, ["coverage_regime"])}


def q_month_panel(t: Tables, from_year: int = 1950, to_year: int = 2026) -> DataFrame:
    rows = t["gold_month_panel"].filter(F.col("year").between(from_year, to_year))
    return sort_by(rows, ["year", "month"])


def q_sources(spark: SparkSession) -> DataFrame:
    return seed(spark, "sources")


def q_nulls(spark: SparkSession) -> DataFrame:
    return seed(spark, "null_findings")
