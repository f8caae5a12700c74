"""Gold: birds, historic disasters, cascades, epidemics, per-capita tolls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralake.functions import haversine_km, label, ratio, round_if, round_to_long, share_pct
from terralake.operators.geo import Grid
from terralake.operators.joins import exists_flag, left_preferred, not_in_set
from terralake.operators.reshape import union_distinct, union_named
from terralake.operators.rows import tag
from terralake.plans.silver import Tables

# Radius of a suspected duplicate (km) and toll of a listed disaster.
DUPLICATE_KM = 200
LISTED_DEATHS = 10000


def gold_bird_daily(t: Tables, rounding: bool = True) -> DataFrame:
    """Bird counts per location and day beside the weather of that day.

    Birds are counted by species and by checklist first, which combines before the shuffle
    and needs no copy of the observations; the weather, one row per day, is joined to the result.
    """
    seen = t["silver_bird_observations"].withColumn("obs_date", F.to_date("obs_datetime"))
    days = ["location_id", "obs_date"]
    by_species = seen.groupBy(*days, "species_code").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("how_many").alias("counted"), F.count("how_many").alias("with_count")
    )
    birds = by_species.groupBy(*days).agg(
        F.count("species_code").alias("species_richness"),
        F.sum("rows").alias("observations"),
        F.sum("counted").alias("individuals_counted"),
        F.sum("with_count").alias("observations_with_count"),
    )
    lists = seen.select(*days, "checklist_id").distinct().groupBy(*(F.col(c).alias(f"of_{c}") for c in days)).agg(
        F.count("checklist_id").alias("checklists")
    )
    same_day = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in days]
    birds = birds.join(lists, same_day).select(
        *days, "species_richness", "observations", "checklists", "individuals_counted", "observations_with_count"
    )
    weather = t["gold_weather_daily"].select(
        "location_id",
        F.col("local_date").alias("obs_date"),
        F.col("kind").alias("weather_kind"),
        *("temp_mean", "temp_min", "temp_max", "precip_sum"),
    )
    anomaly = t["gold_temperature_anomaly"].select(
        "location_id",
        F.col("local_date").alias("obs_date"),
        F.col("kind").alias("anomaly_kind"),
        F.col("anomaly_c").alias("temp_anomaly_c"),
    )
    keys, kinds = ["location_id", "obs_date"], ["observed"]
    with_weather = left_preferred(birds, weather, keys, "weather_kind", kinds)
    return left_preferred(with_weather, anomaly, keys, "anomaly_kind", kinds).drop("anomaly_kind")


def _hazard(t: Tables, kind: str) -> DataFrame:
    return t["silver_historical_disasters"].filter(F.col("hazard_type") == kind)


def redundant_tsunamis(t: Tables) -> DataFrame:
    """Tsunamis whose deaths are already in the record of their quake or volcano."""
    waves = _hazard(t, "tsunami").select(
        "source_id", "caused_earthquake_id", F.col("deaths_best").alias("wave_deaths")
    )
    same = F.col("wave_deaths").eqNullSafe(F.col("deaths_best"))
    quakes = _hazard(t, "earthquake").select(
        F.col("source_id").alias("caused_earthquake_id"), "deaths_best"
    )
    by_quake = waves.join(quakes, "caused_earthquake_id").filter(same).select("source_id")
    volcanos = _hazard(t, "volcano").select(
        F.col("caused_tsunami_id").alias("source_id"), "deaths_best"
    )
    by_volcano = waves.join(volcanos, "source_id").filter(same).select("source_id")
    return union_distinct(by_quake, by_volcano)


def suspected_duplicates(events: DataFrame, km: float) -> DataFrame:
    """(year, toll, place) of events with a twin: same year and toll within ``km``.

    Events at one spot are first merged into one counted row, so a spot with very
    many copies is compared once. A spot with two events has its twin on the
    spot; others look for a neighbouring spot inside their grid cell.
    """
    spot = ["year", "deaths_best", "latitude", "longitude"]
    located = events.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    spots = located.groupBy(*spot).agg(F.count(F.lit(1)).alias("n"))
    grid = Grid(km)
    own = spots.withColumn("cell", grid.cell("latitude", "longitude"))
    others = grid.copy_around(spots, "latitude", "longitude", "cell")

    def elsewhere(a: str, b: str) -> Column:
        moved = (F.col(f"{a}latitude") != F.col(f"{b}latitude")) | (
            F.col(f"{a}longitude") != F.col(f"{b}longitude")
        )
        gap = haversine_km(f"{a}latitude", f"{a}longitude", f"{b}latitude", f"{b}longitude")
        return moved & (gap <= km)

    flagged = exists_flag(own, others, ["year", "deaths_best", "cell"], "neighbour", elsewhere, spot)
    return flagged.filter((F.col("n") > 1) | F.col("neighbour")).select(
        *spot, F.lit(True).alias("suspected_duplicate")
    )


def gold_disasters_ranked(
    t: Tables, rounding: bool = True, duplicate_km: float = DUPLICATE_KM
) -> DataFrame:
    """Events with a counted toll, each death counted once."""
    events = t["silver_historical_disasters"]
    redundant = redundant_tsunamis(t).select(
        F.lit("tsunami").alias("hazard_type"), "source_id"
    )
    key = ["hazard_type", "source_id"]
    kept = not_in_set(
        events.filter(F.col("has_exact_deaths") & (F.col("deaths_best") > 0)), redundant, key
    )

    twins = suspected_duplicates(kept, duplicate_km)
    spot = ["year", "deaths_best", "latitude", "longitude"]
    flagged = kept.join(twins, spot, "left")

    # Highest wave of the tsunamis an event set off.
    waves = _hazard(t, "tsunami")
    of_quakes = waves.filter(F.col("caused_earthquake_id").isNotNull()).select(
        F.lit("earthquake").alias("hazard_type"),
        F.col("caused_earthquake_id").alias("source_id"),
        F.col("tsunami_max_water_height_m").alias("wave_m"),
    )
    of_volcanos = (
        _hazard(t, "volcano")
        .select(F.col("source_id").alias("volcano_id"), F.col("caused_tsunami_id").alias("source_id"))
        .join(waves.select("source_id", "tsunami_max_water_height_m"), "source_id")
        .select(
            F.lit("volcano").alias("hazard_type"),
            F.col("volcano_id").alias("source_id"),
            F.col("tsunami_max_water_height_m").alias("wave_m"),
        )
    )
    highest = (
        of_quakes.unionByName(of_volcanos)
        .groupBy(*key)
        .agg(F.max("wave_m").alias("wave_m"), F.lit(True).alias("generated"))
    )
    no = F.lit(False)
    return flagged.join(highest, key, "left").select(
        *("hazard_type", "source_id", "year", "month", "day", "event_date", "date_precision"),
        *("century", "country", "location_name", "latitude", "longitude"),
        F.col("deaths_best").alias("deaths"),
        F.col("deaths").alias("deaths_direct"),
        "deaths_total",
        (F.col("deaths_total") - F.col("deaths")).alias("deaths_from_cascade"),
        "injuries_total",
        F.col("damage_musd_total").alias("damage_musd"),
        *("houses_destroyed", "eq_magnitude", "eq_depth_km", "eq_intensity"),
        *("tsunami_max_water_height_m", "tsunami_num_runups", "volcano_vei", "volcano_name"),
        *("caused_earthquake_id", "caused_tsunami_id"),
        F.coalesce("generated", no).alias("generated_tsunami"),
        F.coalesce("tsunami_max_water_height_m", "wave_m").alias("tsunami_wave_m"),
        F.coalesce("suspected_duplicate", no).alias("suspected_duplicate"),
    )


def gold_disaster_cascades(t: Tables, rounding: bool = True) -> DataFrame:
    """Trigger and tsunami pairs with the share of deaths due to the cascade."""
    waves = _hazard(t, "tsunami").select(
        F.col("source_id").alias("tsunami_id"),
        *("year", "month", "day", "event_date", "country", "location_name"),
        F.col("deaths_best").alias("tsunami_deaths"),
        F.col("tsunami_max_water_height_m").alias("max_wave_m"),
        F.col("tsunami_num_runups").alias("runups"),
        "caused_earthquake_id",
    )

    def triggers(kind: str, magnitude: str, link_id: str, link_name: str) -> DataFrame:
        found = _hazard(t, kind).select(
            F.lit(kind).alias("trigger_type"),
            F.col("source_id").alias("trigger_id"),
            F.col(magnitude).cast("double").alias("trigger_magnitude"),
            F.col("deaths").alias("trigger_deaths_direct"),
            F.col("deaths_total").alias("trigger_deaths_total"),
            F.col(link_id).alias(link_name),
        )
        return found.join(waves, link_name)

    pairs = union_named(
        [
            triggers("earthquake", "eq_magnitude", "source_id", "caused_earthquake_id"),
            triggers("volcano", "volcano_vei", "caused_tsunami_id", "tsunami_id"),
        ]
    )
    total = F.col("trigger_deaths_total")
    share = F.when(total > 0, ratio(total - F.coalesce("trigger_deaths_direct", F.lit(0)), total))
    return pairs.select(
        *("trigger_type", "trigger_id", "trigger_magnitude", "tsunami_id", "year", "month", "day"),
        *("event_date", "country", "location_name", "trigger_deaths_direct"),
        *("trigger_deaths_total", "tsunami_deaths", "max_wave_m", "runups"),
        round_if(share, 4, rounding).alias("cascade_death_share"),
    )


def gold_disasters_by_century(t: Tables, rounding: bool = True) -> DataFrame:
    """How well each century is documented, not how dangerous it was."""
    r = lambda c: round_if(c, 1, rounding)
    return t["silver_historical_disasters"].groupBy("century", "hazard_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if("has_exact_deaths").alias("events_with_exact_deaths"),
        r(share_pct("has_exact_deaths")).alias("pct_with_exact_deaths"),
        F.sum("deaths_best").alias("deaths_counted"),
        F.max("deaths_best").alias("deadliest_event_deaths"),
        r(share_pct(F.col("date_precision") == "fecha completa")).alias("pct_full_date"),
    )


def gold_epidemics_vs_disasters(
    t: Tables, rounding: bool = True, min_deaths: int = LISTED_DEATHS
) -> DataFrame:
    """Epidemics (ranges) and disasters (counts) on one scale."""
    epidemics = t["silver_epidemics"].filter(F.col("deaths_low").isNotNull()).select(
        F.col("id").alias("event_key"),
        F.col("name").alias("event_name"),
        F.col("disease").alias("subtype"),
        F.col("start_year").alias("year"),
        *("end_year", "duration_years"),
        F.col("regions").alias("location"),
        *("deaths_low", "deaths_high"),
        F.col("deaths_mid").cast("double").alias("deaths_representative"),
        *("deaths_uncertainty_ratio", "estimate_confidence"),
        F.col("source").alias("source_note"),
    )
    ranked = t["gold_disasters_ranked"].filter(F.col("deaths") >= min_deaths)
    place = F.coalesce("location_name", "country")
    disasters = ranked.select(
        label("hazard_type", F.lit(":"), "source_id").alias("event_key"),
        F.coalesce("volcano_name", place).alias("event_name"),
        F.col("hazard_type").alias("subtype"),
        "year",
        F.col("year").alias("end_year"),
        F.lit(1).cast("bigint").alias("duration_years"),
        place.alias("location"),
        F.col("deaths").alias("deaths_low"),
        F.col("deaths").alias("deaths_high"),
        F.col("deaths").cast("double").alias("deaths_representative"),
        F.lit(1.0).alias("deaths_uncertainty_ratio"),
        F.lit("alta").alias("estimate_confidence"),
        F.lit("NOAA NCEI").alias("source_note"),
    )
    return union_named(
        [
            tag(epidemics, family="epidemic", estimate_kind="estimación"),
            tag(disasters, family="natural_disaster", estimate_kind="recuento"),
        ]
    )


def gold_catastrophes_per_capita(t: Tables, rounding: bool = True) -> DataFrame:
    """Tolls against the people alive that year, with both uncertainties crossed."""
    r = lambda c, n: round_if(c, n, rounding)
    events = t["gold_epidemics_vs_disasters"].filter(F.col("deaths_representative").isNotNull())
    people = t["gold_world_population"].select(
        "year",
        F.col("population_mid").alias("world_population"),
        F.col("population_low").alias("world_population_low"),
        F.col("population_high").alias("world_population_high"),
        F.col("source_kind").alias("population_source"),
        F.col("uncertainty_ratio").alias("population_uncertainty"),
    )
    joined = events.join(people.filter(F.col("world_population").isNotNull()), "year")
    per_million = lambda d, p: F.lit(1e6) * ratio(d, p)
    return joined.select(
        *("family", "event_key", "event_name", "subtype", "year", "duration_years", "location"),
        *("deaths_low", "deaths_high", "deaths_representative", "estimate_kind"),
        *("estimate_confidence", "world_population", "world_population_low"),
        *("world_population_high", "population_source", "population_uncertainty"),
        r(per_million("deaths_representative", "world_population"), 2).alias("deaths_per_million"),
        round_to_long(ratio("world_population", "deaths_representative")).alias("one_in_every"),
        r(F.lit(100.0) * ratio("deaths_representative", "world_population"), 4).alias("pct_of_humanity"),
        r(per_million("deaths_low", "world_population_high"), 2).alias("deaths_per_million_low"),
        r(per_million("deaths_high", "world_population_low"), 2).alias("deaths_per_million_high"),
    )
