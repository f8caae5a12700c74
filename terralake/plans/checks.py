"""Expectations on built tables, one aggregate each.

``check(t)`` returns (name, passed, observed); ``observed`` says what was seen.
The thresholds describe the real data; ``skip`` leaves out what a smaller or
synthetic build cannot meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralake.functions import label, safe_corr
from terralake.plans.gold_panels import effective_n
from terralake.plans.silver import Tables
from terralake.sources.seeds import seed

Check = Callable[[Tables], DataFrame]


def _text(*parts: tuple[str, Column, bool]) -> Column:
    """name=value pairs as one text; doubles with four digits."""
    shown = [
        (name, F.format_string("%.4f", F.round(value, 4) + 0.0) if is_double else value.cast("string"), value)
        for name, value, is_double in parts
    ]
    return F.concat_ws(
        ", ", *(F.concat(F.lit(f"{name}="), F.when(value.isNull(), "null").otherwise(text)) for name, text, value in shown)
    )


def _verdict(one_row: DataFrame, passed: Column, *observed: str) -> DataFrame:
    """A one-row aggregate as (passed, observed); an unknown outcome fails."""
    return one_row.select(
        F.coalesce(passed, F.lit(False)).alias("passed"),
        _text(*((c, F.col(c), one_row.schema[c].dataType.simpleString() == "double") for c in observed)).alias("observed"),
    )


def _none(df: DataFrame, bad: Column) -> DataFrame:
    """No row may satisfy ``bad``."""
    return _verdict(df.agg(F.count_if(bad).alias("bad")), F.col("bad") == 0, "bad")


# --- Model governance ---------------------------------------------------------


def published_models_never_harm(t: Tables) -> DataFrame:
    bad = F.col("should_display") & ((F.col("improvement_min") <= 0) | (F.col("improvement_median") < 5))
    return _none(t["gold_model_skill"], bad)


def models_have_enough_cuts(t: Tables) -> DataFrame:
    return _none(t["gold_model_skill"], F.col("n_cuts") < 4)


def some_model_varies_over_cuts(t: Tables) -> DataFrame:
    varied = t["gold_model_skill"].agg(
        F.count_if(F.col("improvement_median") < F.col("improvement_max")).alias("varied")
    )
    return _verdict(varied, F.col("varied") > 0, "varied")


def heat_risk_is_withheld(t: Tables) -> DataFrame:
    heat = t["gold_model_skill"].filter("model_id = 'riesgo_calor_corregido'").agg(
        F.max("improvement_median").alias("median"), F.bool_or("should_display").alias("shown")
    )
    return _verdict(heat, (F.col("median") < 16.9) & ~F.col("shown"), "median", "shown")


def aftershocks_are_summed(t: Tables) -> DataFrame:
    """Counting days instead of events would cap the count at seven."""
    top = t["gold_aftershock_forecast"].agg(F.max("y_days_2_8").alias("max_y"), F.max("n1").alias("max_n1"))
    return _verdict(top, (F.col("max_y") > 50) & (F.col("max_n1") > 50), "max_y", "max_n1")


def declustering_keeps_most_mains(t: Tables) -> DataFrame:
    mains = t["silver_earthquakes"].filter("magnitude >= 6.5").agg(F.count(F.lit(1)).alias("n"))
    kept = t["gold_aftershock_forecast"].agg(F.count(F.lit(1)).alias("kept"))
    both = kept.withColumn("mains", mains.scalar())
    ok = (F.col("kept") < F.col("mains")) & (F.col("kept") > F.col("mains") * 0.7)
    return _verdict(both, ok, "kept", "mains")


def aftershocks_are_heavy_tailed(t: Tables) -> DataFrame:
    y = F.col("y_days_2_8")
    shape = t["gold_aftershock_forecast"].filter("is_predictable").agg(
        F.avg(y).alias("mean"), F.median(y).alias("median"), F.max(y).alias("max")
    )
    ok = (F.col("mean") > F.col("median") * 2) & (F.col("max") > F.col("mean") * 5)
    return _verdict(shape, ok, "mean", "median", "max")


# --- Panels ---------------------------------------------------------------------


def effective_sample_formula(t: Tables) -> DataFrame:
    stats = t["gold_panel_coverage"].filter(F.col("acf1").isNotNull())
    expected = F.greatest(F.lit(3.0), F.round(effective_n(F.col("n_observations"), F.col("acf1"))))
    return _none(stats, F.abs(F.col("n_effective") - expected) > 1)


def honest_threshold_is_stricter(t: Tables) -> DataFrame:
    """For columns with at least three values: the effective sample is floored at three."""
    stats = t["gold_panel_coverage"].filter("n_observations >= 3")
    return _none(stats, F.col("r_threshold_honest") < F.col("r_threshold_naive"))


def naive_threshold_formula(t: Tables) -> DataFrame:
    expected = F.lit(1.96) / F.sqrt(F.col("n_observations").cast("double"))
    return _none(t["gold_panel_coverage"], F.abs(F.col("r_threshold_naive") - expected) > 0.002)


def every_column_has_a_verdict(t: Tables) -> DataFrame:
    return _none(t["gold_panel_coverage"], F.col("verdict").isNull())


def regimes_are_contiguous(t: Tables) -> DataFrame:
    blocks = t["gold_year_panel"].groupBy("coverage_regime").agg(
        F.min("year").alias("lo"), F.max("year").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    gaps = blocks.agg(
        F.count_if(F.col("hi") - F.col("lo") + 1 != F.col("n")).alias("gaps"),
        F.count(F.lit(1)).alias("regimes"),
    )
    return _verdict(gaps, (F.col("gaps") == 0) & (F.col("regimes") >= 4), "gaps", "regimes")


def coverage_grows(t: Tables) -> DataFrame:
    r = t["gold_year_panel"].filter("year <= 2025").agg(safe_corr("year", "sources_available").alias("r"))
    return _verdict(r, F.col("r") > 0.8, "r")


def deseasoned_mean_is_zero(t: Tables) -> DataFrame:
    mean = t["gold_month_panel"].agg(F.avg("cyclone_ace_deseason").alias("mean"))
    return _verdict(mean, F.abs("mean") < 0.5, "mean")


def deseasoning_lowers_acf(t: Tables) -> DataFrame:
    of = lambda name: F.max(F.when(F.col("column_name") == name, F.col("acf1")))
    both = t["gold_panel_coverage"].filter("panel = 'gold_month_panel'").agg(
        of("cyclone_ace").alias("raw"), of("cyclone_ace_deseason").alias("deseasoned")
    )
    return _verdict(both, F.col("deseasoned") < F.col("raw"), "raw", "deseasoned")


# --- Heat thresholds ----------------------------------------------------------------


def threshold_below_record(t: Tables) -> DataFrame:
    return _none(t["gold_heat_threshold_drift"], F.col("threshold_2019_2025") > F.col("temp_max_record"))


def most_cities_amplified(t: Tables) -> DataFrame:
    n = t["gold_heat_threshold_drift"].agg(
        F.count(F.lit(1)).alias("cities"), F.count_if(F.col("amplification") > 1).alias("amplified")
    )
    return _verdict(n, F.col("amplified") * 6 >= F.col("cities") * 5, "cities", "amplified")


CHECKS: tuple[Check, ...] = (
    published_models_never_harm,
    models_have_enough_cuts,
    some_model_varies_over_cuts,
    heat_risk_is_withheld,
    aftershocks_are_summed,
    declustering_keeps_most_mains,
    aftershocks_are_heavy_tailed,
    effective_sample_formula,
    honest_threshold_is_stricter,
    naive_threshold_formula,
    every_column_has_a_verdict,
    regimes_are_contiguous,
    coverage_grows,
    deseasoned_mean_is_zero,
    deseasoning_lowers_acf,
    threshold_below_record,
    most_cities_amplified,
)


def check(t: Tables, skip: Iterable[str] = (), only: Iterable[str] | None = None) -> DataFrame:
    """All expectations, or those asked for, as one table."""
    left_out = set(skip) if only is None else {c.__name__ for c in CHECKS} - set(only)
    results = [
        c(t).select(F.lit(c.__name__).alias("name"), "passed", "observed")
        for c in CHECKS
        if c.__name__ not in left_out
    ]
    return reduce(lambda a, b: a.unionByName(b), results)


def check_seeds(spark: SparkSession) -> DataFrame:
    """Catalogues: unique ids, ordered ranges and years, every row sourced."""
    rules: Mapping[str, tuple[str, Mapping[str, str]]] = {
        "dim_locations": ("id", {"coordinates": "abs(lat) > 90 OR abs(lon) > 180"}),
        "epidemics": (
            "id",
            {
                "range": "deaths_high < deaths_low",
                "years": "end_year < start_year",
                "source": "coalesce(trim(source), '') = ''",
            },
        ),
        "world_population": (
            "year",
            {"range": "population_high < population_low", "source": "coalesce(trim(source), '') = ''"},
        ),
        "historical_events": (
            "id", {"years": "end_year < start_year", "relevance": "coalesce(relevance, '') = ''"}
        ),
        "sources": (
            "id",
            {
                "citation": "attribution_required AND length(citation) <= 30",
                "use": "coalesce(length(what_we_use), 0) <= 20",
                "url": "NOT startswith(url, 'http')",
            },
        ),
        "null_findings": (
            "id",
            {
                "statistic": "NOT statistic RLIKE '[0-9]' OR length(statistic) <= 60",
                "reason": "coalesce(length(why_solid), 0) <= 80",
                "lesson": "coalesce(length(lesson), 0) <= 60",
            },
        ),
    }
    out = []
    for name, (key, bad) in rules.items():
        rows = seed(spark, name)
        one = rows.agg(
            (F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicate_keys"),
            *(F.count_if(F.expr(test)).alias(rule) for rule, test in bad.items()),
        )
        fields = ["duplicate_keys", *bad]
        clean = reduce(lambda a, b: a & b, (F.col(f) == 0 for f in fields))
        out.append(
            _verdict(one, clean, *fields).select(
                label(F.lit("seed "), F.lit(name)).alias("name"), "passed", "observed"
            )
        )
    return reduce(lambda a, b: a.unionByName(b), out)
