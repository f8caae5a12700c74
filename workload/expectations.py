"""The expectations on built tables in SQL, each as (name, passed, observed)."""

from __future__ import annotations


def _number(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE printf('%.4f', round({c}, 4) + 0.0::DOUBLE) END"


def _plain(c: str) -> str:
    return f"coalesce({c}::VARCHAR, 'null')"


def _one(name: str, passed: str, source: str, **observed: bool) -> str:
    shown = " || ', ' || ".join(f"'{c}=' || {_number(c) if is_double else _plain(c)}" for c, is_double in observed.items())
    return f"SELECT '{name}' AS name, coalesce({passed}, false) AS passed, {shown} AS observed FROM ({source})"


def _none(name: str, table: str, bad: str) -> str:
    return _one(name, "bad = 0", f"SELECT count(*) FILTER ({bad}) AS bad FROM {table}", bad=False)


EXPECTATIONS: dict[str, dict[str, str]] = {
    "e1_models": {
        "published_models_never_harm": _none("published_models_never_harm", "gold_model_skill", "should_display AND (improvement_min <= 0 OR improvement_median < 5)"),
        "models_have_enough_cuts": _none("models_have_enough_cuts", "gold_model_skill", "n_cuts < 4"),
        "some_model_varies_over_cuts": _one(
            "some_model_varies_over_cuts", "varied > 0", "SELECT count(*) FILTER (improvement_median < improvement_max) AS varied FROM gold_model_skill", varied=False
        ),
        "heat_risk_is_withheld": _one(
            "heat_risk_is_withheld", "median < 16.9 AND NOT shown",
            "SELECT max(improvement_median) AS median, bool_or(should_display) AS shown FROM gold_model_skill WHERE model_id = 'riesgo_calor_corregido'",
            median=True, shown=False,
        ),
    },
    "e2_aftershocks": {
        "aftershocks_are_summed": _one(
            "aftershocks_are_summed", "max_y > 50 AND max_n1 > 50", "SELECT max(y_days_2_8) AS max_y, max(n1) AS max_n1 FROM gold_aftershock_forecast", max_y=False, max_n1=False
        ),
        "declustering_keeps_most_mains": _one(
            "declustering_keeps_most_mains", "kept < mains AND kept > mains * 0.7",
            "SELECT (SELECT count(*) FROM gold_aftershock_forecast) AS kept, (SELECT count(*) FROM silver_earthquakes WHERE magnitude >= 6.5) AS mains",
            kept=False, mains=False,
        ),
        "aftershocks_are_heavy_tailed": _one(
            "aftershocks_are_heavy_tailed", "mean > median * 2 AND most > mean * 5",
            "SELECT avg(y_days_2_8) AS mean, median(y_days_2_8)::DOUBLE AS median, max(y_days_2_8) AS most FROM gold_aftershock_forecast WHERE is_predictable",
            mean=True, median=True, most=False,
        ).replace("'most='", "'max='"),
    },
    "e3_effective_samples": {
        "effective_sample_formula": _none(
            "effective_sample_formula", "gold_panel_coverage",
            "acf1 IS NOT NULL AND abs(n_effective - greatest(3, round(n_observations * (1 - acf1 ** 2) / (1 + acf1 ** 2)))) > 1",
        ),
        "honest_threshold_is_stricter": _none("honest_threshold_is_stricter", "gold_panel_coverage", "n_observations >= 3 AND r_threshold_honest < r_threshold_naive"),
        "naive_threshold_formula": _none("naive_threshold_formula", "gold_panel_coverage", "abs(r_threshold_naive - 1.96::DOUBLE / sqrt(n_observations)) > 0.002"),
        "every_column_has_a_verdict": _none("every_column_has_a_verdict", "gold_panel_coverage", "verdict IS NULL"),
    },
    "e4_coverage": {
        "regimes_are_contiguous": _one(
            "regimes_are_contiguous", "gaps = 0 AND regimes >= 4",
            "SELECT count(*) FILTER (hi - lo + 1 <> n) AS gaps, count(*) AS regimes FROM (SELECT min(year) AS lo, max(year) AS hi, count(*) AS n FROM gold_year_panel GROUP BY coverage_regime)",
            gaps=False, regimes=False,
        ),
        "coverage_grows": _one("coverage_grows", "rr > 0.8", "SELECT r(year, sources_available) AS rr FROM gold_year_panel WHERE year <= 2025", rr=True).replace("'rr='", "'r='"),
    },
    "e5_seasons": {
        "deseasoned_mean_is_zero": _one("deseasoned_mean_is_zero", "abs(mean) < 0.5", "SELECT avg(cyclone_ace_deseason) AS mean FROM gold_month_panel", mean=True),
        "deseasoning_lowers_acf": _one(
            "deseasoning_lowers_acf", "deseasoned < raw",
            "SELECT max(acf1) FILTER (column_name = 'cyclone_ace') AS raw, max(acf1) FILTER (column_name = 'cyclone_ace_deseason') AS deseasoned "
            "FROM gold_panel_coverage WHERE panel = 'gold_month_panel'",
            raw=True, deseasoned=True,
        ),
    },
    "e6_heat": {
        "threshold_below_record": _none("threshold_below_record", "gold_heat_threshold_drift", "threshold_2019_2025 > temp_max_record"),
        "most_cities_amplified": _one(
            "most_cities_amplified", "amplified * 6 >= cities * 5",
            "SELECT count(*) AS cities, count(*) FILTER (amplification > 1) AS amplified FROM gold_heat_threshold_drift", cities=False, amplified=False,
        ),
    },
}
