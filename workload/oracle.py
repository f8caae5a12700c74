"""The same tables in plain SQL, as named subqueries that are put together on demand.

Joins are written as the definition reads (distance, day and year conditions);
the Spark side reaches the same rows through cells, slots and exploded keys.
"""

from __future__ import annotations

import re

# --- Inputs ------------------------------------------------------------------

CTES: dict[str, str] = {
    "dim_locations": """
        SELECT n_nationkey::VARCHAR AS id, n_name AS name, 'R' || n_regionkey AS country,
               (((n_nationkey + 8) % 25) * 5 - 60)::DOUBLE AS lat,
               (((n_nationkey + 8) % 25) * 14 - 170)::DOUBLE AS lon,
               ['UTC','America/New_York','Asia/Tokyo','Europe/Madrid','Asia/Kolkata'][n_regionkey + 1] AS timezone,
               ['Af','BWh','Cfb','Dfc','ET'][n_nationkey % 5 + 1] AS koppen,
               (n_nationkey % 4)::BIGINT AS seismic_level, 'ninguna' AS flyway
        FROM nation""",
    "bronze_weather": """
        SELECT (user_id % 12)::VARCHAR AS location_id, ts AS time,
               CASE WHEN user_id % 5 = 0 THEN 'forecast' ELSE 'observed' END AS kind,
               value + extra AS temperature_2m, value - 2 AS apparent_temperature,
               (event_id % 7)::DOUBLE AS precipitation, (event_id % 40 + 990)::DOUBLE AS pressure_msl,
               (event_id % 40 + 900)::DOUBLE AS surface_pressure,
               (event_id % 100)::DOUBLE AS relative_humidity_2m,
               (event_id * 7 % 101)::DOUBLE AS cloud_cover, (event_id * 13 % 90)::DOUBLE AS wind_gusts_10m,
               (event_id * 11 % 800)::DOUBLE AS shortwave_radiation,
               ts + extra * INTERVAL 1 DAY AS _ingested_at
        FROM events, (VALUES (0), (1)) v(extra) WHERE extra = 0 OR event_id % 4 = 0""",
    "gold_weather_daily": """
        SELECT (l_suppkey % 12)::VARCHAR AS location_id, l_shipdate::DATE AS local_date,
               CASE WHEN l_linenumber = 7 THEN 'forecast' ELSE 'observed' END AS kind,
               count(*) AS hours, avg(l_quantity) AS temp_mean, min(l_quantity) AS temp_min,
               max(l_quantity) AS temp_max, max(l_quantity) - min(l_quantity) AS temp_range,
               min(l_quantity) - 2 AS apparent_min, max(l_quantity) + 2 AS apparent_max,
               sum(l_discount) AS precip_sum, avg(l_extendedprice) AS pressure_msl_mean,
               min(l_extendedprice) AS pressure_msl_min, avg(l_extendedprice) - 10 AS surface_pressure_mean,
               avg(l_tax) AS humidity_mean, avg(l_linenumber) AS cloud_cover_mean,
               max(l_partkey % 100)::DOUBLE AS wind_gust_max, sum(l_tax) AS radiation_sum
        FROM lineitem GROUP BY ALL""",
    "quake_base": """
        SELECT o_orderkey AS k, 'q' || o_orderkey AS event_id,
               o_orderdate + (o_orderkey * 37 % 86400) * INTERVAL 1 SECOND AS time,
               floor((4.5::DOUBLE - log10(1 - (o_orderkey * 7919 % 9973) / 9973.0::DOUBLE)) * 10) / 10 AS magnitude,
               (o_orderkey * 31 % 600) / 100.0::DOUBLE AS lat, (o_orderkey * 17 % 1200) / 100.0::DOUBLE AS lon,
               CASE WHEN o_orderkey % 29 <> 0 THEN (o_orderkey * 13 % 700)::DOUBLE END AS depth_km,
               'P' || (o_orderkey % 100) AS place,
               CASE WHEN o_orderkey % 50 = 7 THEN 'quarry blast' ELSE 'earthquake' END AS event_type,
               o_orderkey % 20 = 0 AS tsunami, o_orderkey % 1000 AS significance, o_orderkey % 17 AS felt
        FROM orders""",
    "bronze_quakes": """
        SELECT * EXCLUDE (k), time + INTERVAL 1 DAY AS updated,
               CASE WHEN k % 4 > 0 THEN 'reviewed' END AS status FROM quake_base
        UNION ALL BY NAME
        SELECT * EXCLUDE (k) REPLACE (CASE WHEN k % 6 = 0 THEN magnitude + 0.1::DOUBLE ELSE magnitude END AS magnitude),
               time + INTERVAL 3 DAY AS updated,
               CASE WHEN k % 15 = 3 THEN 'deleted' ELSE 'reviewed' END AS status
        FROM quake_base WHERE k % 3 = 0""",
    "track_base": """
        SELECT o_orderkey AS k, o_custkey::VARCHAR AS sid, year(o_orderdate) AS season,
               ['NA','EP','WP','NI'][o_custkey % 4 + 1] AS basin, 'MM' AS subbasin,
               'S' || (o_custkey % 30) AS name,
               o_orderdate + (o_orderkey % 8 * 3) * INTERVAL 1 HOUR AS time,
               CASE WHEN o_orderkey % 17 = 0 THEN 'spur' ELSE 'main' END AS track_type,
               (o_orderkey * 31 % 600) / 100.0::DOUBLE AS lat, (o_orderkey * 17 % 1200) / 100.0::DOUBLE AS lon,
               CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey * 3 % 100 + 25)::DOUBLE END AS wmo_wind_kt,
               CASE WHEN o_orderkey % 9 <> 0 THEN (1010 - o_orderkey * 3 % 100)::DOUBLE END AS wmo_pressure_mb,
               CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 7 % 140 + 20)::DOUBLE END AS usa_wind_kt,
               CASE WHEN o_orderkey % 10 <> 0 THEN (1010 - o_orderkey * 7 % 140)::DOUBLE END AS usa_pressure_mb,
               CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 8 - 2 END AS usa_sshs,
               (o_orderkey % 5 * 50)::DOUBLE AS dist2land_km, o_orderdate AS _ingested_at
        FROM orders""",
    "bronze_cyclones": """
        SELECT * FROM track_base
        UNION ALL BY NAME
        SELECT * REPLACE (usa_wind_kt + 5 AS usa_wind_kt, _ingested_at + INTERVAL 30 DAY AS _ingested_at)
        FROM track_base WHERE k % 5 = 0""",
    "bronze_hazards": """
        SELECT i AS source_id, ['earthquake','tsunami','volcano'][h + 1] AS hazard_type,
               i * 7 % 6400 - 4360 AS year, nullif(p_size % 13, 0)::BIGINT AS month,
               nullif(p_partkey * 3 % 32, 0) AS day,
               CASE WHEN i % 23 <> 0 THEN (i * 31 % 600) / 100.0::DOUBLE END AS latitude,
               CASE WHEN i % 23 <> 0 THEN (i * 17 % 1200) / 100.0::DOUBLE END AS longitude,
               p_brand AS country, CASE WHEN p_partkey % 6 <> 0 THEN p_name END AS location_name,
               CASE WHEN i % 10 <> 9 THEN toll END AS deaths,
               CASE WHEN i % 11 <> 3 THEN toll + i % 7 * 50 END AS deaths_total,
               i % 5 AS deaths_order, p_partkey % 400 AS injuries_total, p_retailprice AS damage_musd_total,
               p_partkey % 90 AS houses_destroyed,
               CASE WHEN h = 0 THEN (i % 40) / 10.0::DOUBLE + 5 END AS eq_magnitude,
               CASE WHEN h = 1 THEN (p_partkey % 60)::DOUBLE END AS tsunami_max_water_height_m,
               CASE WHEN h = 1 THEN p_partkey % 30 END AS tsunami_num_runups,
               CASE WHEN h = 2 THEN i % 9 END AS volcano_vei, CASE WHEN h = 2 THEN 'V' || i END AS volcano_name,
               CASE WHEN h = 1 AND i % 2 = 0 THEN i END AS caused_earthquake_id,
               CASE WHEN h = 2 AND i % 2 = 1 THEN i END AS caused_tsunami_id
        FROM (SELECT *, p_partkey % 3 AS h, p_partkey // 3 AS i,
                     ((p_partkey // 3) % 97 + CASE WHEN (p_partkey // 3) % 5 = 0 THEN 0 ELSE p_partkey % 3 END) * 100 AS toll
              FROM part)""",
    "bronze_epidemics": """
        SELECT c_custkey AS k, c_mktsegment || '-' || c_nationkey AS id,
               'E' || c_nationkey || left(c_mktsegment, 2) AS name, 'agent' AS pathogen, c_mktsegment AS disease,
               (c_nationkey * 4 + 1900)::BIGINT AS start_year,
               CASE WHEN c_nationkey % 7 <> 0 THEN (c_nationkey * 4 + 1900 + c_nationkey % 10)::BIGINT END AS end_year,
               CASE WHEN c_nationkey % 13 <> 0 THEN (c_custkey % 50 + 1) * 1000 END AS deaths_low,
               CASE WHEN c_nationkey % 13 <> 0 THEN (c_custkey % 50 + 1) * 3000 END AS deaths_high,
               c_mktsegment AS regions, 'media' AS estimate_confidence, 'list' AS source, NULL::VARCHAR AS note
        FROM customer""",
    "bronze_events": """
        SELECT c_custkey AS k, 'm' || c_nationkey AS id, 'M' || c_nationkey AS name,
               ['guerra','economia','tecnologia','salud','clima','observacion'][c_nationkey % 6 + 1] AS category,
               (c_nationkey % 20 + 1988)::BIGINT AS start_year,
               CASE WHEN c_nationkey % 3 <> 0 THEN (c_nationkey % 20 + 1988 + c_nationkey % 4)::BIGINT END AS end_year,
               'd' || c_custkey AS description, 'r' AS relevance
        FROM customer""",
    "bronze_population": """
        SELECT o_orderkey AS k, CASE WHEN wld THEN 'WLD' ELSE 'C' || (o_custkey % 20) END AS country_id,
               y AS year, CASE WHEN wld OR o_orderkey % 9 <> 0 THEN (o_orderkey % 5000 + 10000) * 1000 END AS population,
               wld AS is_aggregate
        FROM (SELECT *, year(o_orderdate) AS y, o_custkey % 20 = 0 AND year(o_orderdate) >= 1998 AS wld FROM orders)""",
    "bronze_world_population": """
        SELECT o_orderkey AS k, o_custkey % 10 * 10 + 1900 AS year, (o_orderkey % 900 + 1000) * 1000 AS population_low,
               (o_orderkey % 900 + 1000) * 1200 AS population_high, 'media' AS confidence
        FROM orders""",
    "bronze_oni": """
        SELECT o_orderkey AS k, year(o_orderdate) AS year, month(o_orderdate) AS season_index,
               ['DJF','JFM','FMA','MAM','AMJ','MJJ','JJA','JAS','ASO','SON','OND','NDJ'][month(o_orderdate)] AS season,
               (o_orderkey * 37 % 41 - 20) / 10.0::DOUBLE + 26 AS sst_c,
               (o_orderkey * 37 % 41 - 20) / 10.0::DOUBLE AS anomaly_c
        FROM orders""",
    "bird_months": """
        SELECT left(o_orderpriority, 1)::BIGINT AS species_key, (o_custkey % 12)::VARCHAR AS location_id,
               year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS cnt
        FROM orders GROUP BY ALL""",
    "bronze_birds": """
        SELECT (o_custkey % 12)::VARCHAR AS location_id, 'sp' || (l_partkey % 50) AS species_code,
               o_orderdate + (l_orderkey % 24) * INTERVAL 1 HOUR AS obs_datetime,
               CASE WHEN l_linenumber <> 3 THEN l_quantity::BIGINT END AS how_many,
               l_returnflag <> 'R' AS obs_valid, l_orderkey::VARCHAR AS checklist_id, l_shipdate AS _ingested_at
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    # --- Silver ---------------------------------------------------------------
    "silver_weather_hourly": """
        SELECT * FROM bronze_weather WHERE temperature_2m IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY location_id, time, kind
                                   ORDER BY _ingested_at DESC, temperature_2m DESC) = 1""",
    "silver_earthquakes": """
        SELECT *, CASE WHEN depth_km >= 300 OR depth_km IS NULL THEN 'profundo'
                       WHEN depth_km >= 70 THEN 'intermedio' ELSE 'superficial' END AS depth_class
        FROM bronze_quakes
        WHERE event_type = 'earthquake' AND coalesce(status, '') <> 'deleted'
        QUALIFY updated = max(updated) OVER (PARTITION BY event_id)""",
    "silver_bird_observations": """
        SELECT * FROM bronze_birds WHERE obs_valid
        QUALIFY row_number() OVER (PARTITION BY checklist_id, species_code, location_id
                                   ORDER BY _ingested_at DESC, how_many DESC NULLS LAST) = 1""",
    "silver_historical_disasters": """
        SELECT *, try(make_date(year, month, day)) AS event_date,
               CASE WHEN month IS NULL THEN 'solo año' WHEN day IS NULL THEN 'año y mes' ELSE 'fecha completa' END AS date_precision,
               CASE WHEN year >= 1 THEN (year + 99) // 100 ELSE (least(year, -1) - 99) // 100 END AS century,
               coalesce(deaths_total, deaths) AS deaths_best, deaths_order AS deaths_order_best,
               deaths_total IS NOT NULL OR deaths IS NOT NULL AS has_exact_deaths
        FROM bronze_hazards""",
    "silver_epidemics": """
        SELECT * EXCLUDE (k), end_year IS NULL AS ongoing, coalesce(end_year, 2026) - start_year + 1 AS duration_years,
               (deaths_low + deaths_high) / 2.0::DOUBLE AS deaths_mid,
               deaths_high / nullif(deaths_low, 0)::DOUBLE AS deaths_uncertainty_ratio,
               (start_year + 99) // 100 AS century
        FROM bronze_epidemics QUALIFY k = max(k) OVER (PARTITION BY id)""",
    "silver_cyclone_tracks": """
        SELECT *, epoch(time)::BIGINT % 21600 = 0 AS is_synoptic, ifnull(usa_wind_kt, wmo_wind_kt) AS wind_kt,
               ifnull(usa_pressure_mb, wmo_pressure_mb) AS pressure_mb,
               ifnull(usa_wind_kt, wmo_wind_kt) >= 34 AS is_tropical_storm,
               ifnull(usa_wind_kt, wmo_wind_kt) >= 64 AS is_hurricane
        FROM (SELECT * FROM bronze_cyclones
              QUALIFY row_number() OVER (PARTITION BY sid, time ORDER BY _ingested_at DESC, season DESC, basin DESC,
                  subbasin DESC, name DESC, track_type DESC, lat DESC, lon DESC) = 1)
        WHERE track_type = 'main'""",
    "silver_population": """
        SELECT * EXCLUDE (k) FROM (SELECT * FROM bronze_population QUALIFY k = max(k) OVER (PARTITION BY country_id, year))
        WHERE population IS NOT NULL""",
    "silver_oni": """
        SELECT * EXCLUDE (k), CASE WHEN abs(anomaly_c) < 0.5 THEN 'Neutral' WHEN anomaly_c > 0 THEN 'El Niño' ELSE 'La Niña' END AS phase,
               CASE WHEN abs(anomaly_c) < 0.5 THEN 'Neutral'
                    WHEN anomaly_c > 0 THEN 'El Niño ' || CASE WHEN anomaly_c < 1 THEN 'débil' WHEN anomaly_c < 1.5 THEN 'moderado'
                                                             WHEN anomaly_c < 2 THEN 'fuerte' ELSE 'muy fuerte' END
                    ELSE 'La Niña ' || CASE WHEN anomaly_c > -1 THEN 'débil' WHEN anomaly_c > -1.5 THEN 'moderada' ELSE 'fuerte' END
               END AS intensity
        FROM bronze_oni QUALIFY k = max(k) OVER (PARTITION BY year, season)""",
    "silver_historical_events": """
        SELECT * EXCLUDE (k), ifnull(end_year - start_year, 0) AS duration_years, end_year IS NULL AS is_point_event
        FROM bronze_events QUALIFY k = max(k) OVER (PARTITION BY id)""",
    "anchor_rows": "SELECT * FROM bronze_world_population QUALIFY k = max(k) OVER (PARTITION BY year)",
    "month_counts": """
        SELECT row_number() OVER (ORDER BY s) AS t, n
        FROM (SELECT date_trunc('month', time) AS s, count(*) AS n FROM silver_earthquakes GROUP BY 1)""",
    "year_counts": "SELECT year(time) AS year, count(*) AS n FROM silver_earthquakes GROUP BY 1",
    "numbered": """
        SELECT location_id, local_date, temp_max, row_number() OVER (PARTITION BY location_id ORDER BY local_date) AS n FROM obs""",
    "place_months": """
        SELECT location_id, year(local_date) AS year, month(local_date) AS month, avg(temp_mean) AS v FROM obs GROUP BY ALL""",
    # --- Weather ----------------------------------------------------------------
    "gold_weather_from_hours": """
        SELECT h.location_id, ((h.time AT TIME ZONE 'UTC') AT TIME ZONE p.timezone)::DATE AS local_date, h.kind,
               count(*) AS hours, avg(temperature_2m) AS temp_mean, min(temperature_2m) AS temp_min,
               max(temperature_2m) AS temp_max, max(temperature_2m) - min(temperature_2m) AS temp_range,
               min(apparent_temperature) AS apparent_min, max(apparent_temperature) AS apparent_max,
               sum(precipitation) AS precip_sum, avg(pressure_msl) AS pressure_msl_mean,
               min(pressure_msl) AS pressure_msl_min, avg(surface_pressure) AS surface_pressure_mean,
               avg(relative_humidity_2m) AS humidity_mean, avg(cloud_cover) AS cloud_cover_mean,
               max(wind_gusts_10m) AS wind_gust_max, sum(shortwave_radiation) AS radiation_sum
        FROM silver_weather_hourly h, dim_locations p WHERE p.id = h.location_id
        GROUP BY ALL HAVING count(*) >= 5""",
    "obs": """
        SELECT *, dayofyear(local_date) AS doy, year(local_date) AS yr FROM gold_weather_daily WHERE kind = 'observed'""",
    "gold_climatology": """
        SELECT location_id, d.doy::INTEGER AS doy, count(*) AS n_samples, avg(temp_mean) AS temp_mean_avg,
               stddev_samp(temp_mean) AS temp_mean_sd, quantile_cont(temp_mean, 0.05) AS temp_mean_p05,
               quantile_cont(temp_mean, 0.95) AS temp_mean_p95, avg(temp_max) AS temp_max_avg,
               quantile_cont(temp_max, 0.95) AS temp_max_p95, max(temp_max) AS temp_max_record,
               avg(temp_min) AS temp_min_avg, quantile_cont(temp_min, 0.05) AS temp_min_p05,
               min(temp_min) AS temp_min_record, avg(precip_sum) AS precip_avg
        FROM obs o, range(1, 367) d(doy)
        WHERE yr <= 1998 AND (abs(o.doy - d.doy) <= 7 OR abs(o.doy - d.doy) >= 359)
        GROUP BY ALL""",
    "gold_temperature_anomaly": """
        SELECT w.location_id, w.local_date, w.kind, n.doy, w.temp_mean, n.temp_mean_avg AS clim_mean,
               w.temp_mean - n.temp_mean_avg AS anomaly_c,
               (w.temp_mean - n.temp_mean_avg) / nullif(n.temp_mean_sd, 0) AS z_score,
               w.temp_max, n.temp_max_p95 AS clim_max_p95, n.temp_max_record AS clim_max_record,
               w.temp_max > n.temp_max_p95 AS extreme_heat, w.temp_max > n.temp_max_record AS record_heat,
               w.temp_min, n.temp_min_p05 AS clim_min_p05, n.temp_min_record AS clim_min_record,
               w.temp_min < n.temp_min_p05 AS extreme_cold, w.temp_min < n.temp_min_record AS record_cold,
               w.precip_sum, n.precip_avg AS clim_precip_avg, n.n_samples AS clim_n_samples,
               year(w.local_date) BETWEEN 1995 AND 1998 AS in_baseline
        FROM gold_weather_daily w, gold_climatology n
        WHERE n.location_id = w.location_id AND n.doy = dayofyear(w.local_date)""",
    "gold_heatwave_features": """
        SELECT f.location_id, f.local_date, f.doy, f.yr AS year, f.temp_max > p95 AS is_extreme, f.temp_max,
               p95 AS temp_max_p95_train, lag7 AS anomaly_lag7, mean14 AS anomaly_mean_14d, max7 AS temp_max_lag7,
               e.anomaly_c AS oni_anomaly, e.phase AS enso_phase, f.yr <= 1998 AS in_train
        FROM (SELECT x.*, avg(a) OVER (PARTITION BY location_id ORDER BY local_date ROWS BETWEEN 20 PRECEDING AND 7 PRECEDING) AS mean14,
                     lag(a, 7) OVER s AS lag7, lag(temp_max, 7) OVER s AS max7
              FROM (SELECT o.*, c.temp_max_p95 AS p95, o.temp_mean - c.temp_mean_avg AS a
                    FROM obs o JOIN gold_climatology c USING (location_id, doy)) x
              WINDOW s AS (PARTITION BY location_id ORDER BY local_date)) f
        LEFT JOIN silver_oni e ON e.year = f.yr AND e.season_index = month(f.local_date)
        WHERE lag7 IS NOT NULL AND mean14 IS NOT NULL AND p95 IS NOT NULL""",
    "heat_cells": """
        SELECT *, CASE WHEN anomaly_mean_14d >= 2 THEN '5. muy cálida (>2)' WHEN anomaly_mean_14d >= 1 THEN '4. cálida (1 a 2)'
                       WHEN anomaly_mean_14d >= 0 THEN '3. normal (0 a 1)' WHEN anomaly_mean_14d >= -1 THEN '2. fría (-1 a 0)'
                       ELSE '1. muy fría (<-1)' END AS anomaly_bucket,
               ifnull(enso_phase, 'Neutral') AS enso_bucket, coalesce(is_extreme, false)::INTEGER AS hit
        FROM gold_heatwave_features""",
    "gold_heatwave_model": """
        SELECT anomaly_bucket, enso_bucket, count(*) AS n_train, sum(hit)::BIGINT AS n_extreme,
               (1 + sum(hit)) / (2.0::DOUBLE + count(*)) AS p_extreme,
               (SELECT avg(hit) FROM heat_cells WHERE in_train) AS base_rate,
               (1 + sum(hit)) / (2.0::DOUBLE + count(*)) / nullif((SELECT avg(hit) FROM heat_cells WHERE in_train), 0) AS lift
        FROM heat_cells WHERE in_train GROUP BY ALL""",
    "gold_heatwave_backtest": """
        SELECT *, 1 - brier_model / nullif(brier_base, 0) AS brier_skill_score,
               100 - 100 * brier_model / nullif(brier_base, 0) AS pct_improvement,
               brier_model < brier_base AS beats_climatology
        FROM (SELECT CASE WHEN grouping(c.location_id) = 1 THEN 'GLOBAL' ELSE c.location_id END AS scope,
                     count(*) AS n_test, sum(hit)::BIGINT AS n_extreme, avg(hit) AS observed_rate,
                     avg((p_extreme - hit) ** 2) AS brier_model, avg((base_rate - hit) ** 2) AS brier_base
              FROM heat_cells c JOIN gold_heatwave_model USING (anomaly_bucket, enso_bucket)
              WHERE NOT in_train GROUP BY GROUPING SETS ((c.location_id), ()))""",
    "gold_heat_threshold_drift": """
        SELECT p.id AS location_id, p.name AS location_name, p.country, p.koppen, abs(p.lat) AS abs_lat,
               thr AS threshold_2006_2018, now_thr AS threshold_2019_2025, now_thr - thr AS threshold_drift_c,
               n_recent_days, n_exceeded, 100.0::DOUBLE * n_exceeded / n_recent_days AS pct_exceeded_now,
               5.0::DOUBLE AS pct_expected, 20.0::DOUBLE * n_exceeded / n_recent_days AS amplification,
               18.0::DOUBLE AS days_per_year_expected,
               round(365.0::DOUBLE * n_exceeded / n_recent_days) AS days_per_year_now,
               sd AS temp_variability_sd, rec AS temp_max_record,
               CASE WHEN n_exceeded >= 0.25 * n_recent_days THEN '1. urgente' WHEN n_exceeded >= 0.15 * n_recent_days THEN '2. alta'
                    WHEN n_exceeded >= 0.09 * n_recent_days THEN '3. media' ELSE '4. baja' END AS recalibration_priority
        FROM (SELECT o.location_id, any_value(c.thr) AS thr, any_value(c.sd) AS sd, count(*) AS n_recent_days,
                     count(*) FILTER (o.temp_max > c.thr) AS n_exceeded,
                     quantile_cont(o.temp_max, 0.95) AS now_thr, max(o.temp_max) AS rec
              FROM obs o JOIN (SELECT location_id, quantile_cont(temp_max, 0.95) AS thr, stddev_samp(temp_mean) AS sd
                               FROM obs WHERE yr <= 1998 GROUP BY 1) c USING (location_id)
              WHERE o.yr BETWEEN 1999 AND 2001 GROUP BY 1) z
        JOIN dim_locations p ON p.id = z.location_id""",
    # --- Earthquakes --------------------------------------------------------------
    "gold_quake_magnitude_frequency": """
        SELECT b.mag_bin, b.n_events, sum(a.n_events)::BIGINT AS n_cumulative, log10(sum(a.n_events)) AS log10_n_cumulative
        FROM mag_bins b JOIN mag_bins a ON a.mag_bin >= b.mag_bin GROUP BY ALL""",
    "mag_bins": """
        SELECT floor(magnitude * 10) / 10 AS mag_bin, count(*) AS n_events FROM silver_earthquakes
        WHERE magnitude >= 4.5 GROUP BY 1""",
    "gold_quake_b_value": """
        SELECT scope, n_events, mag_mean, mag_max, b AS b_value, b / sqrt(n_events) AS b_std_error,
               log10(n_events) + 4.5::DOUBLE * b AS a_value
        FROM (SELECT unnest(['global', depth_class]) AS scope, count(*) AS n_events, avg(magnitude) AS mag_mean,
                     max(magnitude) AS mag_max, 0.43429448190325182::DOUBLE / (avg(magnitude) - 4.45::DOUBLE) AS b
              FROM (SELECT depth_class, magnitude FROM silver_earthquakes WHERE magnitude >= 4.5) GROUP BY 1)""",
    "quake_pairs": """
        SELECT m.event_id AS main_id, m.place AS main_place, m.magnitude AS main_mag, m.time AS main_time, a.event_id,
               a.time, a.magnitude, (epoch(date_trunc('hour', a.time))::BIGINT - epoch(date_trunc('hour', m.time))::BIGINT) // 86400 + 1 AS day_after
        FROM silver_earthquakes m, silver_earthquakes a
        WHERE m.magnitude >= 6.5 AND a.magnitude BETWEEN 4.5 AND m.magnitude AND a.magnitude <> m.magnitude
          AND a.time > m.time AND a.time - m.time <= INTERVAL 30 DAY AND km(m.lat, m.lon, a.lat, a.lon) <= 150""",
    "gold_quake_sequences": """
        SELECT d.*, t.sequence_total
        FROM (SELECT main_id AS mainshock_id, main_place AS mainshock_place, main_mag AS mainshock_mag, main_time AS mainshock_time,
                     day_after, count(*) AS aftershocks, max(magnitude) AS max_aftershock_mag FROM quake_pairs GROUP BY ALL) d
        JOIN (SELECT main_id AS mainshock_id, count(*) AS sequence_total FROM quake_pairs GROUP BY 1) t USING (mainshock_id)""",
    "near_pairs": """
        SELECT p.id AS location_id, p.name AS location_name, p.country, p.timezone, q.*, km(p.lat, p.lon, q.lat, q.lon) AS distance_km
        FROM dim_locations p, silver_earthquakes q WHERE km(p.lat, p.lon, q.lat, q.lon) <= 700""",
    "gold_quakes_near_city": """
        SELECT location_id, location_name, country, event_id, time, magnitude, 'mb' AS magnitude_type, depth_km, depth_class,
               place, tsunami, NULL::VARCHAR AS alert, significance, NULL::VARCHAR AS url, distance_km, lat, lon,
               (time AT TIME ZONE 'UTC') AT TIME ZONE timezone AS local_time
        FROM near_pairs""",
    "quake_days": """
        SELECT location_id, pressure_msl_mean AS pr, temp_mean AS te, coalesce(n, 0) AS quakes
        FROM obs LEFT JOIN (SELECT location_id, ((time AT TIME ZONE 'UTC') AT TIME ZONE timezone)::DATE AS local_date, count(*) AS n
                            FROM near_pairs WHERE distance_km <= 500 GROUP BY ALL) USING (location_id, local_date)
        WHERE pressure_msl_mean IS NOT NULL""",
    "gold_quake_pressure_test": """
        SELECT *, 1.96::DOUBLE / sqrt(n_days) AS r_significance_threshold,
               abs(r_pressure) > 1.96::DOUBLE / sqrt(n_days) AS pressure_significant,
               100 * r_pressure ** 2 AS pct_variance_explained
        FROM (SELECT CASE WHEN grouping(location_id) = 1 THEN 'POOLED' ELSE location_id END AS location_id, count(*) AS n_days,
                     sum(quakes)::BIGINT AS total_quakes, 100.0::DOUBLE * count(*) FILTER (quakes > 0) / count(*) AS pct_days_with_quake,
                     r(quakes, pr) AS r_pressure, r(quakes, te) AS r_temperature
              FROM quake_days GROUP BY GROUPING SETS ((location_id), ()))
        WHERE total_quakes >= 30 OR location_id = 'POOLED'""",
    "gold_aftershock_forecast": """
        SELECT m.event_id AS mainshock_id, m.time AS mainshock_time, m.magnitude AS mainshock_mag, m.lat, m.lon, m.place, m.depth_km,
               year(m.time) AS year, n1, y_days_2_8,
               CASE WHEN m.magnitude < 7 THEN 'M6.5-6.9' WHEN m.magnitude < 7.5 THEN 'M7.0-7.4'
                    WHEN m.magnitude < 8 THEN 'M7.5-7.9' ELSE 'M8+' END AS mag_band, ifnull(n1, 0) > 0 AS is_predictable
        FROM silver_earthquakes m
        LEFT JOIN (SELECT main_id, nullif(count(*) FILTER (day_after = 1), 0) AS n1,
                          nullif(count(*) FILTER (day_after BETWEEN 2 AND 8), 0) AS y_days_2_8
                   FROM quake_pairs GROUP BY 1) s ON s.main_id = m.event_id
        WHERE m.magnitude >= 6.5 AND NOT EXISTS (
            SELECT 1 FROM silver_earthquakes p WHERE p.magnitude > m.magnitude AND p.time < m.time
             AND m.time - p.time <= INTERVAL 90 DAY AND km(p.lat, p.lon, m.lat, m.lon) <= 150)""",
    # --- Birds, disasters, epidemics ----------------------------------------------
    "best_day": """
        SELECT w.*, a.anomaly_c FROM (SELECT * FROM gold_weather_daily
            QUALIFY row_number() OVER (PARTITION BY location_id, local_date ORDER BY kind DESC) = 1) w
        LEFT JOIN gold_temperature_anomaly a USING (location_id, local_date, kind)""",
    "gold_bird_daily": """
        SELECT b.*, w.temp_mean, w.temp_min, w.temp_max, w.precip_sum, w.kind AS weather_kind, w.anomaly_c AS temp_anomaly_c
        FROM (SELECT location_id, obs_datetime::DATE AS obs_date, count(DISTINCT species_code) AS species_richness,
                     count(*) AS observations, count(DISTINCT checklist_id) AS checklists,
                     sum(how_many)::BIGINT AS individuals_counted, count(how_many) AS observations_with_count
              FROM silver_bird_observations GROUP BY ALL) b
        LEFT JOIN best_day w ON w.location_id = b.location_id AND w.local_date = b.obs_date""",
    "counted_twice": """
        SELECT t.source_id FROM silver_historical_disasters t, silver_historical_disasters o
        WHERE t.hazard_type = 'tsunami' AND t.deaths_best IS NOT DISTINCT FROM o.deaths_best
          AND ((o.hazard_type = 'earthquake' AND o.source_id = t.caused_earthquake_id)
            OR (o.hazard_type = 'volcano' AND o.caused_tsunami_id = t.source_id))""",
    "ranked_base": """
        SELECT * FROM silver_historical_disasters d WHERE deaths_best > 0
          AND (hazard_type <> 'tsunami' OR source_id NOT IN (SELECT source_id FROM counted_twice))""",
    "gold_disasters_ranked": """
        SELECT d.hazard_type, d.source_id, d.year, d.month, d.day, d.event_date, d.date_precision, d.century, d.country, d.location_name,
               d.latitude, d.longitude, d.deaths_best AS deaths, d.deaths AS deaths_direct, d.deaths_total,
               d.deaths_total - d.deaths AS deaths_from_cascade, d.injuries_total, d.damage_musd_total AS damage_musd,
               d.houses_destroyed, d.eq_magnitude, NULL::DOUBLE AS eq_depth_km, NULL::DOUBLE AS eq_intensity,
               d.tsunami_max_water_height_m, d.tsunami_num_runups, d.volcano_vei, d.volcano_name,
               d.caused_earthquake_id, d.caused_tsunami_id, w.n IS NOT NULL AS generated_tsunami,
               coalesce(d.tsunami_max_water_height_m, w.wave) AS tsunami_wave_m,
               EXISTS (SELECT 1 FROM ranked_base o WHERE o.year = d.year AND o.deaths_best = d.deaths_best
                       AND (o.hazard_type, o.source_id) <> (d.hazard_type, d.source_id)
                       AND km(o.latitude, o.longitude, d.latitude, d.longitude) <= 200) AS suspected_duplicate
        FROM ranked_base d LEFT JOIN (
            SELECT CASE WHEN o.hazard_type = 'volcano' THEN 'volcano' ELSE 'earthquake' END AS ht, o.source_id AS oid, count(*) AS n,
                   max(t.tsunami_max_water_height_m) AS wave
            FROM silver_historical_disasters o JOIN silver_historical_disasters t ON t.hazard_type = 'tsunami'
             AND ((o.hazard_type = 'earthquake' AND t.caused_earthquake_id = o.source_id)
               OR (o.hazard_type = 'volcano' AND o.caused_tsunami_id = t.source_id)) GROUP BY ALL) w
          ON w.ht = d.hazard_type AND w.oid = d.source_id""",
    "gold_disaster_cascades": """
        SELECT o.hazard_type AS trigger_type, o.source_id AS trigger_id,
               CASE o.hazard_type WHEN 'volcano' THEN o.volcano_vei::DOUBLE ELSE o.eq_magnitude END AS trigger_magnitude,
               t.source_id AS tsunami_id, t.year, t.month, t.day, t.event_date, t.country, t.location_name,
               o.deaths AS trigger_deaths_direct, o.deaths_total AS trigger_deaths_total, t.deaths_best AS tsunami_deaths,
               t.tsunami_max_water_height_m AS max_wave_m, t.tsunami_num_runups AS runups,
               1 - coalesce(o.deaths, 0) / nullif(greatest(o.deaths_total, 0), 0)::DOUBLE
                 + CASE WHEN o.deaths_total IS NULL THEN NULL ELSE 0 END AS cascade_death_share
        FROM silver_historical_disasters o JOIN silver_historical_disasters t ON t.hazard_type = 'tsunami'
         AND ((o.hazard_type = 'earthquake' AND t.caused_earthquake_id = o.source_id)
           OR (o.hazard_type = 'volcano' AND o.caused_tsunami_id = t.source_id))""",
    "gold_disasters_by_century": """
        SELECT century, hazard_type, count(*) AS events, count(deaths_best) AS events_with_exact_deaths,
               100.0::DOUBLE * count(deaths_best) / count(*) AS pct_with_exact_deaths, sum(deaths_best)::BIGINT AS deaths_counted,
               max(deaths_best) AS deadliest_event_deaths,
               100.0::DOUBLE * count(*) FILTER (month IS NOT NULL AND day IS NOT NULL) / count(*) AS pct_full_date
        FROM silver_historical_disasters GROUP BY ALL""",
    "gold_epidemics_vs_disasters": """
        SELECT 'epidemic' AS family, id AS event_key, name AS event_name, disease AS subtype, start_year AS year, end_year,
               duration_years, regions AS location, deaths_low, deaths_high, deaths_mid AS deaths_representative,
               deaths_uncertainty_ratio, estimate_confidence, 'estimación' AS estimate_kind, source AS source_note
        FROM silver_epidemics WHERE deaths_low IS NOT NULL
        UNION ALL
        SELECT 'natural_disaster', concat(hazard_type, ':', source_id), coalesce(volcano_name, location_name, country), hazard_type,
               year, year, 1, ifnull(location_name, country), deaths, deaths, deaths::DOUBLE, 1.0::DOUBLE, 'alta', 'recuento', 'NOAA NCEI'
        FROM gold_disasters_ranked WHERE deaths >= 10000""",
    "gold_catastrophes_per_capita": """
        SELECT e.* EXCLUDE (end_year, deaths_uncertainty_ratio, source_note), w.population_mid AS world_population,
               w.population_low AS world_population_low, w.population_high AS world_population_high,
               w.source_kind AS population_source, w.uncertainty_ratio AS population_uncertainty,
               deaths_representative / w.population_mid * 1e6 AS deaths_per_million,
               round(w.population_mid / nullif(deaths_representative, 0))::BIGINT AS one_in_every,
               deaths_representative / w.population_mid * 100 AS pct_of_humanity,
               deaths_low / w.population_high * 1e6 AS deaths_per_million_low,
               deaths_high / w.population_low * 1e6 AS deaths_per_million_high
        FROM gold_epidemics_vs_disasters e JOIN gold_world_population w ON w.year = e.year
        WHERE deaths_representative IS NOT NULL""",
    # --- Cyclones, population ------------------------------------------------------
    "gold_cyclones": """
        SELECT sid, min(season) AS season, min(basin) AS basin, min(subbasin) AS subbasin, max(name) AS name,
               min(time) AS first_seen, max(time) AS last_seen, epoch(max(time) - min(time)) / 86400.0::DOUBLE AS duration_days,
               count(*) AS track_points, max(wind_kt) AS max_wind_kt, min(pressure_mb) AS min_pressure_mb,
               max(usa_sshs) AS max_category, sum(wind_kt * wind_kt / 10000) FILTER (is_synoptic AND wind_kt >= 34) AS ace,
               bool_or(is_tropical_storm) AS reached_tropical_storm, bool_or(is_hurricane) AS reached_hurricane,
               bool_or(usa_sshs >= 3) AS reached_major_hurricane, bool_or(dist2land_km = 0) AS made_landfall,
               min(dist2land_km) AS min_dist_to_land_km,
               arg_max(lat, wind_kt * 1e10 - epoch(time)) AS peak_lat, arg_max(lon, wind_kt * 1e10 - epoch(time)) AS peak_lon,
               arg_max(time, wind_kt * 1e10 - epoch(time)) AS peak_time
        FROM silver_cyclone_tracks GROUP BY sid""",
    "gold_cyclone_seasons": """
        SELECT season, basin, count(*) AS systems, count(*) FILTER (reached_tropical_storm) AS tropical_storms,
               count(*) FILTER (reached_hurricane) AS hurricanes, count(*) FILTER (reached_major_hurricane) AS major_hurricanes,
               count(*) FILTER (made_landfall) AS landfalling, sum(ace) AS ace_total, avg(ace) AS ace_mean_per_system,
               max(max_wind_kt) AS strongest_wind_kt, min(min_pressure_mb) AS lowest_pressure_mb,
               avg(duration_days) AS mean_duration_days
        FROM gold_cyclones WHERE basin IS NOT NULL GROUP BY ALL""",
    "passages": """
        SELECT p.id AS location_id, p.name AS location_name, p.timezone, s.*, km(p.lat, p.lon, s.lat, s.lon) AS dist
        FROM dim_locations p, silver_cyclone_tracks s WHERE km(p.lat, p.lon, s.lat, s.lon) <= 500""",
    "gold_cyclones_near_city": """
        SELECT c.location_id, c.location_name, c.sid, g.name AS storm_name, g.season, g.basin, c.min_distance_km, c.closest_time,
               c.wind AS wind_at_closest_kt, c.pressure AS pressure_at_closest_mb, c.category AS category_at_closest,
               g.max_wind_kt AS storm_max_wind_kt, g.max_category AS storm_max_category, g.ace AS storm_ace,
               ((c.closest_time AT TIME ZONE 'UTC') AT TIME ZONE c.timezone)::DATE AS local_date
        FROM (SELECT location_id, location_name, timezone, sid, min(dist) AS min_distance_km,
                     list(time ORDER BY dist, time)[1] AS closest_time,
                     (list(wind_kt ORDER BY dist, time) FILTER (wind_kt IS NOT NULL))[1] AS wind,
                     (list(pressure_mb ORDER BY dist, time) FILTER (pressure_mb IS NOT NULL))[1] AS pressure,
                     (list(usa_sshs ORDER BY dist, time) FILTER (usa_sshs IS NOT NULL))[1] AS category
              FROM passages GROUP BY 1, 2, 3, 4) c JOIN gold_cyclones g USING (sid)""",
    "gold_enso_cyclones": """
        SELECT s.basin, e.phase, count(*) AS seasons, avg(ace_total) AS ace_mean, avg(hurricanes) AS hurricanes_mean,
               avg(major_hurricanes) AS major_hurricanes_mean, avg(systems) AS systems_mean, r(e.anomaly_c, ace_total) AS r_oni_vs_ace
        FROM gold_cyclone_seasons s, silver_oni e
        WHERE e.year = s.season AND e.season = 'ASO' AND s.season BETWEEN 1995 AND 2001 AND s.basin IN ('NA', 'EP', 'WP', 'NI')
        GROUP BY ALL""",
    "people_anchors": """
        SELECT year, population_low AS lo, population_high AS hi, confidence FROM bronze_world_population
        QUALIFY k = max(k) OVER (PARTITION BY year)
        UNION ALL
        SELECT year, population, population, 'alta' FROM silver_population WHERE country_id = 'WLD'
        QUALIFY year = min(year) OVER ()""",
    "gold_world_population": """
        SELECT y.year::BIGINT AS year, round(low)::BIGINT AS population_low, round(high)::BIGINT AS population_high,
               round((low + high) / 2)::BIGINT AS population_mid, high / nullif(low, 0) AS uncertainty_ratio,
               share = 0 AS is_anchor, confidence, 'estimación histórica' AS source_kind
        FROM (SELECT y.year, a.confidence, CASE WHEN b.year = a.year THEN 0 ELSE (y.year - a.year) / (b.year - a.year)::DOUBLE END AS share,
                     a.lo + (b.lo - a.lo) * share AS low, a.hi + (b.hi - a.hi) * share AS high
              FROM range((SELECT min(year) FROM people_anchors)::BIGINT, (SELECT min(year) FROM silver_population WHERE country_id = 'WLD')::BIGINT) y(year)
              ASOF JOIN people_anchors a ON y.year >= a.year ASOF JOIN people_anchors b ON y.year <= b.year) y
        UNION ALL
        SELECT year, population, population, population, 1.0::DOUBLE, true, 'alta', 'Banco Mundial'
        FROM silver_population WHERE country_id = 'WLD'""",
    # --- Panels -----------------------------------------------------------------------
    "gold_year_panel_base": """
        SELECT y.year::INTEGER AS year, c.* EXCLUDE (year), cy.* EXCLUDE (year), e.* EXCLUDE (year), ey.* EXCLUDE (year),
               q.* EXCLUDE (year), sq.* EXCLUDE (year), d.* EXCLUDE (year), p.* EXCLUDE (year), ep.* EXCLUDE (year), h.milestones,
               (c.temp_anomaly_mean IS NOT NULL)::INTEGER + (cy.cyclone_ace_global IS NOT NULL)::INTEGER + (e.oni_aso IS NOT NULL)::INTEGER
               + (q.quakes_m45 IS NOT NULL)::INTEGER + (d.noaa_disasters IS NOT NULL)::INTEGER
               + (p.world_population IS NOT NULL)::INTEGER + (ep.epidemics_active IS NOT NULL)::INTEGER AS sources_available,
               ifnull(h.seen, false) AS milestone_year
        FROM range(1900, 2027) y(year)
        LEFT JOIN (SELECT year(local_date) AS year, avg(anomaly_c) AS temp_anomaly_mean,
                          100 * avg(coalesce(extreme_heat, false)::INTEGER) AS pct_extreme_heat_days,
                          count(*) FILTER (record_heat) AS heat_records
                   FROM gold_temperature_anomaly WHERE kind = 'observed' GROUP BY 1) c ON c.year = y.year
        LEFT JOIN (SELECT season AS year, sum(ace_total) AS cyclone_ace_global, sum(systems)::BIGINT AS cyclone_systems,
                          sum(hurricanes)::BIGINT AS hurricanes, sum(major_hurricanes)::BIGINT AS major_hurricanes,
                          sum(landfalling)::BIGINT AS landfalling, sum(ace_total) FILTER (basin = 'NA') AS ace_atlantic,
                          sum(ace_total) FILTER (basin = 'EP') AS ace_east_pacific, sum(ace_total) FILTER (basin = 'WP') AS ace_west_pacific
                   FROM gold_cyclone_seasons GROUP BY 1) cy ON cy.year = y.year
        LEFT JOIN (SELECT year, anomaly_c AS oni_aso, phase AS enso_phase, intensity AS enso_intensity FROM silver_oni
                   WHERE season = 'ASO') e ON e.year = y.year
        LEFT JOIN (SELECT year, avg(anomaly_c) AS oni_year_mean FROM silver_oni GROUP BY 1) ey ON ey.year = y.year
        LEFT JOIN (SELECT year(time) AS year, count(*) AS quakes_m45, count(*) FILTER (magnitude >= 7) AS quakes_m7,
                          max(magnitude) AS max_magnitude, count(*) FILTER (tsunami) AS tsunamigenic
                   FROM silver_earthquakes GROUP BY 1) q ON q.year = y.year
        LEFT JOIN (SELECT year, count(*) AS aftershock_sequences FROM gold_aftershock_forecast WHERE is_predictable GROUP BY 1) sq
               ON sq.year = y.year
        LEFT JOIN (SELECT year, count(*) AS noaa_disasters, sum(deaths_best)::BIGINT AS disaster_deaths,
                          max(deaths_best) AS deadliest_event_deaths FROM silver_historical_disasters GROUP BY 1) d ON d.year = y.year
        LEFT JOIN (SELECT year, population_mid AS world_population, source_kind AS population_source FROM gold_world_population) p
               ON p.year = y.year
        LEFT JOIN (SELECT v.year, count(*) AS epidemics_active, string_agg(name, ' · ' ORDER BY start_year, id) AS epidemic_names
                   FROM range(1900, 2027) v(year), silver_epidemics WHERE v.year BETWEEN start_year AND ifnull(end_year, 2026)
                   GROUP BY 1) ep ON ep.year = y.year
        LEFT JOIN (SELECT v.year, bool_or(category = 'observacion') AS seen, string_agg(name, ' · ' ORDER BY start_year, id) AS milestones
                   FROM range(1900, 2027) v(year), silver_historical_events WHERE v.year BETWEEN start_year AND ifnull(end_year, start_year)
                   GROUP BY 1) h ON h.year = y.year""",
    "gold_year_panel": """
        SELECT * EXCLUDE (step), sum(coalesce(step, 0)) OVER (ORDER BY year)::BIGINT AS coverage_regime,
               step = 1 AS coverage_regime_change
        FROM (SELECT *, (sources_available <> lag(sources_available) OVER (ORDER BY year))::INTEGER AS step FROM gold_year_panel_base)""",
    "month_base": """
        SELECT y.year::INTEGER AS year, m.month::INTEGER AS month, make_date(y.year, m.month, 1) AS month_start, o.* EXCLUDE (year, month), c.* EXCLUDE (year, month),
               t.* EXCLUDE (year, month), g.cyclones_formed, q.* EXCLUDE (year, month), d.* EXCLUDE (year, month), b.* EXCLUDE (year, month)
        FROM range(1950, 2027) y(year) CROSS JOIN range(1, 13) m(month)
        LEFT JOIN (SELECT year, season_index AS month, anomaly_c AS oni, phase AS oni_phase, intensity AS oni_intensity FROM silver_oni) o
               ON (o.year, o.month) = (y.year, m.month)
        LEFT JOIN (SELECT year(local_date) AS year, month(local_date) AS month, avg(anomaly_c) AS temp_anomaly_mean,
                          100 * avg(coalesce(extreme_heat, false)::INTEGER) AS pct_extreme_heat_days,
                          count(DISTINCT location_id) AS climate_cities
                   FROM gold_temperature_anomaly WHERE kind = 'observed' GROUP BY ALL) c ON (c.year, c.month) = (y.year, m.month)
        LEFT JOIN (SELECT year(time) AS year, month(time) AS month, sum(wind_kt ** 2 / 10000) FILTER (is_synoptic AND wind_kt >= 34) AS cyclone_ace,
                          count(DISTINCT sid) AS cyclones_active, count(DISTINCT sid) FILTER (is_hurricane) AS hurricanes_active,
                          max(wind_kt) AS max_wind_kt FROM silver_cyclone_tracks GROUP BY ALL) t ON (t.year, t.month) = (y.year, m.month)
        LEFT JOIN (SELECT year(first_seen) AS year, month(first_seen) AS month, count(*) AS cyclones_formed FROM gold_cyclones GROUP BY ALL) g
               ON (g.year, g.month) = (y.year, m.month)
        LEFT JOIN (SELECT year(time) AS year, month(time) AS month, count(*) AS quakes_m45, max(magnitude) AS max_magnitude
                   FROM silver_earthquakes GROUP BY ALL) q ON (q.year, q.month) = (y.year, m.month)
        LEFT JOIN (SELECT year, month, count(*) AS noaa_disasters, sum(deaths_best)::BIGINT AS disaster_deaths
                   FROM silver_historical_disasters WHERE month IS NOT NULL GROUP BY ALL) d ON (d.year, d.month) = (y.year, m.month)
        LEFT JOIN (SELECT f.year, f.month, sum(ifnull(cnt, 0))::BIGINT AS bird_records,
                          sum(ifnull(cnt, 0)) FILTER (species_key < 4)::BIGINT AS bird_records_migratory
                   FROM (SELECT DISTINCT species_key, location_id, year, v.month FROM bird_months, range(1, 13) v(month)) f
                   LEFT JOIN bird_months USING (species_key, location_id, year, month) GROUP BY ALL) b
               ON (b.year, b.month) = (y.year, m.month)""",
    "gold_month_panel": """
        SELECT x.*, x.cyclone_ace - a.ace AS cyclone_ace_deseason, x.cyclones_formed - a.formed AS cyclones_formed_deseason,
               x.hurricanes_active - a.hurr AS hurricanes_active_deseason, x.bird_records - a.birds AS bird_records_deseason,
               (oni IS NOT NULL)::INTEGER + (temp_anomaly_mean IS NOT NULL)::INTEGER + (cyclone_ace IS NOT NULL)::INTEGER
               + (quakes_m45 IS NOT NULL)::INTEGER + (noaa_disasters IS NOT NULL)::INTEGER + (bird_records IS NOT NULL)::INTEGER AS sources_available
        FROM month_base x JOIN (SELECT month, avg(cyclone_ace) AS ace, avg(cyclones_formed) AS formed, avg(hurricanes_active) AS hurr,
                                       avg(bird_records) AS birds FROM month_base GROUP BY 1) a USING (month)""",
    "panel_long": """
        SELECT 'gold_year_panel' AS panel, * FROM (UNPIVOT (SELECT year, 1 AS month, COLUMNS([YEARCOLS])::DOUBLE FROM gold_year_panel)
            ON COLUMNS(* EXCLUDE (year, month)) INTO NAME column_name VALUE value)
        UNION ALL
        SELECT 'gold_month_panel', * FROM (UNPIVOT (SELECT year, month, COLUMNS([MONTHCOLS])::DOUBLE FROM gold_month_panel)
            ON COLUMNS(* EXCLUDE (year, month)) INTO NAME column_name VALUE value)""",
    "gold_panel_coverage": """
        SELECT panel, column_name, first_year, last_year, n AS n_observations, rho AS acf1,
               greatest(3, round(ne))::INTEGER AS n_effective, 1.96::DOUBLE / sqrt(n) AS r_threshold_naive,
               1.96::DOUBLE / sqrt(greatest(ne, 3)) AS r_threshold_honest, sqrt(n / greatest(ne, 3)) AS naive_underestimates_by,
               ne >= 30 AS analyzable,
               CASE WHEN ne >= 60 THEN 'analizable' WHEN ne >= 30 THEN 'analizable con cautela'
                    WHEN ne >= 15 THEN 'dudoso: solo efectos enormes' ELSE 'NO analizable: n efectivo minimo' END AS verdict
        FROM (SELECT *, n * (1 - ifnull(rho, 0) ** 2) / (1 + ifnull(rho, 0) ** 2) AS ne
              FROM (SELECT panel, column_name, min(year) AS first_year, max(year) AS last_year, count(*) AS n, r(value, prev) AS rho
                    FROM (SELECT *, lag(value) OVER (PARTITION BY panel, column_name ORDER BY year, month) AS prev FROM panel_long)
                    GROUP BY ALL))""",
    # --- Model skill ---------------------------------------------------------------------
    "cuts": "SELECT unnest([1996, 1997, 1998, 1999]) AS cut_year",
    "skill_quakes": """
        SELECT 'pronostico_replicas' AS model_id, 'RMSE replicas dias 2-8' AS metric, c.cut_year, count(*) AS n_test,
               sqrt(avg((y_days_2_8 - n1 * (SELECT sum(y_days_2_8)::DOUBLE / sum(n1) FROM gold_aftershock_forecast
                                            WHERE is_predictable AND year <= c.cut_year)) ** 2)) AS value_model,
               sqrt(avg((y_days_2_8 - b.m) ** 2)) AS value_baseline
        FROM cuts c JOIN gold_aftershock_forecast f ON f.is_predictable AND f.year > c.cut_year
        JOIN (SELECT cut_year, mag_band, avg(y_days_2_8) AS m FROM cuts, gold_aftershock_forecast
              WHERE is_predictable AND year <= cut_year GROUP BY ALL) b ON b.cut_year = c.cut_year AND b.mag_band = f.mag_band
        GROUP BY ALL""",
    "heat_fit": """
        SELECT cut_year, location_id, quantile_cont(temp_max, 0.95) AS thr, regr_slope(temp_max, yr) AS slope
        FROM cuts, obs WHERE yr <= cut_year GROUP BY ALL""",
    "heat_freq": """
        SELECT f.cut_year, f.location_id, d.doy, avg((o.temp_max > f.thr)::INTEGER) AS p, avg(o.yr) AS y0
        FROM heat_fit f JOIN obs o ON o.location_id = f.location_id AND o.yr <= f.cut_year
        JOIN range(1, 367) d(doy) ON abs(o.doy - d.doy) <= 7 OR abs(o.doy - d.doy) >= 359 GROUP BY ALL""",
    "skill_heat": """
        SELECT 'riesgo_calor_corregido' AS model_id, 'Brier score' AS metric, cut_year, count(*) AS n_test,
               avg((least(1, greatest(0, p + slope * (yr - y0) * 0.05::DOUBLE)) - hot) ** 2) AS value_model, avg((p - hot) ** 2) AS value_baseline
        FROM (SELECT f.*, q.p, q.y0, o.yr, (o.temp_max > f.thr)::INTEGER AS hot FROM heat_fit f
              JOIN obs o ON o.location_id = f.location_id AND o.yr > f.cut_year
              JOIN heat_freq q ON q.cut_year = f.cut_year AND q.location_id = f.location_id AND q.doy = o.doy) GROUP BY ALL""",
    "lagged": """
        SELECT year(local_date) AS yr, anomaly_c AS a, lag(anomaly_c) OVER w AS l1, lag(anomaly_c, 7) OVER w AS l7
        FROM gold_temperature_anomaly WHERE kind = 'observed' WINDOW w AS (PARTITION BY location_id ORDER BY local_date)
        QUALIFY l7 IS NOT NULL""",
    "skill_carry": """
        SELECT 'persistencia_' || h AS model_id, 'RMSE anomalia C' AS metric, cut_year, count(*) AS n_test,
               sqrt(avg((a - CASE h WHEN '1d' THEN s1 * l1 ELSE s7 * l7 END) ** 2)) AS value_model, sqrt(avg(a * a)) AS value_baseline
        FROM (SELECT cut_year, regr_slope(a, l1) AS s1, regr_slope(a, l7) AS s7 FROM cuts, lagged WHERE yr <= cut_year GROUP BY 1) f
        JOIN lagged ON yr > cut_year CROSS JOIN (VALUES ('1d'), ('7d')) v(h) GROUP BY ALL""",
    "gold_model_skill": """
        SELECT s.model_id, 'GLOBAL' AS scope, s.cut_year, s.metric, s.n_test, s.value_model, s.value_baseline, s.gain AS improvement_pct,
               g.med AS improvement_median, g.lo AS improvement_min, g.hi AS improvement_max, g.n AS n_cuts,
               g.med >= 5 AND g.lo > 0 AS should_display
        FROM skill_all s JOIN (SELECT model_id, median(gain) AS med, min(gain) AS lo, max(gain) AS hi, count(*) AS n
                               FROM skill_all GROUP BY 1) g USING (model_id)""",
    "skill_all": """
        SELECT *, 100 - 100 * value_model / nullif(value_baseline, 0) AS gain
        FROM (FROM skill_quakes UNION ALL BY NAME FROM skill_heat UNION ALL BY NAME FROM skill_carry)""",
}


def _column_list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


# Normals and anomalies on the output of the daily model instead of the daily input.
CTES["chained_obs"] = CTES["obs"].replace("gold_weather_daily", "gold_weather_from_hours")
CTES["chained_climatology"] = CTES["gold_climatology"].replace("FROM obs o", "FROM chained_obs o").replace("yr <= 1998", "yr <= 2024")
CTES["chained_anomaly"] = (
    CTES["gold_temperature_anomaly"]
    .replace("gold_weather_daily w, gold_climatology n", "gold_weather_from_hours w, chained_climatology n")
    .replace("BETWEEN 1995 AND 1998", "BETWEEN 2023 AND 2024")
)

_WORD = re.compile(r"[a-z_][a-z0-9_]*")
_KM = re.compile(r"\bkm\(([^,()]+), ([^,()]+), ([^,()]+), ([^,()]+)\)")
_R = re.compile(r"\br\(([^,()]+), ([^,()]+)\)")


def _expand(sql: str) -> str:
    """Write out km(lat, lon, lat, lon) and r(x, y), which DuckDB does not have."""

    def distance(m: re.Match) -> str:
        a, b, c, d = m.groups()
        return (
            f"(12742.0176::DOUBLE * asin(least(1, sqrt(sin(radians({c} - {a}) / 2) ** 2 "
            f"+ cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2))))"
        )

    def pearson(m: re.Match) -> str:
        x, y = m.groups()
        return f"(CASE WHEN isfinite(corr({x}, {y})) THEN corr({x}, {y}) END)"

    return _R.sub(pearson, _KM.sub(distance, sql))


def compose(select: str) -> str:
    """A statement with the named subqueries that it needs, in order."""
    from terralake.plans.gold_panels import MONTH_MEASURES, YEAR_MEASURES

    done: dict[str, str] = {}

    def need(sql: str) -> None:
        for word in _WORD.findall(sql):
            if word in CTES and word not in done:
                body = CTES[word].replace("[YEARCOLS]", _column_list(YEAR_MEASURES)).replace(
                    "[MONTHCOLS]", _column_list(MONTH_MEASURES)
                )
                done[word] = ""
                need(body)
                del done[word]
                done[word] = body

    need(select)
    parts = [f"{name} AS MATERIALIZED ({_expand(body).strip()})" for name, body in done.items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + _expand(select)
