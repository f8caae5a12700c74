"""Double and date columns of each registered query, settled the same way on the SQL side.

Written by ``python -m workload.verify --columns``; a test keeps it in step.
"""

FLOAT_COLUMNS: dict[str, str] = {
    "pf1_filter_present": "depth_km",
    "pf3_all_but": "anomaly_c",
    "pf6_first_present": "wind_sum",
    "pf9_guarded_ratio": "direct_share",
    "pf10_clamp": "depth_share",
    "pf11_optional_filters": "magnitude",
    "j2_derived_key": "anomaly_c",
    "j4_left_preferred": "temp_mean",
    "j5_panel_star": "oni_max",
    "j6_circular_window": "temp_max_mean",
    "j7_geo_join": "distance_km",
    "j8_space_time_join": "largest",
    "j10_literal_cross": "anomaly_c",
    "j11_walk_forward": "mean_train mean_test",
    "j13_causal_link": "eq_magnitude",
    "j15_decluster": "magnitude",
    "j17_scalar": "local_mean overall_mean gap",
    "j18_acf": "acf",
    "a1_basic_aggregates": "mean low high",
    "a4_conditional_sum": "pct_shallow",
    "a6_standard_deviation": "sd",
    "a7_quantiles": "p05 p95",
    "a8_median": "median_deaths",
    "a9_correlation": "r r_constant",
    "a10_slope": "slope",
    "a11_value_at_extreme": "lat_at_max wind_at_min",
    "a15_detail_and_total": "mean",
    "a16_cyclone_energy": "ace",
    "a17_scores": "rmse brier_a brier_b skill gain_pct",
    "a18_smoothed_rate": "p",
    "a19_ratio_of_sums": "alpha",
    "w1_latest_by": "magnitude",
    "w2_prefer_by": "temp_mean",
    "w3_lag": "lag1 lag7",
    "w4_moving_mean": "mean14",
    "w7_aggregate_beside": "v low mid deseason",
    "w7_aggregate_beside_rows": "magnitude place_max",
    "o1_multi_key_sort": "depth_km",
    "o3_top_k": "magnitude",
    "u2_union_all": "largest",
    "u5_unpivot": "value",
    "f1_haversine": "km",
    "f3_math": "bin root square decay log sine bound",
    "s1_weather_hourly": "temperature_2m apparent_temperature precipitation pressure_msl cloud_cover",
    "s2_earthquakes": "magnitude lat lon depth_km",
    "s4_historical_disasters": "latitude longitude",
    "s5_epidemics": "deaths_mid deaths_uncertainty_ratio",
    "s6_cyclone_tracks": "lat lon wind_kt pressure_mb",
    "s8_oni": "sst_c anomaly_c",
    "g1_weather_daily": "temp_mean temp_min temp_max temp_range apparent_min apparent_max precip_sum pressure_msl_mean pressure_msl_min surface_pressure_mean humidity_mean cloud_cover_mean wind_gust_max radiation_sum",
    "g2_climatology": "temp_mean_avg temp_mean_sd temp_mean_p05 temp_mean_p95 temp_max_avg temp_max_p95 temp_max_record temp_min_avg temp_min_p05 temp_min_record precip_avg",
    "g2_climatology_of_daily": "temp_mean_avg temp_mean_sd temp_mean_p05 temp_mean_p95 temp_max_avg temp_max_p95 temp_max_record temp_min_avg temp_min_p05 temp_min_record precip_avg",
    "g3_temperature_anomaly": "temp_mean clim_mean anomaly_c z_score temp_max clim_max_p95 clim_max_record temp_min clim_min_p05 clim_min_record precip_sum clim_precip_avg",
    "g3_anomaly_of_daily": "temp_mean clim_mean anomaly_c z_score temp_max clim_max_p95 clim_max_record temp_min clim_min_p05 clim_min_record precip_sum clim_precip_avg",
    "g4_heatwave_features": "temp_max temp_max_p95_train anomaly_lag7 anomaly_mean_14d temp_max_lag7 oni_anomaly",
    "g5_heatwave_model": "p_extreme base_rate lift",
    "g6_heatwave_backtest": "observed_rate brier_model brier_base brier_skill_score pct_improvement",
    "g7_heat_threshold_drift": "abs_lat threshold_2006_2018 threshold_2019_2025 threshold_drift_c pct_exceeded_now pct_expected amplification days_per_year_expected days_per_year_now temp_variability_sd temp_max_record",
    "g8_magnitude_frequency": "mag_bin log10_n_cumulative",
    "g9_b_value": "mag_mean mag_max b_value b_std_error a_value",
    "g10_quake_sequences": "mainshock_mag max_aftershock_mag",
    "g11_quakes_near_city": "magnitude depth_km distance_km lat lon",
    "g12_pressure_test": "pct_days_with_quake r_pressure r_temperature r_significance_threshold pct_variance_explained",
    "g13_aftershock_forecast": "mainshock_mag lat lon depth_km",
    "g14_bird_daily": "temp_mean temp_min temp_max precip_sum temp_anomaly_c",
    "g15_disasters_ranked": "latitude longitude damage_musd eq_magnitude eq_depth_km eq_intensity tsunami_max_water_height_m tsunami_wave_m",
    "g16_disaster_cascades": "trigger_magnitude max_wave_m cascade_death_share",
    "g17_disasters_by_century": "pct_with_exact_deaths pct_full_date",
    "g18_epidemics_vs_disasters": "deaths_representative deaths_uncertainty_ratio",
    "g19_catastrophes_per_capita": "deaths_representative population_uncertainty deaths_per_million pct_of_humanity deaths_per_million_low deaths_per_million_high",
    "g20_cyclones": "duration_days max_wind_kt min_pressure_mb ace min_dist_to_land_km peak_lat peak_lon",
    "g21_cyclone_seasons": "ace_total ace_mean_per_system strongest_wind_kt lowest_pressure_mb mean_duration_days",
    "g22_cyclones_near_city": "min_distance_km wind_at_closest_kt pressure_at_closest_mb storm_max_wind_kt storm_ace",
    "g23_enso_cyclones": "ace_mean hurricanes_mean major_hurricanes_mean systems_mean r_oni_vs_ace",
    "g24_world_population": "uncertainty_ratio",
    "g25_year_panel": "temp_anomaly_mean pct_extreme_heat_days cyclone_ace_global ace_atlantic ace_east_pacific ace_west_pacific oni_aso oni_year_mean max_magnitude",
    "g26_month_panel": "oni temp_anomaly_mean pct_extreme_heat_days cyclone_ace max_wind_kt max_magnitude cyclone_ace_deseason cyclones_formed_deseason hurricanes_active_deseason bird_records_deseason",
    "g27_panel_coverage": "acf1 r_threshold_naive r_threshold_honest naive_underestimates_by",
    "g28_model_skill": "value_model value_baseline improvement_pct improvement_median improvement_min improvement_max",
    "q2_locations": "lat lon",
    "q3_weather_daily": "temp_mean temp_min temp_max temp_range apparent_max precip_sum pressure_msl_mean humidity_mean wind_gust_max",
    "q4_weather_anomaly": "temp_mean clim_mean anomaly_c z_score temp_max clim_max_p95 clim_max_record",
    "q5_climatology": "temp_mean_avg temp_mean_sd temp_mean_p05 temp_mean_p95 temp_max_avg temp_max_p95 temp_max_record temp_min_avg temp_min_p05 temp_min_record precip_avg",
    "q6_quakes": "magnitude depth_km lat lon",
    "q6_quakes_near": "magnitude depth_km distance_km lat lon",
    "q7_gutenberg_richter_bins": "mag_bin log10_n_cumulative",
    "q7_gutenberg_richter_b": "mag_mean mag_max b_value b_std_error a_value",
    "q8_omori_decay": "aftershocks_mean",
    "q8_omori_largest": "mainshock_mag",
    "q9_seismic_weather_myth": "pct_days_with_quake r_pressure r_temperature r_significance_threshold pct_variance_explained",
    "q10_warming": "anomaly_mean_c pct_extreme_heat_days",
    "q11_birds_summary": "lat lon abs_lat temp_mean",
    "q11_birds_correlations": "r_latitude pct_variance_latitude r_effort pct_variance_effort",
    "q12_birds": "temp_mean temp_max precip_sum temp_anomaly_c",
    "q13_disasters": "latitude longitude damage_musd eq_magnitude eq_intensity tsunami_wave_m",
    "q14_disaster_cascades": "eq_magnitude tsunami_wave_m pct_from_cascade",
    "q15_disasters_by_century": "pct_with_exact_deaths",
    "q16_epidemics": "deaths_mid deaths_uncertainty_ratio",
    "q17_deadliest": "deaths_representative deaths_uncertainty_ratio",
    "q18_cyclones": "duration_days max_wind_kt min_pressure_mb ace peak_lat peak_lon",
    "q19_cyclone_seasons": "ace_total strongest_wind_kt lowest_pressure_mb mean_duration_days",
    "q19_cyclone_trend": "r_ace r_major_hurricanes significance_threshold",
    "q20_cyclones_near": "min_distance_km wind_at_closest_kt pressure_at_closest_mb storm_max_wind_kt storm_ace",
    "q21_world_population": "uncertainty_ratio",
    "q22_per_capita": "deaths_representative deaths_per_million pct_of_humanity deaths_per_million_low deaths_per_million_high",
    "q23_enso_basins": "ace_mean hurricanes_mean major_hurricanes_mean systems_mean r_oni_vs_ace",
    "q23_enso_recent": "anomaly_c",
    "q24_heatwave_model": "p_extreme base_rate lift",
    "q24_heatwave_backtest": "observed_rate brier_model brier_base brier_skill_score pct_improvement",
    "q26_model_skill": "improvement_median improvement_min improvement_max",
    "q26_model_skill_by_cut": "value_model value_baseline improvement_pct",
    "q27_aftershocks": "mainshock_mag lat lon depth_km predicted_days_2_8 predicted_low predicted_high",
    "q27_aftershocks_withheld": "mainshock_mag lat lon depth_km predicted_days_2_8 predicted_low predicted_high",
    "q27_aftershocks_gate": "improvement_median improvement_min improvement_max",
    "q28_panel_coverage": "acf1 r_threshold_naive r_threshold_honest naive_underestimates_by",
    "q29_year_panel": "temp_anomaly_mean pct_extreme_heat_days cyclone_ace_global ace_atlantic ace_east_pacific ace_west_pacific oni_aso oni_year_mean max_magnitude",
    "q30_month_panel": "oni temp_anomaly_mean pct_extreme_heat_days cyclone_ace max_wind_kt max_magnitude cyclone_ace_deseason cyclones_formed_deseason hurricanes_active_deseason bird_records_deseason",
    "q33_heat_thresholds": "abs_lat threshold_2006_2018 threshold_2019_2025 threshold_drift_c pct_exceeded_now pct_expected amplification days_per_year_expected days_per_year_now temp_variability_sd temp_max_record",
    "q33_heat_variability": "r",
    "c1_effort_line": "slope intercept",
    "c2_season_totals": "ace ace_mean",
    "c3_anchored_line": "mag_bin log10_n_cumulative log10_n_fitted",
    "c4_year_overlay": "temp_mean_avg temp_mean_p05 temp_mean_p95 temp_now",
    "src5_weather_pages": "lat lon temperature_2m precipitation pressure_msl",
    "src6_quake_pages": "magnitude lat lon depth_km",
    "src8_hazard_pages": "eq_magnitude",
    "src8_three_layouts": "latitude longitude eq_magnitude tsunami_max_water_height_m",
    "src9_track_csv": "lat lon usa_wind_kt",
    "src10_oni_lines": "sst_c anomaly_c",
    "snk1_append_and_read": "sst_c anomaly_c",
}

DATE_COLUMNS: dict[str, str] = {
    "j1_join_dimension": "local_date",
    "j2_derived_key": "local_date",
    "j3_left_zero": "local_date",
    "j4_left_preferred": "local_date",
    "w2_prefer_by": "local_date",
    "w3_lag": "local_date",
    "w4_moving_mean": "local_date",
    "u7_generators": "month_start",
    "f2_doy_distance": "local_date",
    "f6_local_time": "local_date",
    "f10_interval_arithmetic": "month_start",
    "s4_historical_disasters": "event_date",
    "g1_weather_daily": "local_date",
    "g3_temperature_anomaly": "local_date",
    "g3_anomaly_of_daily": "local_date",
    "g4_heatwave_features": "local_date",
    "g14_bird_daily": "obs_date",
    "g15_disasters_ranked": "event_date",
    "g16_disaster_cascades": "event_date",
    "g22_cyclones_near_city": "local_date",
    "g26_month_panel": "month_start",
    "q3_weather_daily": "local_date",
    "q4_weather_anomaly": "local_date",
    "q12_birds": "obs_date",
    "q20_cyclones_near": "local_date",
    "q30_month_panel": "month_start",
}
