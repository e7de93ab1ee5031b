"""Profiles, trends, detection, ordering, reshaping, query views and streams."""

from pyspark.sql import functions as F

from halocline.operators import detect, events, fields, forecast, grid, listing, profiles, regions, seasonal, series, thresholds
from halocline.plans import pipeline, views
from halocline.session import shared_dir
from halocline.sources import sinks, tables
from halocline.streaming import incremental, late, persistence

from . import frames
from .common import TABLES, query
from .relations import BASIN_COLUMNS, EVENT, basin_rows, yearly

ID = "dac profile_idx "


@query("V1_unique_pressures", ID + "pres temp~4 psal~4 level_idx", "SELECT * FROM t_ut")
def _(m):
    return profiles.unique_pressures(profiles.with_density(profiles.valid_levels(m("levels"))))


def measures(m):
    return profiles.profile_measures(profiles.valid_levels(m("levels")))


def measured(columns):
    return f"SELECT c.dac, c.profile_idx, {columns} FROM t_cnt c LEFT JOIN t_mld USING (dac, profile_idx) LEFT JOIN t_thermo USING (dac, profile_idx) LEFT JOIN t_n2 USING (dac, profile_idx) LEFT JOIN t_ohc USING (dac, profile_idx)"


@query("V2_mixed_layer_depth", ID + "mld~", measured("CASE WHEN mld BETWEEN 0 AND 2000 THEN mld END AS mld"))
def _(m):
    return measures(m)


@query("V3_thermocline", ID + "thermocline~", measured("thermocline"))
def _(m):
    return measures(m)


@query("V4_stratification", ID + "strat_index~9 mean_N2~12 max_N2~12", measured("strat_index, mean_N2, max_N2"))
def _(m):
    return measures(m)


@query("V5_heat_content", ID + "ohc~3", measured("ohc_700m / 1e6 AS ohc"))
def _(m):
    return measures(m).withColumn("ohc", F.col("ohc_700m") / 1e6)


@query("V6_surface_means", ID + "sst_argo~ sss_argo~ surf_density~", "SELECT * FROM t_cnt")
def _(m):
    return measures(m)


TABLES["t_argo6"] = "SELECT *, ohc_700m / 1e6 AS ohc FROM t_argo"


@query("V7_profile_physics", ID + "lat~2 lon~2 time$ n_valid_levels# sst_argo~ sss_argo~ surf_density~ mld~ thermocline~ strat_index~9 mean_N2~12 max_N2~12 ohc~3", "SELECT * FROM t_argo6")
def _(m):
    return frames.argo(m).withColumn("ohc", F.col("ohc_700m") / 1e6)


@query("V8_profile_confidence", ID + "C_sampling~ C_instrument~ C_physics~ C_bounds~ confidence~ sparse_flag", "SELECT * FROM t_unc")
def _(m):
    return frames.unc(m)


@query("V9_profile_at_position", ID + "level_idx pres temp~4 psal~4",
       "SELECT v.* FROM t_vl v JOIN (SELECT dac, profile_idx FROM t_profiles ORDER BY sqrt(pow(lat - 3.3E0, 2) + pow(lon - 71.2E0, 2)), dac, profile_idx LIMIT 1) h USING (dac, profile_idx)")
def _(m):
    return profiles.profile_at(m("levels"), m("profiles"), 3.3, 71.2)


TREND = "variable slope_per_year~3 r2~ n_months#"
TABLES["t_trends6"] = "SELECT variable, CASE WHEN variable = 'OHC_700m' THEN slope_per_year / 1e6 ELSE slope_per_year END AS slope_per_year, r2, n_months FROM t_trends"


def scaled_trends(m):
    big = F.col("variable") == "OHC_700m"
    return frames.trends(m).withColumn("slope_per_year", F.when(big, F.col("slope_per_year") / 1e6).otherwise(F.col("slope_per_year")))


@query("T1_linear_trend", "slope_per_year~ r2~ n_months# slope~ intercept~",
       "SELECT slope * 12 AS slope_per_year, r2, n AS n_months, slope, intercept FROM (SELECT regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, regr_r2(value, x) AS r2, count(*) AS n FROM t_ord WHERE variable = 'SST anomaly')")
def _(m):
    monthly = series.resample_month(detect.rapid_inputs(m("grid"), m("surface"))[0], ["sst_mean"])
    return series.linear_trend(monthly, "sst_mean", "month_end")


@query("T2_long_term_trends", TREND, "SELECT * FROM t_trends6")
def _(m):
    return scaled_trends(m)


@query("T3_basin_trends", "basin sst_trend_per_yr~4", "SELECT * FROM t_btrend")
def _(m):
    return regions.basin_trends(frames.unc(m))


TABLES["t_stlong"] = "SELECT 'mean_N2' AS variable, month_start, mean_N2 * 1e4 AS v FROM t_strat UNION ALL SELECT 'mean_strat', month_start, mean_strat FROM t_strat"
TABLES["t_stord"] = "SELECT *, row_number() OVER (PARTITION BY variable ORDER BY month_start) - 1 AS x FROM t_stlong WHERE v IS NOT NULL"


@query("T4_stratification_trends", "variable slope~9 r2~ direction n_months# mean~9",
       "SELECT variable, regr_slope(v, x) * 12 AS slope, regr_r2(v, x) AS r2, CASE WHEN regr_slope(v, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, count(*) AS n_months, avg(v) AS mean FROM t_stord GROUP BY 1 HAVING count(*) >= 4")
def _(m):
    t = seasonal.stratification_trends(frames.strat(m))
    unit = F.when(F.col("variable") == "mean_N2", 1e4).otherwise(1.0)
    return t.withColumns({"slope": F.col("slope_per_year") * unit, "mean": F.col("mean") * unit})


@query("T4_peak_month", "peak_month#", "SELECT month AS peak_month FROM (SELECT month(month_start) AS month, avg(mean_N2) AS v FROM t_strat GROUP BY 1) ORDER BY v DESC, month LIMIT 1")
def _(m):
    return seasonal.peak_month(frames.strat(m))


TABLES["t_msst"] = "SELECT month_end, sst_argo, row_number() OVER (ORDER BY month_end) - 1 AS x FROM t_mohc WHERE sst_argo IS NOT NULL"
TABLES["t_fit"] = """SELECT month_end, sst_argo, i + s * x AS fitted, stddev_pop(sst_argo - (i + s * x)) OVER () * 1.96 AS b FROM t_msst,
 (SELECT regr_slope(sst_argo, x) AS s, regr_intercept(sst_argo, x) AS i FROM t_msst)"""


@query("T5_fitted_band", "month_end$ sst_argo~ fitted~ lower~ upper~", "SELECT *, fitted - b AS lower, fitted + b AS upper FROM t_fit")
def _(m):
    monthly = series.resample_month(frames.argo(m).where("time is not null"), ["sst_argo"], "time")
    return series.fitted_line(monthly, "sst_argo", "month_end")


TABLES["t_yfit"] = "SELECT regr_slope(sst, x) AS slope, regr_intercept(sst, x) AS intercept, regr_r2(sst, x) AS r2, count(*) AS n FROM (SELECT sst, row_number() OVER (ORDER BY year) - 1 AS x FROM t_yearly WHERE sst IS NOT NULL)"


@query("T6_yearly_regression", "slope~ intercept~ r2~ n_months#", "SELECT slope, intercept, r2, n AS n_months FROM t_yfit")
def _(m):
    return series.linear_trend(yearly(m), "sst", "year", min_rows=2, steps_per_year=1, flat_r2=1.0)


@query("T7_heat_content_anomaly", "year# ohc~3 anomaly~3",
       """SELECT year, ohc, ohc - coalesce(i + s * x, ohc) AS anomaly FROM (SELECT year, ohc, row_number() OVER (ORDER BY year) - 1 AS x FROM t_yearly6 WHERE ohc IS NOT NULL),
 (SELECT regr_slope(ohc, x) AS s, regr_intercept(ohc, x) AS i FROM (SELECT ohc, row_number() OVER (ORDER BY year) - 1 AS x FROM t_yearly6 WHERE ohc IS NOT NULL))""")
def _(m):
    return views.heat_content_anomaly(yearly(m).withColumn("ohc", F.col("ohc") / 1e6))


@query("T8_trend_confidence", "variable trend_confidence~", "SELECT variable, greatest(0, least(1, r2)) AS trend_confidence FROM t_trends")
def _(m):
    return series.trend_confidence(frames.trends(m))


@query("D1_heatwave_days", "date$ frac_mhw~ mean_intensity~ max_intensity~ mhw_category# enso~ dmi~ pdo~ enso_phase iod_phase pdo_phase is_mhw", "SELECT * FROM t_days")
def _(m):
    return frames.days(m)


TABLES["t_season"] = """SELECT t.lat, t.lon, t.doy, quantile_cont(p.sst, 0.9) AS threshold
 FROM (SELECT DISTINCT lat, lon, dayofyear(time) AS doy FROM t_grid WHERE sst IS NOT NULL) t JOIN t_grid p ON p.lat = t.lat AND p.lon = t.lon
 AND least(abs(dayofyear(p.time) - t.doy), 366 - abs(dayofyear(p.time) - t.doy)) <= 5 GROUP BY 1, 2, 3"""
TABLES["t_sint"] = "SELECT g.*, g.sst - h.threshold AS intensity FROM t_grid g LEFT JOIN t_season h ON g.lat = h.lat AND g.lon = h.lon AND dayofyear(g.time) = h.doy"


@query("A2_seasonal_threshold", "lat lon doy# threshold~", "SELECT * FROM t_season")
def _(m):
    return thresholds.seasonal_threshold(m("grid"), "sst")


@query("D1_seasonal_heatwave_days", "date$ frac_mhw~ mean_intensity~ max_intensity~ is_mhw",
       """SELECT *, sum(CASE WHEN frac_mhw > 0.05 THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS is_mhw FROM (
 SELECT CAST(time AS DATE) AS date, count(*) FILTER (WHERE intensity > 0) * 1.0E0 / count(intensity) AS frac_mhw,
 coalesce(avg(intensity) FILTER (WHERE intensity > 0), 0.0E0) AS mean_intensity, max(intensity) AS max_intensity FROM t_sint GROUP BY 1 HAVING count(intensity) > 0)""")
def _(m):
    return detect.heatwave_days(m("grid"), m("indices"), half_window=5)


@query("A2_merged_sketches", "lat lon n_values# near", "SELECT lat, lon, count(sst) AS n_values, TRUE AS near FROM t_grid WHERE sst IS NOT NULL GROUP BY 1, 2")
def _(m):
    """Sketches of two portions of years, appended one after the other; ranks of the merged thresholds in the record."""
    path = shared_dir(m.spark, "sketches")
    early = F.year("time") < 1998
    for version, part in enumerate((early, ~early)):
        thresholds.append_sketches(thresholds.yearly_sketches(m("grid").where(part), "sst"), path, version)
    limits = m.spark.read.parquet(thresholds.renew_thresholds(m.spark, path, shared_dir(m.spark, "renewed")))
    x, limit = F.col("sst"), F.col("threshold")
    ranks = m("grid").where("sst is not null").join(limits, ["lat", "lon"]).groupBy("lat", "lon").agg(
        F.count(x).alias("n_values"), (F.count_if(x < limit) / F.count(x)).alias("below"), (F.count_if(x <= limit) / F.count(x)).alias("upto")
    )
    error = thresholds.RANK_ERROR
    return ranks.withColumn("near", (F.col("below") <= 0.9 + error) & (F.col("upto") >= 0.9 - error))


@query("D2_unusual_mixed_layers", ID + "month# lat_bin lon_bin mld~ mld_clim~ mld_std~ mld_anom~ mld_zscore~ mld_unusual_deep mld_unusual_shallow mld_unusual enso~ dmi~", "SELECT * FROM t_unusual")
def _(m):
    return detect.unusual_mixed_layers(frames.argo(m), m("indices"))


@query("D3_rapid_changes", "date$ sst_mean~ sst_change7d~ qnet_mean~ qnet_change7d~ ws_mean~ ws_change7d~ rapid_sst_rise rapid_sst_drop rapid_qnet_swing rapid_wind enso~ dmi~ pdo~ enso_phase iod_phase", "SELECT * FROM t_rapid")
def _(m):
    return frames.rapid(m)


@query("D4_heatwave_confidence", "date$ mhw_signal_noise~ mhw_persistence~ mhw_confidence~", "SELECT * FROM t_mhw")
def _(m):
    return frames.mhw(m)


@query("D4_rapid_confidence", "date$ rapid_confidence~", "SELECT date, CASE WHEN rapid_sst_rise OR rapid_sst_drop THEN abs(sst_change7d) / (abs(sst_change7d) + 0.31E0) END AS rapid_confidence FROM t_rapid")
def _(m):
    return detect.rapid_confidence(frames.rapid(m))


@query("D5_forecast", "probability~3 risk_level enso iod pdo phase_frequency~3 trend_factor~4 onset_factor~4 n_historical_days# as_of_date", "SELECT * FROM t_forecast")
def _(m):
    f = forecast.forecast_indicator(frames.mhw(m), frames.rapid(m))
    return f.select("*", "current_phase.*")


@query("D5_forecast_text", "summary",
       """SELECT printf('risk=%s p=%.2f; phases %s/%s: %.0f%% of %d days; trend %+.4f per day; onset factor %.4f',
 risk_level, probability, enso, iod, frequency * 100, n_days, mean_change, onset) AS summary FROM t_forecast""")
def _(m):
    return forecast.forecast_indicator(frames.mhw(m), frames.rapid(m))


@query("D6_heatwave_events", EVENT, "SELECT * FROM t_ev")
def _(m):
    return frames.event_table(m)


@query("D7_basin_heatwaves", "basin mhw_days# peak_mhw_intensity~3", "SELECT * FROM t_bheat")
def _(m):
    return regions.basin_heatwaves_of(m("grid"))


@query("D8_sst_dataset", "time$ lat lon sst~4 sst_clim~ sst_anomaly~", "SELECT * FROM t_sst")
def _(m):
    return frames.sst(m)


@query("D8_qnet_dataset", "time$ lat lon qnet~4 qnet_clim~ qnet_anom~", "SELECT * FROM t_qnet")
def _(m):
    return fields.qnet_dataset(m("surface"))


#: Of each product: its rows as a table, the number of them, and the column whose values are summed.
PRODUCTS = {
    "mhw_timeseries": ("t_mhw", "frac_mhw"), "mhw_timeseries_by_year": ("t_mhw", "frac_mhw"),
    "rapid_changes": ("t_rapid", "sst_mean"), "rapid_changes_by_year": ("t_rapid", "ws_mean"),
    "unusual_mld": ("t_unusual", "mld"), "unusual_mld_by_year": ("t_unusual", "mld"),
    "wind_stress": ("t_ekman", "tau_mag"), "wind_stress_by_day": ("t_ekman", "ekman_x"),
    "qnet": ("t_qnet", "qnet"), "qnet_by_day": ("t_qnet", "qnet_clim"),
    "sst_anomaly": ("t_sst", "sst"), "sst_anomaly_by_day": ("t_sst", "sst_clim"),
    "profile_physics": ("t_argo", "mld"), "profile_uncertainty": ("t_unc", "confidence"), "profiles_with_seasonal_anom": ("t_unc", "thermocline"),
    "trends": ("(SELECT greatest(0, least(1, r2)) AS trend_confidence FROM t_trends)", "trend_confidence"),
    "mhw_events": ("t_ev", "duration_days"), "seasonal_climatology": ("t_clim", "mean"), "stratification_trend": ("t_strat", "n_profiles"),
    "sst_coverage": ("(SELECT count(sst) / 20.0E0 AS sst_coverage FROM t_grid GROUP BY time)", "sst_coverage"),
    "sparsity_scores": ("(SELECT count(*) AS n_profiles FROM t_argo GROUP BY floor(lat / 2), floor(lon / 2), date_trunc('month', time))", "n_profiles"),
    "layout_report": ("(SELECT unnest([a, a, a, a, b, b]) AS n_rows FROM (SELECT (SELECT count(*) FROM t_surface) AS a, (SELECT count(*) FROM t_grid) AS b))", "n_rows"),
}
TABLES["t_counts"] = " UNION ALL ".join(
    [f"SELECT '{n}' AS product, count(*) AS n_rows, CAST(sum({c}) AS DOUBLE) AS total FROM {t} AS p" for n, (t, c) in PRODUCTS.items()]
    + [f"SELECT '{n}', {k}, NULL" for n, k in (("grid_uncertainty", 4), ("basin_metrics", 6), ("mhw_forecast", 1), ("range_checks", 11), ("uncertainty_summary", 12))]
)


@query("D9_run_all", "product n_rows# total~3", "SELECT * FROM t_counts")
def _(m):
    products = pipeline.run_all(
        shared_dir(m.spark, "products"), m("grid"), m("surface"), m("sla"), m("levels"), m("profiles"), m("indices")
    )
    return pipeline.product_counts(products, {n: column for n, (_, column) in PRODUCTS.items()})


LISTED = "profile_id float_id time$ latitude~4 longitude~4 basin sst_argo~4 mld~4 confidence~4 sparse_flag"


@query("O1_ordered_profiles", "position# profile_id", "SELECT row_number() OVER (ORDER BY round(confidence, 9) DESC NULLS LAST, profile_id) AS position, profile_id FROM t_norm ")
def _(m):
    p = listing.normalise_profiles(frames.unc(m)).withColumn("confidence", F.round("confidence", 9))
    ordered = listing.order_profiles(p, "confidence_desc").select("profile_id")
    return frames.placed(ordered)


@query("O2_page", LISTED, "SELECT * FROM t_norm ORDER BY time DESC, profile_id LIMIT 50 OFFSET 100")
def _(m):
    return views.profile_list(frames.unc(m), 3, 50)


@query("O2_page_after", "profile_id time$",
       "SELECT * FROM t_norm WHERE time < TIMESTAMP '2001-09-01' OR (time = TIMESTAMP '2001-09-01' AND profile_id > 'b') ORDER BY time DESC, profile_id LIMIT 50")
def _(m):
    return listing.page_after(listing.normalise_profiles(frames.unc(m)), "2001-09-01", "b", 50)


@query("O3_ordered_events", "position# " + EVENT, "SELECT *, row_number() OVER (ORDER BY peak_intensity DESC NULLS LAST, start_date DESC) AS position FROM t_ev")
def _(m):
    return frames.placed(events.order_events(frames.event_table(m), "intensity"))


@query("O4_basin_ranking", "position# " + BASIN_COLUMNS, "SELECT *, row_number() OVER (ORDER BY sst_trend_per_yr DESC NULLS LAST, basin) AS position FROM t_basin")
def _(m):
    return frames.placed(regions.rank_basins(basin_rows(m)))


TABLES["t_wide"] = """SELECT month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][month] AS month_name, coalesce(max(mean) FILTER (WHERE variable = 'sst_argo'), 0) AS sst_mean, coalesce(max(std) FILTER (WHERE variable = 'sst_argo'), 0) AS sst_std,
 coalesce(max(mean) FILTER (WHERE variable = 'mld'), 0) AS mld_mean, coalesce(max(mean) FILTER (WHERE variable = 'ohc_700m'), 0) / 1e6 AS ohc_mean FROM t_clim GROUP BY month"""
WIDE = "month# month_name sst_mean~3 sst_std~3 mld_mean~3 ohc_mean~3"


@query("R1_seasonal_wide", WIDE, "SELECT * FROM t_wide")
def _(m):
    return seasonal.seasonal_wide(seasonal.seasonal_climatology(frames.unc(m))).withColumn("ohc_mean", F.col("ohc_mean") / 1e6)


TABLES["t_direct"] = """SELECT k AS month, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][k] AS month_name, coalesce(round(avg(sst_argo), 5), 0) AS sst_mean,
 coalesce(round(stddev_samp(sst_argo), 5), 0) AS sst_std, coalesce(round(avg(mld), 5), 0) AS mld_mean, coalesce(avg(ohc_700m) / 1e6, 0) AS ohc_mean
 FROM range(1, 13) AS r(k) LEFT JOIN t_argo ON month(time) = k GROUP BY 1, 2"""


@query("R2_seasonal_direct", "month# month_name sst_mean~4 sst_std~4 mld_mean~4 ohc_mean~3", "SELECT * FROM t_direct")
def _(m):
    return seasonal.seasonal_direct(frames.argo(m), m.spark).withColumn("ohc_mean", F.col("ohc_mean") / 1e6)


TABLES["t_gridcells"] = "SELECT a.lat, b.lon, p.sst_anomaly FROM (SELECT DISTINCT latitude AS lat FROM t_points) a CROSS JOIN (SELECT DISTINCT longitude AS lon FROM t_points) b LEFT JOIN t_points p ON p.latitude = a.lat AND p.longitude = b.lon"


def cells_of(rows):
    return rows.select("lat", F.explode(F.arrays_zip("lon_values", "row_values")).alias("c")).select("lat", F.col("c.lon_values").alias("lon"), F.col("c.row_values").alias("sst_anomaly"))


@query("R3_grid_rows", "lat lon sst_anomaly~3", "SELECT * FROM t_gridcells")
def _(m):
    return cells_of(grid.grid_rows(grid.heatmap_points(frames.sst(m), stride=1)))


@query("R4_transpose", "variable statistic value~3",
       " UNION ALL ".join(f"SELECT variable, '{s}' AS statistic, {s}::DOUBLE AS value FROM t_trends6" for s in ("slope_per_year", "r2", "n_months")))
def _(m):
    t = scaled_trends(m).withColumn("n_months", F.col("n_months").cast("double"))
    return t.unpivot("variable", ["slope_per_year", "r2", "n_months"], "statistic", "value")


SUMMARY = "is_active category# category_label mean_intensity~4 coverage_pct~4 date$ confidence~4 enso~4 enso_phase dmi~4 iod_phase pdo~4 pdo_phase n_profiles# mean_sst~4 median_mld~4 mean_ohc~3 mean_confidence~4 sst_slope~4 mld_slope~4 sst_rises_30d# sst_drops_30d#"


@query("Q1_dashboard_summary", SUMMARY,
       """SELECT d.is_mhw AS is_active, mhw_category AS category, CASE mhw_category WHEN 0 THEN 'None' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Strong' WHEN 3 THEN 'Severe' ELSE 'Extreme' END AS category_label, d.mean_intensity, frac_mhw * 100 AS coverage_pct, d.date, mhw_confidence AS confidence,
 x.enso, CASE WHEN x.enso >= 0.5 THEN 'El Nino' WHEN x.enso <= -0.5 THEN 'La Nina' ELSE 'Neutral' END AS enso_phase, x.dmi, CASE WHEN x.dmi >= 0.4 THEN 'Positive IOD' WHEN x.dmi <= -0.4 THEN 'Negative IOD' ELSE 'Neutral IOD' END AS iod_phase,
 x.pdo, CASE WHEN x.pdo >= 0.5 THEN 'Positive PDO' WHEN x.pdo <= -0.5 THEN 'Negative PDO' ELSE 'Neutral PDO' END AS pdo_phase, r.*, (SELECT avg(confidence) FROM t_unc) AS mean_confidence,
 (SELECT slope_per_year FROM t_trends WHERE variable = 'SST anomaly') AS sst_slope, (SELECT slope_per_year FROM t_trends WHERE variable = 'MLD') AS mld_slope, q.*
 FROM (SELECT * FROM t_mhw ORDER BY date DESC LIMIT 1) d, (SELECT * FROM t_idx ORDER BY date DESC LIMIT 1) x,
 (SELECT count(*) AS n_profiles, avg(sst_argo) AS mean_sst, median(mld) AS median_mld, avg(ohc_700m) / 1e6 AS mean_ohc FROM t_recent) r,
 (SELECT count(*) FILTER (WHERE rapid_sst_rise) AS sst_rises_30d, count(*) FILTER (WHERE rapid_sst_drop) AS sst_drops_30d FROM t_rapid WHERE date >= (SELECT max(date) FROM t_rapid) - 30) q""")
def _(m):
    days, p, trend, rapid = frames.results(m)
    row = views.dashboard_summary(days, m("grid"), m("indices"), p, trend, rapid)
    return row.select("mhw.*", "climate_indices.*", "argo.*", "trends.*", "rapid_changes.*").withColumn("mean_ohc", F.col("mean_ohc") / 1e6)


@query("Q2_profile_list", LISTED, "SELECT * FROM t_norm WHERE basin = 'Southern Indian Ocean' AND time >= TIMESTAMP '2001-06-01' ORDER BY round(sst_argo, 9) DESC NULLS LAST, profile_id LIMIT 100")
def _(m):
    p = frames.unc(m).withColumn("sst_argo", F.round("sst_argo", 9))
    return views.profile_list(p, 1, 100, "sst_desc", basin="Southern Indian Ocean", date_from="2001-06-01")


@query("Q2_profile_total", "total#", "SELECT count(*) AS total FROM t_norm WHERE basin = 'Southern Indian Ocean' AND time >= TIMESTAMP '2001-06-01'")
def _(m):
    return views.profile_total(frames.unc(m), basin="Southern Indian Ocean", date_from="2001-06-01")


@query("Q3_profile_detail", LISTED, "SELECT * FROM t_norm WHERE profile_id = (SELECT max(profile_id) FROM t_norm)")
def _(m):
    p = frames.unc(m)
    wanted = listing.normalise_profiles(p).agg(F.max("profile_id")).first()[0]
    return views.profile_detail(p, wanted)


@query("Q4_profile_upload", "basin n#",
       """SELECT basin, count(*) AS n FROM (SELECT basin FROM t_norm0 UNION ALL SELECT basin FROM t_norm0 WHERE profile_idx % 7 <> 0) GROUP BY basin""")
def _(m):
    from .sources import upload_folder

    existing = m("profiles").withColumn("time", F.col("time").cast("timestamp"))
    stored = sinks.append_upload(existing, tables.read_upload(m.spark, upload_folder(m)))
    return listing.normalise_profiles(stored.drop("sst_argo")).groupBy("basin").agg(F.count(F.lit(1)).alias("n"))


@query("Q5_sst_heatmap", "latitude longitude sst~3 sst_anomaly~3",
       """SELECT lat AS latitude, lon AS longitude, sst, coalesce(sst_anomaly, sst - 28) AS sst_anomaly FROM t_sst WHERE sst IS NOT NULL AND time = (SELECT time FROM t_grid ORDER BY abs(date_diff('day', DATE '1998-05-05', time)), time LIMIT 1)
 AND lat IN (-30, -10) AND lon IN (40, 70, 100)""")
def _(m):
    return views.sst_heatmap(m("grid"), "1998-05-05", 2)


@query("Q6_anomaly_grid", "lat lon sst_anomaly~3", "SELECT * FROM t_gridcells")
def _(m):
    return cells_of(grid.grid_rows(views.sst_heatmap(m("grid"))))


@query("Q7_heatwave_events", EVENT, "SELECT * FROM t_ev WHERE duration_days >= 5")
def _(m):
    e = views.heatwave_event_list(frames.event_table(m), 5, None, "duration")
    # The view rounds to 4 places; each value is replaced by the full one where it is that value rounded.
    rounded = ("peak_intensity", "mean_intensity", "peak_coverage", "accumulated_heat", "mean_confidence")
    full = frames.event_table(m).select("event_id", *[F.col(c).alias(f"_{c}") for c in rounded])
    out = e.join(full, "event_id")
    return out.withColumns({c: F.when(F.abs(F.col(c) - F.col(f"_{c}")) <= 5.1e-5, F.col(f"_{c}")) for c in rounded})


@query("Q8_heatwave_series", "date$ is_mhw intensity~3 category",
       "SELECT date, is_mhw, mean_intensity AS intensity, CASE WHEN NOT is_mhw THEN 'Normal' WHEN mean_intensity >= 3 THEN 'Severe' WHEN mean_intensity >= 2 THEN 'Moderate' ELSE 'Mild MHW' END AS category FROM (SELECT * FROM t_days ORDER BY date DESC LIMIT 365)")
def _(m):
    return views.heatwave_series(frames.days(m).withColumn("mean_intensity", F.col("mean_intensity") + F.lit(2.37e-7)))


@query("Q9_trends", "variable r2~4 trend_confidence~3 direction", "SELECT CASE variable WHEN 'SST anomaly' THEN 'sst' WHEN 'OHC_700m' THEN 'ohc_700m' WHEN 'MLD' THEN 'mld' ELSE 'qnet' END AS variable, round(r2, 5) AS r2, round(greatest(0, least(1, round(r2, 5))), 4) AS trend_confidence, CASE WHEN slope_per_year * 10 > 0.001 THEN 'rising' WHEN slope_per_year * 10 < -0.001 THEN 'falling' ELSE 'stable' END AS direction FROM t_trends")
def _(m):
    return views.trend_rows(frames.trends(m))


@query("Q9_yearly", "year# sst~ sst_anomaly~ ohc~3 mld~ mhw_days#", "SELECT * FROM t_yearly6")
def _(m):
    return yearly(m).withColumn("ohc", F.col("ohc") / 1e6)


@query("Q9_seasonal", WIDE, "SELECT * FROM t_wide")
def _(m):
    return seasonal.seasonal_wide(seasonal.seasonal_climatology(frames.unc(m))).withColumn("ohc_mean", F.col("ohc_mean") / 1e6)


@query("Q9_stratification", "year# n2_mean~9 strat_mean~9", "SELECT year(month_start) AS year, avg(mean_N2) AS n2_mean, avg(mean_strat) AS strat_mean FROM t_strat GROUP BY 1")
def _(m):
    return views.yearly_stratification(frames.strat(m))


STEPS = "SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM t_grid)"


@query("Q10_anomaly_frames", "time$ lat lon sst_anomaly~", f"SELECT g.* FROM t_sst g JOIN ({STEPS}) s ON g.time = s.time WHERE i % greatest(1, CAST(ceil(n / 24.0E0) AS BIGINT)) = 0 AND lat IN (-30, -10) AND lon IN (40, 70, 100)")
def _(m):
    return views.anomaly_frames(m("grid"), 24, 2)


@query("Q11_heatwave_calendar", "date$ year# month# day# week# weekday# doy# plot_cat#",
       "SELECT date, year(date) AS year, month(date) AS month, day(date) AS day, weekofyear(date) AS week, isodow(date) - 1 AS weekday, dayofyear(date) AS doy, CASE WHEN is_mhw THEN mhw_category ELSE 0 END AS plot_cat FROM t_days")
def _(m):
    return views.calendar_cells(frames.days(m))


@query("Q12_scatter_points", ID + "lat~2 lon~2 mld~", "SELECT * FROM t_unc WHERE lat IS NOT NULL AND lon IS NOT NULL AND mld IS NOT NULL ORDER BY md5(dac || '|' || profile_idx), dac, profile_idx LIMIT 500")
def _(m):
    return views.scatter_points(frames.unc(m), "mld", 500)


@query("Q13_stress_vectors", "time$ lat lon tau_mag~ ux~ uy~",
       "SELECT time, lat, lon, tau_mag, tau_x / tau_mag * 1.5E0 AS ux, tau_y / tau_mag * 1.5E0 AS uy FROM t_stress WHERE time = (SELECT max(time) FROM t_stress) AND lat IN (-30, -10) AND lon IN (40, 70, 100)")
def _(m):
    return fields.stress_vectors(frames.stress(m), -1, 2)


@query("Q14_basin_scatter", "basin profile_id sst_argo~4 mld~4", "SELECT basin, profile_id, sst_argo, mld FROM t_norm WHERE sst_argo IS NOT NULL AND mld IS NOT NULL")
def _(m):
    p = frames.unc(m).withColumns({"sst_argo": F.col("sst_argo") + F.lit(2.37e-8), "mld": F.col("mld") + F.lit(2.37e-8)})
    return views.basin_scatter(p)


@query("X3_context_lines", "section item value~4 label",
       """WITH s AS (SELECT * FROM t_mhw ORDER BY date DESC LIMIT 1), x AS (SELECT * FROM t_idx ORDER BY date DESC LIMIT 1)
 SELECT 'heatwave' AS section, 'active' AS item, is_mhw::INT::DOUBLE AS value, strftime(date, '%Y-%m-%d') AS label FROM s
 UNION ALL SELECT 'heatwave', 'category', mhw_category, CASE mhw_category WHEN 0 THEN 'none' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Strong' WHEN 3 THEN 'Severe' ELSE 'Extreme' END FROM s
 UNION ALL SELECT 'heatwave', 'area_percent', round(frac_mhw * 100, 4), NULL FROM s UNION ALL SELECT 'heatwave', 'intensity', round(mean_intensity, 4), NULL FROM s
 UNION ALL SELECT 'climate', 'enso', round(enso, 4), CASE WHEN enso >= 0.5 THEN 'El Nino' WHEN enso <= -0.5 THEN 'La Nina' ELSE 'Neutral' END FROM x
 UNION ALL SELECT 'climate', 'dmi', round(dmi, 4), CASE WHEN dmi >= 0.4 THEN 'Positive IOD' WHEN dmi <= -0.4 THEN 'Negative IOD' ELSE 'Neutral IOD' END FROM x
 UNION ALL SELECT 'climate', 'pdo', round(pdo, 4), CASE WHEN pdo >= 0.5 THEN 'Positive PDO' WHEN pdo <= -0.5 THEN 'Negative PDO' ELSE 'Neutral PDO' END FROM x
 UNION ALL SELECT 'trend_per_year', variable, slope_per_year / CASE variable WHEN 'OHC_700m' THEN 1e9 ELSE 1 END, NULL FROM t_trends UNION ALL SELECT 'trend_r2', variable, r2, NULL FROM t_trends
 UNION ALL SELECT 'profiles', 'number', count(*), NULL FROM t_recent UNION ALL SELECT 'profiles', 'mean_sst', avg(sst_argo), NULL FROM t_recent UNION ALL SELECT 'profiles', 'mean_mld', avg(mld), NULL FROM t_recent""")
def _(m):
    days, p, trend, _ = frames.results(m)
    scale = F.when((F.col("section") == "trend_per_year") & (F.col("item") == "OHC_700m"), 1e9).otherwise(1.0)
    return views.context_items(days, m("indices"), trend, p).withColumn("value", F.col("value") / scale)


def arrivals(m, run, chunks=4):
    """Events arrive in date order in a few portions; ``run`` processes the stream after each."""
    path = shared_dir(m.spark, "arriving")
    rows = m("observations").withColumn("date", F.to_date("time"))
    first, last = rows.agg(F.min("date"), F.max("date")).first()
    part = F.floor(F.datediff("date", F.lit(first)) * chunks / ((last - first).days + 1))
    for k in range(chunks):
        rows.where(part == k).write.mode("append").parquet(path)
        run(incremental.open_stream(m.spark, path))


@query("ST1_new_dates", "date$", "SELECT DISTINCT time AS date FROM t_grid WHERE time > DATE '2000-01-01'")
def _(m):
    return incremental.new_dates(m("grid"), F.lit("2000-01-01").cast("date"))


@query("ST2_exactly_once", "n_rows# n_first#", "SELECT count(*) AS n_rows, count(*) AS n_first FROM events")
def _(m):
    target, checkpoint = shared_dir(m.spark, "stream"), shared_dir(m.spark, "stream-checkpoint")
    seen = []

    def run(stream):
        seen.append(stream)
        incremental.process_available(stream, target, checkpoint)

    arrivals(m, run)
    first = m.spark.read.parquet(target).count()
    run(seen[-1])
    return m.spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(first).alias("n_first"))


@query("ST3_merge_stream", "date$ n# total~2", "SELECT CAST(ts AS DATE) AS date, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def _(m):
    target, checkpoint = shared_dir(m.spark, "merged"), shared_dir(m.spark, "merge-checkpoint")
    arrivals(m, lambda stream: incremental.merge_stream(stream, target, checkpoint, "date"))
    again = m("observations").withColumn("date", F.to_date("time")).where("date >= DATE '2024-01-20'")
    incremental.write_batch(again, 99, target, "date")
    return incremental.read_merged(m.spark, target).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("sst").alias("total"))


@query("ST4_append_profiles", "time$ lat~2 lon~2", "SELECT time, lat, lon FROM t_profiles WHERE profile_idx % 7 <> 0")
def _(m):
    from .sources import upload_folder

    target = shared_dir(m.spark, "appended")
    incremental.append_profiles(
        m.spark, upload_folder(m), target, shared_dir(m.spark, "append-checkpoint"),
        "time string, lat double, lon double, sst_argo double, mld double, ohc_700m double",
    )
    return m.spark.read.parquet(target)


@query("ST5_drop_late", "event_id", "SELECT event_id FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-15'")
def _(m):
    dated = m.raw("events").withColumn("date", F.to_date("ts"))
    return incremental.drop_late(dated, F.lit("2024-01-15").cast("date"), "date")


TABLES["t_obs"] = "SELECT CAST(o.time AS DATE) AS date, o.sst - h.th AS i FROM t_observations o JOIN (SELECT lat, lon, quantile_cont(sst, 0.9) AS th FROM t_observations GROUP BY 1, 2) h ON o.lat = h.lat AND o.lon = h.lon"
CLOSED = """SELECT date, count(*) FILTER (WHERE i > 0) * 1.0E0 / count(i) AS frac_mhw, coalesce(avg(i) FILTER (WHERE i > 0), 0) AS mean_intensity, max(i) AS max_intensity FROM t_obs
 WHERE date + 1 <= (SELECT max(time) FROM t_observations) - INTERVAL 1 DAY GROUP BY date"""
TABLES["t_closed"] = CLOSED


def closed_days(m):
    target, checkpoint = shared_dir(m.spark, "closed"), shared_dir(m.spark, "closed-checkpoint")
    limits = shared_dir(m.spark, "thresholds")
    exact = grid.observation_threshold(m("observations"), "sst")
    for version, table in ((1, exact.withColumn("threshold", F.col("threshold") + 1)), (2, exact)):
        sinks.write_result(table, f"{limits}/version={version}")
    frozen = thresholds.newest_thresholds(m.spark, limits)

    def run(stream):
        days = incremental.closed_days(stream.withColumn("time", tables.utc_instant("time")), frozen)
        incremental.process_available(days, target, checkpoint, state_partitions=4)

    arrivals(m, run)
    return target


@query("ST6_closed_days", "date$ frac_mhw~ mean_intensity~ max_intensity~", "SELECT * FROM t_closed")
def _(m):
    return m.spark.read.parquet(closed_days(m))


@query("ST7_running_persistence", "date$ is_mhw",
       "SELECT date, sum(CASE WHEN frac_mhw > 0.05 THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS is_mhw FROM t_closed")
def _(m):
    ordered = shared_dir(m.spark, "daily")
    daily = m.spark.read.parquet(closed_days(m)).select(F.lit("all").alias("series"), "date", "frac_mhw")
    daily.repartitionByRange(1, "date").sortWithinPartitions("date").write.parquet(ordered)
    target = shared_dir(m.spark, "running")
    stream = incremental.open_stream(m.spark, ordered)
    running = persistence.with_running_persistence(stream)
    incremental.process_available(running, target, shared_dir(m.spark, "running-checkpoint"), state_partitions=4)
    return m.spark.read.parquet(target)


@query("ST7_ordered_persistence", "series date$ is_mhw kind",
       """SELECT 'all' AS series, date, 'day' AS kind, sum(CASE WHEN frac_mhw > 0.05 THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS is_mhw
 FROM t_daily QUALIFY date <= max(date) OVER () - 9""")
def _(m):
    """Days of the grid in four portions, up to eight days out of order within and across them."""
    path, target = shared_dir(m.spark, "unordered"), shared_dir(m.spark, "in-order")
    checkpoint = shared_dir(m.spark, "in-order-checkpoint")
    daily = grid.daily_heatwave_metrics(grid.with_intensity(m("grid"), "sst")).select(F.lit("all").alias("series"), "date", "frac_mhw")
    daily = frames.stored(m, daily)
    first, last = daily.agg(F.min("date"), F.max("date")).first()
    number = F.datediff("date", F.lit(first))
    part = F.floor((number + F.pmod(number * 5, F.lit(9))) * 4 / ((last - first).days + 9))
    before = m.spark.conf.get(late.STORE_CONF)
    m.spark.conf.set(late.STORE_CONF, late.STORE)
    try:
        for k in range(4):
            daily.where(part == k).orderBy(F.xxhash64("date")).coalesce(1).write.mode("append").parquet(path)
            running = late.with_ordered_persistence(incremental.open_stream(m.spark, path), delay_days=9)
            incremental.process_available(running, target, checkpoint, state_partitions=4)
    finally:
        m.spark.conf.set(late.STORE_CONF, before)
    return m.spark.read.parquet(target)
