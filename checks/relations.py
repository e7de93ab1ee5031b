"""Joins, aggregations and series windows."""

from pyspark.sql import functions as F

from halocline.functions.labels import enso_phase
from halocline.operators import context, detect, events, grid, listing, nearest, profiles, quantiles, regions, sampling, scans, seasonal, series, tracks
from halocline.plans import views

from . import frames
from .common import TABLES, query
from .tables import ENSO, IOD, PDO

CELL = "time$ lat lon "
CLIMATE = "date$ enso~ dmi~ pdo~ enso_phase iod_phase pdo_phase"


@query("J1_climate_context", CLIMATE, f"SELECT *, {ENSO} AS enso_phase, {IOD} AS iod_phase, {PDO} AS pdo_phase FROM t_griddays LEFT JOIN t_idx USING (date)")
def _(m):
    return context.with_climate(m("grid").select(F.col("time").alias("date")).distinct(), m("indices"))


TABLES["t_griddays"] = "SELECT DISTINCT time AS date FROM t_grid"


@query("J2_profile_indices", "dac profile_idx enso~ dmi~", "SELECT dac, profile_idx, enso, dmi FROM t_profiles LEFT JOIN t_idx ON CAST(time AS DATE) = date")
def _(m):
    return context.profiles_with_climate(m("profiles"), m("indices"))


@query("J3_monthly_climate", "month_start$ n_profiles# enso~ dmi~ pdo~ enso_phase iod_phase pdo_phase", "SELECT * FROM t_strat")
def _(m):
    return frames.strat(m)


TABLES["t_cellmonth"] = """SELECT *, month(time) AS month, floor(lat / 2) * 2 AS lat_bin, floor(lon / 2) * 2 AS lon_bin FROM t_argo WHERE mld IS NOT NULL"""
TABLES["t_unusual"] = """SELECT *, coalesce(mld_zscore > 2, FALSE) AS mld_unusual_deep, coalesce(mld_zscore < -2, FALSE) AS mld_unusual_shallow, coalesce(abs(mld_zscore) > 2, FALSE) AS mld_unusual
 FROM (SELECT *, mld - mld_clim AS mld_anom, CASE WHEN mld_std <> 0 THEN (mld - mld_clim) / mld_std END AS mld_zscore FROM (SELECT *, avg(mld) OVER w AS mld_clim, stddev_samp(mld) OVER w AS mld_std
 FROM t_cellmonth WINDOW w AS (PARTITION BY lat_bin, lon_bin, month))) LEFT JOIN t_idx ON CAST(time AS DATE) = date"""


@query("J4_cell_month_join", "dac profile_idx mld~ mld_clim~ mld_anom~", "SELECT * FROM t_unusual")
def _(m):
    return detect.unusual_mixed_layers(frames.argo(m), m("indices"))


@query("J5_day_of_year_anomaly", CELL + "sst_anomaly~", "SELECT * FROM t_sst")
def _(m):
    return grid.with_anomaly(m("grid"), "sst", "sst_anomaly")


@query("J6_threshold_intensity", CELL + "intensity~", "SELECT * FROM t_int")
def _(m):
    return grid.intensity_against(m("grid"), grid.cell_threshold(m("grid"), "sst"), "sst")


@query("J7_basin_membership", "basin n_profiles#", "SELECT basin, count(profile_idx) AS n_profiles FROM t_boxes LEFT JOIN t_profiles ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY basin")
def _(m):
    counts = regions.in_basins(m("profiles")).groupBy("basin").agg(F.count(F.lit(1)).alias("n"))
    return regions.box_table(m.spark).join(counts, "basin", "left").select("basin", F.coalesce("n", F.lit(0)).alias("n_profiles"))


@query("J8_nearest_time", CELL + "sst~4", "SELECT * FROM t_grid WHERE time = (SELECT time FROM t_grid ORDER BY abs(date_diff('second', TIMESTAMP '1998-05-05 11:00:00', CAST(time AS TIMESTAMP))), time LIMIT 1)")
def _(m):
    return grid.at_time(m("grid"), "1998-05-05 11:00:00")


TABLES["t_stamped"] = "SELECT float_id, profile_idx, time + INTERVAL 1 HOUR * (profile_idx % 24) AS stamp FROM t_floats"
TABLES["t_around"] = """SELECT s.*, b.time AS before, b.enso AS enso_b, a.time AS after, a.enso AS enso_a FROM t_stamped s
 ASOF LEFT JOIN t_indices b ON s.stamp >= CAST(b.time AS TIMESTAMP) ASOF LEFT JOIN t_indices a ON s.stamp < CAST(a.time AS TIMESTAMP)"""


@query("J8_nearest_times", "float_id profile_idx stamp$ time$ enso~",
       """SELECT *, CASE WHEN later THEN after ELSE before END AS time, CASE WHEN later THEN enso_a ELSE enso_b END AS enso
 FROM (SELECT *, coalesce(before IS NULL OR epoch_us(CAST(after AS TIMESTAMP)) - epoch_us(stamp) < epoch_us(stamp) - epoch_us(CAST(before AS TIMESTAMP)), FALSE) AS later FROM t_around)""")
def _(m):
    stamp = F.expr("timestampadd(HOUR, CAST(profile_idx % 24 AS INT), time)").alias("stamp")
    targets = m("floats").select("float_id", "profile_idx", stamp).withColumn("time", F.col("stamp"))
    return nearest.nearest_in_time(targets, m("indices"), ["enso"]).select("float_id", "profile_idx", "stamp", "nearest.*")


@query("J9_cell_join_fallback", CELL + "value~", "SELECT g.time, g.lat, g.lon, coalesce(CASE WHEN a.lat > -20 THEN a.sst_anomaly END, g.sst - 28) AS value FROM t_grid g LEFT JOIN t_sst a USING (time, lat, lon)")
def _(m):
    anomaly = frames.sst(m).where("lat > -20")
    return grid.join_anomaly(m("grid"), anomaly).withColumn("value", F.coalesce("sst_anomaly", F.col("sst") - 28.0))


@query("J10_align_series", "date$ sst_mean~ qnet_mean~ ws_mean~", "SELECT * FROM t_rapid")
def _(m):
    sst, qnet, wind = detect.rapid_inputs(m("grid"), m("surface"))
    return series.align_on(sst, [qnet, wind])


TABLES["t_yearly6"] = "SELECT year, sst, sst_anomaly, ohc / 1e6 AS ohc, mld, mhw_days FROM t_yearly"


def yearly(m):
    return views.yearly_metrics(m("grid"), frames.argo(m), frames.days(m))


@query("J11_yearly_metrics", "year# sst~ sst_anomaly~ ohc~3 mld~ mhw_days#", "SELECT * FROM t_yearly6")
def _(m):
    return yearly(m).withColumn("ohc", F.col("ohc") / 1e6)


@query("J12_nearest_profile", "dac profile_idx distance~",
       "SELECT dac, profile_idx, sqrt(pow(lat - 3.3E0, 2) + pow(lon - 71.2E0, 2)) AS distance FROM t_profiles ORDER BY 3, 1, 2 LIMIT 1")
def _(m):
    return profiles.nearest_profile(m("profiles"), 3.3, 71.2)


@query("J13_nearest_cell", "dac profile_idx cell_lat cell_lon distance~",
       """SELECT dac, profile_idx, c.lat AS cell_lat, c.lon AS cell_lon, sqrt((p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon)) AS distance
 FROM t_profiles p, (SELECT DISTINCT lat, lon FROM t_grid) c WHERE sqrt((p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon)) < 6
 QUALIFY row_number() OVER (PARTITION BY dac, profile_idx ORDER BY distance, c.lat, c.lon) = 1""")
def _(m):
    return nearest.nearest_cell(m("profiles"), m("grid").select("lat", "lon"), ["dac", "profile_idx"], 6.0, spacing=10.0)


@query("J13_nearest_spot", "dac profile_idx cell_lat~ cell_lon~ distance~",
       """SELECT dac, profile_idx, c.lat AS cell_lat, c.lon AS cell_lon, sqrt(pow(p.lat - c.lat, 2) + pow(p.lon - c.lon, 2)) AS distance
 FROM t_profiles p, (SELECT DISTINCT lat, lon FROM t_floats) c WHERE sqrt(pow(p.lat - c.lat, 2) + pow(p.lon - c.lon, 2)) < 8
 QUALIFY row_number() OVER (PARTITION BY dac, profile_idx ORDER BY sqrt((p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon)), c.lat, c.lon) = 1""")
def _(m):
    return nearest.nearest_cell(m("profiles"), m("floats"), ["dac", "profile_idx"], 8.0)


TABLES["t_cal"] = """SELECT CAST(s.d AS DATE) AS date, coalesce(is_mhw, FALSE) AS is_mhw, coalesce(mean_intensity, 0) AS intensity
 FROM (SELECT unnest(generate_series((SELECT max(date) FROM t_days) - 734, (SELECT max(date) FROM t_days), INTERVAL 1 DAY)) AS d) s LEFT JOIN t_days ON date = CAST(s.d AS DATE)"""


@query("J14_filled_calendar", "date$ is_mhw intensity~", "SELECT * FROM t_cal")
def _(m):
    return views.calendar(frames.days(m))


TABLES["t_moves"] = """SELECT *, lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon FROM t_floats WINDOW w AS (PARTITION BY float_id ORDER BY time, profile_idx)"""


@query("J15_float_moves", "float_id profile_idx time$ lat~2 lon~2 prev_lat~2 prev_lon~2", "SELECT * FROM t_moves WHERE abs(lat - prev_lat) >= 0.001 OR abs(lon - prev_lon) >= 0.001")
def _(m):
    return tracks.moves(m("floats"))


@query("A1_day_of_year_climatology", "lat lon doy# clim~ n#", "SELECT lat, lon, dayofyear(time) AS doy, avg(sst) AS clim, count(sst) AS n FROM t_grid GROUP BY 1, 2, 3")
def _(m):
    return grid.day_of_year_climatology(m("grid"), "sst", "clim")


@query("A2_cell_threshold", "lat lon threshold~", "SELECT * FROM t_thresh")
def _(m):
    return grid.cell_threshold(m("grid"), "sst")


DAILY = "date$ frac_mhw~ mean_intensity~ max_intensity~ mhw_category#"


@query("A3_daily_heatwave_metrics", DAILY, "SELECT * FROM t_daily")
def _(m):
    return grid.daily_heatwave_metrics(grid.with_intensity(m("grid"), "sst"))


@query("A4_daily_metrics_all_days", DAILY,
       """SELECT a.date, frac_mhw, coalesce(mean_intensity, 0) AS mean_intensity, coalesce(max_intensity, 0) AS max_intensity, coalesce(mhw_category, 0) AS mhw_category FROM t_griddays a LEFT JOIN t_daily d ON a.date = d.date""")
def _(m):
    return grid.daily_heatwave_metrics(grid.intensity_against(m("grid"), grid.cell_threshold(m("grid"), "sst"), "sst"), keep_empty=True)


@query("A5_spatial_mean", "date$ sst~ sst_anomaly~", "SELECT time AS date, avg(sst) AS sst, avg(sst_anomaly) AS sst_anomaly FROM t_sst GROUP BY 1")
def _(m):
    return grid.spatial_mean(frames.sst(m), {"sst": "sst", "sst_anomaly": "sst_anomaly"})


@query("A5_area_weighted_mean", "date$ sst~", "SELECT time AS date, sum(sst * cos(radians(lat))) / sum(CASE WHEN sst IS NOT NULL THEN cos(radians(lat)) END) AS sst FROM t_grid GROUP BY 1")
def _(m):
    return grid.spatial_mean(m("grid"), {"sst": "sst"}, area_weighted=True)


@query("A6_monthly_mean", "month_end$ sst_mean~", "SELECT last_day(date) AS month_end, avg(sst_mean) AS sst_mean FROM t_asst GROUP BY 1")
def _(m):
    return series.resample_month(detect.rapid_inputs(m("grid"), m("surface"))[0], ["sst_mean"])


@query("A7_yearly_mean", "year# sst_mean~", "SELECT year(date) AS year, avg(sst_mean) AS sst_mean FROM t_asst GROUP BY 1")
def _(m):
    return series.resample_year(detect.rapid_inputs(m("grid"), m("surface"))[0], ["sst_mean"])


@query("A8_monthly_statistics", "month_start$ mean_N2~12 std_N2~12 mean_strat~9 std_strat~9 n_profiles#", "SELECT * FROM t_months")
def _(m):
    return series.monthly_statistics(frames.unc(m))


TABLES["t_clim6"] = "SELECT variable, month, CASE WHEN variable = 'ohc_700m' THEN mean / 1e6 ELSE mean END AS mean, CASE WHEN variable = 'ohc_700m' THEN std / 1e6 ELSE std END AS std, n FROM t_clim"


@query("A9_seasonal_climatology", "variable month# mean~3 std~3 n#", "SELECT * FROM t_clim6")
def _(m):
    big = F.col("variable") == "ohc_700m"
    c = seasonal.seasonal_climatology(frames.unc(m))
    return c.withColumns({k: F.when(big, F.col(k) / 1e6).otherwise(F.col(k)) for k in ("mean", "std")})


@query("A10_cell_month_climatology", "lat_bin lon_bin month# mld_clim~ mld_std~ n#",
       "SELECT lat_bin, lon_bin, month, avg(mld) AS mld_clim, stddev_samp(mld) AS mld_std, count(mld) AS n FROM t_cellmonth GROUP BY 1, 2, 3")
def _(m):
    return detect.mixed_layer_climatology(frames.argo(m))


@query("A11_sparsity_scores", "lat_bin lon_bin year_month$ n_profiles# sparsity_score~",
       "SELECT floor(lat / 2) * 2 AS lat_bin, floor(lon / 2) * 2 AS lon_bin, CAST(date_trunc('month', time) AS DATE) AS year_month, count(*) AS n_profiles, least(count(*) / 3.0E0, 1) AS sparsity_score FROM t_argo GROUP BY 1, 2, 3")
def _(m):
    return sampling.sparsity_scores(frames.argo(m), reference=3)


@query("A12_daily_coverage", "date$ sst_coverage~", "SELECT time AS date, count(sst) * 1.0E0 / (SELECT count(*) FROM (SELECT DISTINCT lat, lon FROM t_grid)) AS sst_coverage FROM t_grid GROUP BY 1")
def _(m):
    return grid.daily_coverage(m("grid"), "sst")


@query("A13_grid_uncertainty", "field instrument_uncertainty~3 mean_confidence~3 total_uncertainty_degC~3 min_confidence~3 qnet_mean_Wm2~2 qnet_std_Wm2~2 wind_mean_ms~2 sla_mean_m~4",
       """SELECT 'sst' AS field, 0.3E0 AS instrument_uncertainty, 1 - avg(f) AS mean_confidence, 0.316E0 AS total_uncertainty_degC, 1 - max(f) AS min_confidence, NULL::DOUBLE AS qnet_mean_Wm2, NULL::DOUBLE AS qnet_std_Wm2, NULL::DOUBLE AS wind_mean_ms, NULL::DOUBLE AS sla_mean_m
 FROM (SELECT 1 - count(sst) / 20.0E0 AS f FROM t_grid GROUP BY time)
 UNION ALL SELECT 'qnet', 15, greatest(0, 1 - 15 / greatest(stddev_pop(qnet), 1)), NULL, NULL, avg(qnet), stddev_pop(qnet), NULL, NULL FROM t_flux
 UNION ALL SELECT 'wind', 0.5, greatest(0, 1 - 0.5 / greatest(avg(wind_speed), 0.1)), NULL, NULL, NULL, NULL, avg(wind_speed), NULL FROM t_wind
 UNION ALL SELECT 'sla', 0.02, 0.95, NULL, NULL, NULL, NULL, NULL, avg(sla) FROM t_sla""")
def _(m):
    from halocline.operators import fields

    return grid.grid_uncertainty(m("grid"), fields.heat_flux(m("surface")), frames.stress(m), m("sla"))


TABLES["t_bmeans"] = """SELECT basin, count(*) AS n, avg(sst_argo) AS mean_sst, avg(mld) AS mean_mld, avg(ohc_700m) / 1e10 AS mean_ohc, avg(confidence) AS mean_confidence FROM t_inbox GROUP BY basin"""
TABLES["t_bseason"] = """SELECT basin, CASE WHEN count(v) >= 6 THEN max(v) - min(v) END AS sst_seasonal_range FROM (SELECT basin, month(time) AS mo, avg(sst_argo) AS v FROM t_inbox GROUP BY 1, 2) GROUP BY 1"""
TABLES["t_bmonth"] = """SELECT basin, v, row_number() OVER (PARTITION BY basin ORDER BY me) - 1 AS x FROM (SELECT basin, last_day(CAST(time AS DATE)) AS me, avg(sst_argo) AS v FROM t_inbox WHERE sst_argo IS NOT NULL GROUP BY 1, 2)"""
TABLES["t_btrend"] = "SELECT basin, CASE WHEN count(*) >= 4 THEN regr_slope(v, x) * 12 END AS sst_trend_per_yr FROM t_bmonth GROUP BY basin"
TABLES["t_athresh"] = "SELECT lat, lon, quantile_cont(sst_anomaly, 0.9) AS th FROM t_sst GROUP BY 1, 2"
TABLES["t_bcell"] = """SELECT b.basin, s.time, s.sst_anomaly - t.th AS i FROM t_boxes b JOIN t_sst s ON s.lat BETWEEN lat_min AND lat_max AND s.lon BETWEEN lon_min AND lon_max JOIN t_athresh t ON s.lat = t.lat AND s.lon = t.lon"""
TABLES["t_bday"] = "SELECT basin, time, count(*) FILTER (WHERE i > 0) * 1.0E0 / nullif(count(i), 0) AS f, max(i) AS mx FROM t_bcell GROUP BY 1, 2"
TABLES["t_bheat"] = """SELECT basin, count(*) FILTER (WHERE hot) AS mhw_days, max(mx) AS peak_mhw_intensity FROM (SELECT *, sum(CASE WHEN f > 0.05 THEN 1 ELSE 0 END) OVER (PARTITION BY basin ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS hot FROM t_bday) GROUP BY 1"""
TABLES["t_basin"] = """SELECT b.basin, CASE WHEN n > 0 THEN lat_min END AS lat_min, CASE WHEN n > 0 THEN lon_max END AS lon_max, coalesce(n, 0) AS n_profiles, mean_sst, mean_mld, mean_ohc, mean_confidence, sst_trend_per_yr, sst_seasonal_range,
 CASE WHEN n > 0 THEN coalesce(mhw_days, 0) END AS mhw_days, CASE WHEN n > 0 THEN peak_mhw_intensity END AS peak_mhw_intensity
 FROM t_boxes b LEFT JOIN t_bmeans USING (basin) LEFT JOIN t_bseason USING (basin) LEFT JOIN t_btrend USING (basin) LEFT JOIN t_bheat USING (basin)"""
BASIN_COLUMNS = "basin lat_min lon_max n_profiles# mean_sst~3 mean_mld~2 mean_ohc~3 mean_confidence~3 sst_trend_per_yr~4 sst_seasonal_range~3 mhw_days# peak_mhw_intensity~3"


def basin_rows(m):
    rows = regions.basin_metrics_of(m.spark, frames.unc(m), m("grid"))
    return rows.withColumn("mean_ohc", F.col("mean_ohc_700m") / 1e10)


@query("A14_basin_metrics", BASIN_COLUMNS, "SELECT * FROM t_basin")
def _(m):
    return basin_rows(m)


EVENT = "event_id# start_date$ end_date$ duration_days# peak_date$ peak_intensity~ mean_intensity~ peak_coverage~ accumulated_heat~4 peak_category# dominant_enso dominant_iod mean_confidence~3"


@query("A15_event_summary", EVENT, "SELECT * FROM t_ev")
def _(m):
    return frames.event_table(m)


@query("A16_mode", "year# phase", "SELECT year, enso_phase AS phase FROM (SELECT year(date) AS year, enso_phase, count(*) AS n FROM t_days GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY year ORDER BY n DESC, enso_phase) = 1")
def _(m):
    return frames.days(m).groupBy(F.year("date").alias("year")).agg(F.mode("enso_phase", True).alias("phase"))


@query("A17_argmax_row", "year# date$ max_intensity~", "SELECT year(date) AS year, date, max_intensity FROM t_days QUALIFY row_number() OVER (PARTITION BY year(date) ORDER BY round(max_intensity, 9) DESC, date) = 1")
def _(m):
    d = frames.days(m).withColumn("max_intensity", F.round("max_intensity", 9))
    first = F.struct("max_intensity", -F.unix_date("date"))
    return d.groupBy(F.year("date").alias("year")).agg(F.max_by("date", first).alias("date"), F.max("max_intensity").alias("max_intensity"))


TABLES["t_now"] = "SELECT enso_phase AS e, iod_phase AS i, pdo_phase AS p, date AS d FROM t_mhw ORDER BY date DESC LIMIT 1"
TABLES["t_freq"] = """SELECT coalesce(avg(is_mhw::INT) FILTER (WHERE enso_phase = e AND iod_phase = i), avg(is_mhw::INT) FILTER (WHERE enso_phase = e), 0.3) AS frequency,
 CASE WHEN count(*) FILTER (WHERE enso_phase = e AND iod_phase = i) > 0 THEN count(*) FILTER (WHERE enso_phase = e AND iod_phase = i) ELSE count(*) FILTER (WHERE enso_phase = e) END AS n_days FROM t_mhw, t_now"""
TABLES["t_chg"] = "SELECT avg(s) AS mean_change FROM (SELECT mean_intensity - lag(mean_intensity) OVER (ORDER BY date) AS s FROM (SELECT * FROM t_mhw ORDER BY date DESC LIMIT 30))"
TABLES["t_ons"] = "SELECT count(*) FILTER (WHERE rapid_sst_rise) AS n_rises FROM (SELECT * FROM t_rapid ORDER BY date DESC LIMIT 14)"
TABLES["t_forecast0"] = """SELECT e AS enso, i AS iod, p AS pdo, d, frequency, n_days, mean_change, greatest(-0.2E0, least(0.2E0, mean_change / 0.05E0)) AS trend, least(n_rises * 0.05E0, 0.15E0) AS onset FROM t_now, t_freq, t_chg, t_ons"""
TABLES["t_forecast1"] = "SELECT *, greatest(0, least(1, 0.5E0 * frequency + 0.3E0 * (0.5E0 + trend) + 0.2E0 * (0.5E0 + onset))) AS probability FROM t_forecast0"
TABLES["t_forecast"] = """SELECT *, CASE WHEN probability >= 0.7 THEN 'High' WHEN probability >= 0.5 THEN 'Elevated' WHEN probability >= 0.3 THEN 'Moderate' ELSE 'Low' END AS risk_level,
 n_days AS n_historical_days, strftime(d, '%Y-%m-%d') AS as_of_date, frequency AS phase_frequency, trend AS trend_factor, onset AS onset_factor FROM t_forecast1"""


@query("A18_phase_frequency", "frequency~ n_days#", "SELECT * FROM t_freq")
def _(m):
    from halocline.operators import forecast

    return forecast.phase_frequency(frames.mhw(m))


@query("A19_yearly_events", "year# count# avg_duration~1", "SELECT year(start_date) AS year, count(*) AS count, round(avg(duration_days), 1) AS avg_duration FROM t_ev WHERE duration_days >= 5 GROUP BY 1")
def _(m):
    return events.yearly_events(frames.event_table(m))


@query("A20_heatwave_days_per_year", "year# n#", "SELECT year(date) AS year, count(*) AS n FROM t_days WHERE is_mhw GROUP BY 1")
def _(m):
    return frames.days(m).where("is_mhw").groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("A21_yearly_profile_means", "year# ohc~3 mld~", "SELECT year(time) AS year, avg(ohc_700m) / 1e6 AS ohc, avg(mld) AS mld FROM t_argo GROUP BY 1")
def _(m):
    return series.resample_year(frames.argo(m).withColumn("ohc", F.col("ohc_700m") / 1e6), ["ohc", "mld"], "time")


@query("A21_yearly_stratification", "year# n2_mean~9 strat_mean~9", "SELECT year(month_start) AS year, avg(mean_N2) AS n2_mean, avg(mean_strat) AS strat_mean FROM t_strat GROUP BY 1")
def _(m):
    return views.yearly_stratification(frames.strat(m))


TABLES["t_recent"] = "SELECT * FROM t_argo WHERE time >= (SELECT max(time) FROM t_argo) - INTERVAL 90 DAY"


@query("A22_recent_statistics", "n_profiles# mean_sst~ median_mld~ mean_ohc~3", "SELECT count(*) AS n_profiles, avg(sst_argo) AS mean_sst, median(mld) AS median_mld, avg(ohc_700m) / 1e6 AS mean_ohc FROM t_recent")
def _(m):
    return sampling.recent_statistics(frames.argo(m)).withColumn("mean_ohc", F.col("mean_ohc") / 1e6)


@query("A22_recent_means", "n_profiles# mean_sst~ mean_mld~", "SELECT count(*) AS n_profiles, avg(sst_argo) AS mean_sst, avg(mld) AS mean_mld FROM t_recent")
def _(m):
    return sampling.recent_statistics(frames.argo(m), mld="mean")


@query("A23_recent_rapid_counts", "sst_rises_30d# sst_drops_30d#", "SELECT count(*) FILTER (WHERE rapid_sst_rise) AS sst_rises_30d, count(*) FILTER (WHERE rapid_sst_drop) AS sst_drops_30d FROM t_rapid WHERE date >= (SELECT max(date) FROM t_rapid) - 30")
def _(m):
    return sampling.recent_rapid_counts(frames.rapid(m))


@query("A24_series_totals", "total_days# mhw_days# mhw_fraction~3", "SELECT count(*) AS total_days, count(*) FILTER (WHERE is_mhw) AS mhw_days, count(*) FILTER (WHERE is_mhw) * 1.0E0 / count(*) AS mhw_fraction FROM (SELECT * FROM t_days ORDER BY date DESC LIMIT 365)")
def _(m):
    return views.heatwave_totals(frames.days(m))


TABLES["t_points"] = "SELECT lat AS latitude, lon AS longitude, round(sst, 3) AS sst, round(coalesce(sst_anomaly, sst - 28) + 2.37e-10, 3) AS sst_anomaly FROM t_sst WHERE time = (SELECT max(time) FROM t_sst) AND sst IS NOT NULL"


@query("A25_point_bounds", "min_sst~2 max_sst~2 min_sst_anomaly~2 max_sst_anomaly~2 mean_sst~2 n_points#",
       "SELECT min(sst) AS min_sst, max(sst) AS max_sst, min(sst_anomaly) AS min_sst_anomaly, max(sst_anomaly) AS max_sst_anomaly, avg(sst) AS mean_sst, count(*) AS n_points FROM t_points")
def _(m):
    return grid.point_bounds(grid.heatmap_points(frames.sst(m), stride=1))


@query("A26_phase_counts", "kind phase n_rows#",
       """SELECT 'enso_phase' AS kind, enso_phase AS phase, count(*) AS n_rows FROM t_days WHERE is_mhw GROUP BY 2 UNION ALL SELECT 'iod_phase', iod_phase, count(*) FROM t_days WHERE is_mhw GROUP BY 2
 UNION ALL SELECT 'pdo_phase', pdo_phase, count(*) FROM t_days WHERE is_mhw GROUP BY 2""")
def _(m):
    return context.phase_counts(frames.days(m), "is_mhw")


@query("A26_unusual_context", "phase n_rows# mean_enso~ mean_dmi~",
       "SELECT CASE WHEN enso >= 0.5 THEN 'El Nino' WHEN enso <= -0.5 THEN 'La Nina' WHEN enso IS NULL THEN 'unknown' ELSE 'Neutral' END AS phase, count(*) AS n_rows, avg(enso) AS mean_enso, avg(dmi) AS mean_dmi FROM t_unusual WHERE mld_unusual GROUP BY 1")
def _(m):
    u = detect.unusual_mixed_layers(frames.argo(m), m("indices")).where("mld_unusual")
    return u.groupBy(enso_phase(F.col("enso")).alias("phase")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("enso").alias("mean_enso"), F.avg("dmi").alias("mean_dmi"))


@query("A27_phase_composite", "kind phase n_days# mean_value~ min_value~ q25~ q50~ q75~ max_value~",
       """SELECT kind, phase, count(*) AS n_days, avg(v) AS mean_value, min(v) AS min_value, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max_value
 FROM (SELECT 'enso_phase' AS kind, enso_phase AS phase, max_intensity AS v FROM t_days WHERE is_mhw UNION ALL SELECT 'iod_phase', iod_phase, max_intensity FROM t_days WHERE is_mhw) GROUP BY 1, 2""")
def _(m):
    return context.phase_composite(frames.days(m))


@query("A28_consistency_rate", "n_profiles# pass_rate~ color_low~ color_high~",
       "SELECT count(*) AS n_profiles, avg((mld < thermocline)::INT) * 100 AS pass_rate, quantile_cont(sst_argo, 0.05) AS color_low, quantile_cont(sst_argo, 0.95) AS color_high FROM t_argo WHERE mld IS NOT NULL AND thermocline IS NOT NULL AND sst_argo IS NOT NULL")
def _(m):
    return sampling.consistency_rate(frames.argo(m))


TABLES["t_conf"] = """SELECT count(*) AS n_profiles, avg(confidence) AS mean_confidence, count(*) FILTER (WHERE confidence >= 0.8) AS n_high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS n_medium,
 count(*) FILTER (WHERE confidence < 0.5) AS n_low, count(*) FILTER (WHERE sparse_flag) AS n_sparse, count(*) FILTER (WHERE mld < thermocline) AS n_consistent, count(*) FILTER (WHERE mld >= thermocline) AS n_inconsistent FROM t_unc"""


@query("A29_confidence_distribution", "n_profiles# mean_confidence~ n_high# n_medium# n_low# n_sparse# n_consistent# n_inconsistent#", "SELECT * FROM t_conf")
def _(m):
    return sampling.confidence_distribution(frames.unc(m))


@query("A30_uncertainty_summary", "item value~3",
       """SELECT 'profiles' AS item, n_profiles::DOUBLE AS value FROM t_conf UNION ALL SELECT 'mean confidence', mean_confidence FROM t_conf UNION ALL SELECT 'high confidence', n_high FROM t_conf UNION ALL SELECT 'sparse profiles', n_sparse FROM t_conf
 UNION ALL SELECT 'temperature uncertainty', 0.002 UNION ALL SELECT 'mixed layer uncertainty', sqrt(0.0004E0 * 0.0004E0 + 0.008E0 * 0.008E0) / 0.01 UNION ALL SELECT 'heat content uncertainty', 1025.0 * 3985 * 0.002 * 700
 UNION ALL SELECT 'sst confidence', 1 - avg(f) FROM (SELECT 1 - count(sst) / 20.0E0 AS f FROM t_grid GROUP BY time) UNION ALL SELECT 'qnet confidence', greatest(0, 1 - 15 / greatest(stddev_pop(qnet), 1)) FROM t_flux UNION ALL SELECT 'wind confidence', greatest(0, 1 - 0.5 / greatest(avg(wind_speed), 0.1)) FROM t_wind UNION ALL SELECT 'sla confidence', 0.95
 UNION ALL SELECT 'heatwave confidence', avg(mhw_confidence) FROM t_mhw WHERE is_mhw""")
def _(m):
    from halocline.operators import fields

    g = grid.grid_uncertainty(m("grid"), fields.heat_flux(m("surface")), frames.stress(m), m("sla"))
    return sampling.uncertainty_summary(frames.unc(m), g, frames.mhw(m))


@query("A31_column_summary", "variable min_value~ max_value~ median~ n_valid#",
       " UNION ALL ".join(f"SELECT '{c}' AS variable, min({c}) AS min_value, max({c}) AS max_value, median({c}) AS median, count({c}) AS n_valid FROM t_argo" for c in ("mld", "thermocline", "mean_N2", "sst_argo"))
       + " UNION ALL SELECT 'ohc_700m', min(ohc_700m) / 1e9, max(ohc_700m) / 1e9, median(ohc_700m) / 1e9, count(ohc_700m) FROM t_argo")
def _(m):
    argo = frames.argo(m).withColumn("ohc_700m", F.col("ohc_700m") / 1e9)
    return sampling.column_summary(argo, ["mld", "thermocline", "mean_N2", "sst_argo", "ohc_700m"])


CORR = ["sst_anomaly", "ohc", "mld", "mhw_days"]


@query("A32_correlation_matrix", "row col corr~",
       " UNION ALL ".join(f"SELECT '{a}' AS row, '{b}' AS col, coalesce(corr({a}, {b}), 0) AS corr FROM t_yearly6" for a in CORR for b in CORR))
def _(m):
    return series.correlation_matrix(yearly(m).withColumn("ohc", F.col("ohc") / 1e6), CORR)


def current(m):
    p = listing.normalise_profiles(frames.unc(m))
    return tracks.latest_positions(p, order=("time", "dac", "profile_idx"))


TABLES["t_current"] = "SELECT * FROM t_norm QUALIFY row_number() OVER (PARTITION BY float_id ORDER BY time DESC, dac DESC, profile_idx DESC) = 1"


@query("A33_basin_table", "basin n_floats# mean_sst~ mean_mld~ mean_confidence~ n_basins#",
       """SELECT basin, count(*) AS n_floats, avg(sst_argo) AS mean_sst, avg(mld) AS mean_mld, avg(confidence) AS mean_confidence, 1 AS n_basins FROM t_current GROUP BY basin
 UNION ALL SELECT NULL, count(*), avg(sst_argo), avg(mld), avg(confidence), count(DISTINCT basin) FROM t_current""")
def _(m):
    return regions.basin_table(current(m))


@query("A34_days_and_floats", "kind value", "SELECT DISTINCT 'day' AS kind, strftime(time, '%Y-%m-%d') AS value FROM t_floats UNION ALL SELECT DISTINCT 'float', float_id FROM t_floats")
def _(m):
    return tracks.days_and_floats(m("floats"))


@query("A35_calendar_totals", "mhw_days# severe_days# max_intensity~", "SELECT count(*) FILTER (WHERE is_mhw) AS mhw_days, count(*) FILTER (WHERE intensity > 3) AS severe_days, greatest(coalesce(max(intensity) FILTER (WHERE is_mhw), 1), 1) AS max_intensity FROM t_cal")
def _(m):
    return views.calendar_totals(views.calendar(frames.days(m)))


@query("A36_pdo_context", "pdo_mean~ pdo_recent~ pdo_mean_phase pdo_recent_phase",
       """SELECT *, CASE WHEN pdo_mean >= 0.5 THEN 'Positive PDO' WHEN pdo_mean <= -0.5 THEN 'Negative PDO' ELSE 'Neutral PDO' END AS pdo_mean_phase, CASE WHEN pdo_recent >= 0.5 THEN 'Positive PDO' WHEN pdo_recent <= -0.5 THEN 'Negative PDO' ELSE 'Neutral PDO' END AS pdo_recent_phase
 FROM (SELECT (SELECT avg(pdo) FROM t_idx) AS pdo_mean, (SELECT avg(pdo) FROM (SELECT pdo FROM t_idx ORDER BY date DESC LIMIT 90)) AS pdo_recent)""")
def _(m):
    return context.pdo_context(m("indices"))


@query("W1_seven_row_change", "date$ sst_change7d~", "SELECT * FROM t_dsst")
def _(m):
    return series.with_change(detect.rapid_inputs(m("grid"), m("surface"))[0], "sst_mean", "sst_change7d")


@query("W2_persistence", "date$ is_mhw", "SELECT * FROM t_days")
def _(m):
    return series.with_persistence(grid.daily_heatwave_metrics(grid.with_intensity(m("grid"), "sst")))


TABLES["t_long_runs"] = """SELECT *, sum(CASE WHEN hot AND NOT coalesce(before, FALSE) THEN 1 ELSE 0 END) OVER (ORDER BY time, event_id) AS run
 FROM (SELECT *, lag(hot) OVER (ORDER BY time, event_id) AS before FROM (SELECT ts AS time, event_id, value > 40 AS hot FROM events))"""


def instants(m):
    """Events as one long series without keys: many rows a day, ordered by time and number."""
    rows = m.raw("events").select(F.col("ts").alias("time"), "event_id", "value")
    return rows.withColumn("hot", F.col("value") > 40)


@query("W2_long_persistence", "event_id time$ lasting",
       "SELECT event_id, ts AS time, coalesce(sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3, FALSE) AS lasting FROM events")
def _(m):
    return scans.with_persistence(instants(m), "value", "lasting", 40, 3, "time", unit="day")


@query("W4_long_event_runs", "event_id time$ run#", "SELECT * FROM t_long_runs WHERE hot")
def _(m):
    rows = instants(m).withColumnRenamed("event_id", "number")
    return scans.with_event_start(rows, "time", (), "hot", "day").select(F.col("number").alias("event_id"), "time", F.col("event_id").alias("run"))


@query("T1_long_trend", "slope~ r2~ n#",
       """SELECT regr_slope(value, x) * 1000 AS slope, regr_r2(value, x) AS r2, count(*) AS n FROM (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS x FROM events WHERE value IS NOT NULL)""")
def _(m):
    trend = scans.linear_trend(instants(m), "value", "time", steps_per_year=1000, unit="day")
    return trend.select(F.col("slope_per_year").alias("slope"), "r2", F.col("n_months").alias("n"))


@query("W2_persistence_backfill", "date$ is_mhw", "SELECT date, coalesce(max(is_mhw) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), FALSE) AS is_mhw FROM t_days")
def _(m):
    return detect.heatwave_days(m("grid"), m("indices"), backfill=True)


@query("W3_recent_share", "date$ mhw_persistence~", "SELECT * FROM t_mhw0")
def _(m):
    return series.with_recent_share(frames.days(m), "is_mhw", "mhw_persistence")


@query("W4_event_runs", "date$ event_id#", "SELECT * FROM t_flagged")
def _(m):
    return events.with_event_start(frames.days(m))


TABLES["t_mohc"] = "SELECT last_day(CAST(time AS DATE)) AS month_end, avg(ohc_700m) / 1e6 AS ohc, avg(sst_argo) AS sst_argo FROM t_argo GROUP BY 1"
TABLES["t_dec"] = "SELECT *, CASE WHEN count(ohc) OVER w >= 6 THEN avg(ohc) OVER w END AS trend FROM t_mohc WINDOW w AS (ORDER BY month_end ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)"


def monthly_ohc(m):
    return series.resample_month(frames.argo(m).withColumn("ohc", F.col("ohc_700m") / 1e6), ["ohc"], "time")


@query("W5_centred_mean", "month_end$ ohc~3 trend~3", "SELECT * FROM t_dec")
def _(m):
    return series.with_centred_mean(monthly_ohc(m), "ohc", "trend")


@query("W6_month_transform", "month_end$ cycle~3", "SELECT month_end, avg(ohc) OVER (PARTITION BY month(month_end)) AS cycle FROM t_mohc")
def _(m):
    return series.with_month_mean(monthly_ohc(m), "ohc", "cycle")


@query("W7_decomposition", "month_end$ observed~3 trend~3 seasonal~3 residual~3",
       "SELECT month_end, ohc AS observed, trend, ohc - trend AS seasonal, ohc - trend - avg(ohc - trend) OVER (PARTITION BY month(month_end)) AS residual FROM t_dec WHERE (SELECT count(*) FROM t_mohc) >= 13")
def _(m):
    return series.decompose(monthly_ohc(m), "ohc")


LAGS = [(d, k) for d in ("enso", "dmi", "pdo") for k in range(0, 91, 15)]
TABLES["t_lags"] = "SELECT *, " + ", ".join(f"lag({d}, {k}) OVER (ORDER BY date) AS {d}_{k}" for d, k in LAGS) + " FROM t_days"


@query("W8_lagged_correlation", "driver lag_days# max_intensity~3 mean_intensity~3 frac_mhw~3",
       " UNION ALL ".join(f"SELECT '{d}' AS driver, {k} AS lag_days, " + ", ".join(f"coalesce(corr({d}_{k}, {t}), 0) AS {t}" for t in ("max_intensity", "mean_intensity", "frac_mhw")) + " FROM t_lags" for d, k in LAGS))
def _(m):
    return series.lagged_correlation(frames.days(m), ["enso", "dmi", "pdo"], ["max_intensity", "mean_intensity", "frac_mhw"])


@query("W9_recent_change", "mean_change~ trend~", "SELECT mean_change, greatest(-0.2, least(0.2, mean_change / 0.05)) AS trend FROM t_chg")
def _(m):
    from halocline.operators import forecast

    return forecast.trend_factor(frames.mhw(m))


@query("W10_onset_factor", "n_rises# onset~", "SELECT n_rises, least(n_rises * 0.05E0, 0.15E0) AS onset FROM t_ons")
def _(m):
    from halocline.operators import forecast

    return forecast.onset_factor(frames.rapid(m))


@query("W11_standard_score", "dac profile_idx mld_zscore~ mld_unusual_deep mld_unusual_shallow", "SELECT * FROM t_unusual")
def _(m):
    return detect.unusual_mixed_layers(frames.argo(m), m("indices"))


@query("W12_seasonal_anomaly", "dac profile_idx sst_seasonal_anom~ mld_seasonal_anom~",
       "SELECT dac, profile_idx, sst_argo - avg(sst_argo) OVER w AS sst_seasonal_anom, mld - avg(mld) OVER w AS mld_seasonal_anom FROM t_argo WINDOW w AS (PARTITION BY month(time))")
def _(m):
    return seasonal.with_seasonal_anomaly(frames.argo(m))


@query("W13_change_thresholds", "sst_change7d_high~ sst_change7d_low~", "SELECT su AS sst_change7d_high, sd AS sst_change7d_low FROM t_limits")
def _(m):
    s = series.with_change(detect.rapid_inputs(m("grid"), m("surface"))[0], "sst_mean", "sst_change7d")
    return series.change_thresholds(s, ["sst_change7d"])


@query("W14_latest_per_float", "float_id profile_idx time$ lat~2 lon~2", "SELECT * FROM t_floats WHERE CAST(time AS DATE) <= DATE '2000-06-30' QUALIFY row_number() OVER (PARTITION BY float_id ORDER BY time DESC, profile_idx DESC) = 1")
def _(m):
    return tracks.latest_positions(m("floats"), "2000-06-30")


@query("W15_trails", "position# float_id time$ profile_idx lat~2 lon~2", "SELECT *, row_number() OVER (ORDER BY float_id, time, profile_idx) AS position FROM t_floats")
def _(m):
    return frames.placed(tracks.trails(m("floats")))


@query("W16_tail_rows", "date$ is_mhw mean_intensity~", "SELECT * FROM t_days ORDER BY date DESC LIMIT 365")
def _(m):
    return series.tail_rows(frames.days(m), 365)


@query("W17_latest_row", "date$ frac_mhw~ is_mhw", "SELECT * FROM t_days ORDER BY date DESC LIMIT 1")
def _(m):
    return series.latest_row(frames.days(m)).select("latest.*")


@query("A31_exact_quantiles", "lat prob~2 quantile~",
       "SELECT lat, p AS prob, quantile AS quantile FROM (SELECT lat, unnest([0.1, 0.5, 0.99]) AS p, unnest(quantile_cont(sst, [0.1, 0.5, 0.99])) AS quantile FROM t_grid GROUP BY lat)")
def _(m):
    return quantiles.exact_quantiles(m("grid"), "sst", [0.1, 0.5, 0.99], ["lat"])
