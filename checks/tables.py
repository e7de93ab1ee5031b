"""Named oracle tables shared by many oracles; written with windows and subqueries, independent of
the library's own plans."""

from halocline.functions import physics as P

from .common import TABLES


def poly(x, ks):
    return " + ".join(f"({k!r})" + f" * {x}" * i for i, k in enumerate(ks))


S = "(CASE WHEN psal >= 0 THEN psal ELSE 0.0E0 END)"
B = "(pres / 10.0E0)"
SURFACE = (
    f"({poly('temp', P.DENSITY_WATER)}) + ({poly('temp', P.DENSITY_S)}) * {S}"
    f" + ({poly('temp', P.DENSITY_S15)}) * pow({S}, 1.5E0) + ({poly('temp', P.DENSITY_S2)}) * {S} * {S}"
)
BULK = (
    f"({poly('temp', P.BULK_WATER)}) + ({poly('temp', P.BULK_P)}) * {B} + ({poly('temp', P.BULK_P2)}) * {B} * {B}"
    f" + ({poly('temp', P.BULK_S)}) * {S} + ({poly('temp', P.BULK_S15)}) * pow({S}, 1.5E0)"
)
DENSITY = f"(({SURFACE}) / (1.0E0 - {B} / ({BULK})))"

ENSO = "CASE WHEN enso IS NULL THEN 'unknown' WHEN enso >= 0.5 THEN 'El Nino' WHEN enso <= -0.5 THEN 'La Nina' ELSE 'Neutral' END"
IOD = "CASE WHEN dmi IS NULL THEN 'unknown' WHEN dmi >= 0.4 THEN 'Positive IOD' WHEN dmi <= -0.4 THEN 'Negative IOD' ELSE 'Neutral IOD' END"
PDO = "CASE WHEN pdo IS NULL THEN 'unknown' WHEN pdo >= 0.5 THEN 'Positive PDO' WHEN pdo <= -0.5 THEN 'Negative PDO' ELSE 'Neutral PDO' END"
CATEGORY = "CASE WHEN max_intensity IS NULL OR max_intensity <= 0 THEN 0 WHEN max_intensity < 2 THEN 1 WHEN max_intensity < 3 THEN 2 WHEN max_intensity < 4 THEN 3 ELSE 4 END"
BASIN = (
    "CASE WHEN lat BETWEEN 5 AND 25 AND lon BETWEEN 80 AND 100 THEN 'Bay of Bengal'"
    " WHEN lat BETWEEN 5 AND 25 AND lon BETWEEN 55 AND 80 THEN 'Arabian Sea'"
    " WHEN lat < -15 THEN 'Southern Indian Ocean' WHEN lat BETWEEN -5 AND 5 THEN 'Equatorial Indian Ocean' ELSE 'Indian Ocean' END"
)

TABLES.update(
    {
        "t_wind": "SELECT *, sqrt(u10 * u10 + v10 * v10) AS wind_speed FROM t_surface",
        "t_stress0": "SELECT *, 1.225E0 * 1.3E-3 * wind_speed * u10 AS tau_x, 1.225E0 * 1.3E-3 * wind_speed * v10 AS tau_y FROM t_wind",
        "t_stress": "SELECT *, sqrt(tau_x * tau_x + tau_y * tau_y) AS tau_mag FROM t_stress0",
        "t_coriolis": "SELECT *, 2 * 7.2921E-5 * sin(radians(lat)) AS f0 FROM t_stress",
        "t_ekman": """SELECT *, CASE WHEN abs(f0) >= 1e-6 THEN tau_y / (1025.0E0 * f0) END AS ekman_x,
 CASE WHEN abs(f0) >= 1e-6 THEN -tau_x / (1025.0E0 * f0) END AS ekman_y FROM t_coriolis""",
        "t_flux": """SELECT *, CASE WHEN ssr + str + slhf + sshf IS NOT NULL
 THEN greatest(-800.0E0, least(600.0E0, ssr + str + slhf + sshf)) END AS qnet FROM t_surface""",
        "t_qnet": """SELECT *, avg(qnet) OVER (PARTITION BY lat, lon, dayofyear(time)) AS qnet_clim,
 qnet - avg(qnet) OVER (PARTITION BY lat, lon, dayofyear(time)) AS qnet_anom FROM t_flux""",
        "t_sst": """SELECT *, avg(sst) OVER (PARTITION BY lat, lon, dayofyear(time)) AS sst_clim,
 sst - avg(sst) OVER (PARTITION BY lat, lon, dayofyear(time)) AS sst_anomaly FROM t_grid""",
        "t_thresh": "SELECT lat, lon, quantile_cont(sst, 0.9) AS threshold FROM t_grid GROUP BY lat, lon",
        "t_int": "SELECT g.*, g.sst - h.threshold AS intensity FROM t_grid g JOIN t_thresh h ON g.lat = h.lat AND g.lon = h.lon",
        "t_daily": f"""SELECT *, {CATEGORY} AS mhw_category FROM (
 SELECT time AS date, count(*) FILTER (WHERE intensity > 0) * 1.0E0 / count(intensity) AS frac_mhw,
 coalesce(avg(intensity) FILTER (WHERE intensity > 0), 0.0E0) AS mean_intensity, max(intensity) AS max_intensity
 FROM t_int GROUP BY time HAVING count(intensity) > 0)""",
        "t_idx": "SELECT time AS date, enso, dmi, pdo FROM t_indices",
        "t_days": f"""SELECT *, {ENSO} AS enso_phase, {IOD} AS iod_phase, {PDO} AS pdo_phase,
 sum(CASE WHEN frac_mhw > 0.05 THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS is_mhw
 FROM (SELECT d.*, i.enso, i.dmi, i.pdo FROM t_daily d LEFT JOIN t_idx i ON d.date = i.date)""",
        "t_mhw0": """SELECT *, mean_intensity / 0.31E0 AS mhw_signal_noise,
 sum(is_mhw::INT) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) / 30.0E0 AS mhw_persistence FROM t_days""",
        "t_mhw": """SELECT *, greatest(0, least(1, 0.7E0 * greatest(0, least(1, mhw_signal_noise / (mhw_signal_noise + 1)))
 + 0.3E0 * mhw_persistence)) AS mhw_confidence FROM t_mhw0""",
        "t_run": """SELECT *, sum(CASE WHEN is_mhw AND NOT coalesce(before, FALSE) THEN 1 ELSE 0 END) OVER (ORDER BY date) AS event_id
 FROM (SELECT *, lag(is_mhw) OVER (ORDER BY date) AS before FROM t_mhw)""",
        "t_flagged": "SELECT * FROM t_run WHERE is_mhw",
        "t_peak": "SELECT event_id, date AS peak_date, mhw_category AS peak_category FROM t_flagged QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY max_intensity DESC, date) = 1",
        "t_domenso": "SELECT event_id, enso_phase AS dominant_enso FROM (SELECT event_id, enso_phase, count(*) AS n FROM t_flagged GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, enso_phase) = 1",
        "t_domiod": "SELECT event_id, iod_phase AS dominant_iod FROM (SELECT event_id, iod_phase, count(*) AS n FROM t_flagged GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC, iod_phase) = 1",
        "t_ev0": """SELECT event_id, min(date) AS start_date, max(date) AS end_date, count(*) AS duration_days,
 max(max_intensity) AS peak_intensity, avg(mean_intensity) AS mean_intensity, max(frac_mhw) * 100 AS peak_coverage,
 sum(mean_intensity * frac_mhw) AS accumulated_heat, avg(mhw_confidence) AS mean_confidence FROM t_flagged GROUP BY event_id""",
        "t_ev": """SELECT e.*, p.peak_date, p.peak_category, a.dominant_enso, b.dominant_iod FROM t_ev0 e JOIN t_peak p USING (event_id)
 JOIN t_domenso a USING (event_id) JOIN t_domiod b USING (event_id)""",
        "t_vl0": """SELECT *, %s AS rho0 FROM t_levels WHERE pres BETWEEN 0 AND 10000 AND temp > -5 AND temp < 45 AND psal > 0 AND psal < 50""" % DENSITY,
        "t_vl": "SELECT dac, profile_idx, level_idx, pres, temp, psal, CASE WHEN rho0 BETWEEN 1000 AND 1060 THEN rho0 END AS rho FROM t_vl0",
        "t_ut": "SELECT * FROM t_vl QUALIFY row_number() OVER (PARTITION BY dac, profile_idx, pres ORDER BY level_idx) = 1",
        "t_ur": "SELECT * FROM t_vl WHERE rho IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dac, profile_idx, pres ORDER BY level_idx) = 1",
        "t_gt": """SELECT *, lag(pres) OVER (PARTITION BY dac, profile_idx ORDER BY pres) AS p1,
 lag(temp) OVER (PARTITION BY dac, profile_idx ORDER BY pres) AS t1 FROM t_ut""",
        "t_gr": """SELECT *, lag(pres) OVER w AS p1, lag(rho) OVER w AS r1, first_value(rho) OVER w AS r0,
 count(*) OVER (PARTITION BY dac, profile_idx) AS nr FROM t_ur WINDOW w AS (PARTITION BY dac, profile_idx ORDER BY pres)""",
        "t_cnt": """SELECT dac, profile_idx, count(*) AS n_valid_levels, avg(temp) FILTER (WHERE pres <= 20) AS sst_argo,
 avg(psal) FILTER (WHERE pres <= 20) AS sss_argo, avg(rho) FILTER (WHERE pres <= 20) AS surf_density FROM t_vl GROUP BY 1, 2 HAVING count(*) >= 5""",
        "t_mld": """SELECT dac, profile_idx, p1 + (0.03E0 - (r1 - r0)) / ((rho - r0) - (r1 - r0)) * (pres - p1) AS mld FROM t_gr
 WHERE rho - r0 > 0.03 AND nr >= 3 QUALIFY row_number() OVER (PARTITION BY dac, profile_idx ORDER BY pres) = 1""",
        "t_thermo": """SELECT dac, profile_idx, p1 / 2 + pres / 2 AS thermocline FROM t_gt WHERE p1 >= 10
 QUALIFY count(*) OVER (PARTITION BY dac, profile_idx) >= 2 AND row_number() OVER (PARTITION BY dac, profile_idx ORDER BY (temp - t1) / (pres - p1), pres) = 1""",
        "t_n2": """SELECT dac, profile_idx, avg(9.81E0 / 1025 * (rho - r1) / (pres - p1)) AS mean_N2, max(9.81E0 / 1025 * (rho - r1) / (pres - p1)) AS max_N2,
 coalesce(avg(abs((rho - r1) / (pres - p1))) FILTER (WHERE p1 <= 200), avg(abs((rho - r1) / (pres - p1)))) AS strat_index FROM t_gr WHERE nr >= 3 GROUP BY 1, 2""",
        "t_ohc": """SELECT dac, profile_idx, CASE WHEN count(*) >= 2 THEN 1025.0E0 * 3985.0E0 * sum(0.5E0 * (temp + t1) * (pres - p1)) END AS ohc_700m FROM t_gt WHERE pres <= 700 GROUP BY 1, 2""",
        "t_argo": """SELECT c.*, CASE WHEN mld BETWEEN 0 AND 2000 THEN mld END AS mld,
 CASE WHEN thermocline BETWEEN 0 AND 2000 THEN thermocline END AS thermocline, strat_index, mean_N2, max_N2, ohc_700m, p.lat, p.lon, p.time
 FROM t_cnt c JOIN t_profiles p USING (dac, profile_idx) LEFT JOIN t_mld USING (dac, profile_idx) LEFT JOIN t_thermo USING (dac, profile_idx)
 LEFT JOIN t_n2 USING (dac, profile_idx) LEFT JOIN t_ohc USING (dac, profile_idx)""",
        "t_unc0": """SELECT *, least(n_valid_levels / 50.0E0, 1.0E0) AS C_sampling, 1.0E0 - 0.002E0 / 35.0E0 AS C_instrument,
 CASE WHEN mld < thermocline THEN 1.0E0 WHEN mld >= thermocline THEN 0.5E0 WHEN mld IS NULL AND thermocline IS NULL THEN 0.5E0 ELSE 0.75E0 END AS C_physics,
 (CASE WHEN sst_argo < -2 OR sst_argo > 40 THEN 0.3E0 ELSE 1.0E0 END) * (CASE WHEN mld > 500 THEN 0.7E0 ELSE 1.0E0 END) AS C_bounds,
 n_valid_levels < 10 AS sparse_flag FROM t_argo""",
        "t_unc": "SELECT *, greatest(0, least(1, 0.25E0 * C_sampling + 0.25E0 * C_instrument + 0.3E0 * C_physics + 0.2E0 * C_bounds)) AS confidence FROM t_unc0",
        "t_asst": "SELECT time AS date, avg(sst_anomaly) AS sst_mean FROM t_sst GROUP BY 1",
        "t_aair": "SELECT time AS date, avg(qnet) AS qnet_mean FROM t_flux GROUP BY 1",
        "t_awind": "SELECT time AS date, avg(wind_speed) AS ws_mean FROM t_wind GROUP BY 1",
        "t_dsst": "SELECT *, sst_mean - lag(sst_mean, 7) OVER (ORDER BY date) AS sst_change7d FROM t_asst",
        "t_dair": "SELECT *, qnet_mean - lag(qnet_mean, 7) OVER (ORDER BY date) AS qnet_change7d FROM t_aair",
        "t_dwind": "SELECT *, ws_mean - lag(ws_mean, 7) OVER (ORDER BY date) AS ws_change7d FROM t_awind",
        "t_limits": """SELECT (SELECT quantile_cont(sst_change7d, 0.95) FROM t_dsst) AS su, (SELECT quantile_cont(sst_change7d, 0.05) FROM t_dsst) AS sd,
 (SELECT quantile_cont(qnet_change7d, 0.95) FROM t_dair) AS qu, (SELECT quantile_cont(ws_change7d, 0.95) FROM t_dwind) AS wu""",
        "t_rapid": f"""SELECT *, {ENSO} AS enso_phase, {IOD} AS iod_phase FROM (SELECT s.*, q.qnet_mean, q.qnet_change7d, w.ws_mean, w.ws_change7d,
 coalesce(sst_change7d > su, FALSE) AS rapid_sst_rise, coalesce(sst_change7d < sd, FALSE) AS rapid_sst_drop,
 coalesce(abs(qnet_change7d) > abs(qu), FALSE) AS rapid_qnet_swing, coalesce(ws_change7d > wu, FALSE) AS rapid_wind, i.enso, i.dmi, i.pdo
 FROM t_dsst s LEFT JOIN t_dair q ON s.date = q.date LEFT JOIN t_dwind w ON s.date = w.date LEFT JOIN t_idx i ON s.date = i.date, t_limits)""",
        "t_long": """SELECT 'SST anomaly' AS variable, last_day(date) AS month_end, avg(sst_mean) AS value FROM t_asst GROUP BY 2
 UNION ALL SELECT 'Qnet', last_day(date), avg(qnet_mean) FROM t_aair GROUP BY 2
 UNION ALL SELECT 'OHC_700m', last_day(CAST(time AS DATE)), avg(ohc_700m) FROM t_argo GROUP BY 2
 UNION ALL SELECT 'MLD', last_day(CAST(time AS DATE)), avg(mld) FROM t_argo GROUP BY 2""",
        "t_ord": "SELECT *, row_number() OVER (PARTITION BY variable ORDER BY month_end) - 1 AS x FROM t_long WHERE value IS NOT NULL",
        "t_trends": """SELECT variable, CASE WHEN n >= 6 THEN s * 12 END AS slope_per_year, CASE WHEN n >= 6 THEN r END AS r2, CASE WHEN n >= 6 THEN n END AS n_months
 FROM (SELECT variable, count(*) AS n, regr_slope(value, x) AS s, CASE WHEN var_pop(value) > 0 THEN regr_r2(value, x) ELSE 0.0E0 END AS r FROM t_ord GROUP BY 1)""",
        "t_boxes": """SELECT * FROM (VALUES ('Arabian Sea', 5, 25, 55, 80), ('Bay of Bengal', 5, 25, 80, 100), ('Equatorial IO', -5, 5, 45, 100),
 ('Southern IO', -40, -15, 40, 100), ('Western IO', -15, 15, 40, 65), ('Eastern IO', -15, 15, 95, 120)) AS b(basin, lat_min, lat_max, lon_min, lon_max)""",
        "t_inbox": "SELECT b.basin, p.* FROM t_boxes b JOIN t_unc p ON p.lat BETWEEN b.lat_min AND b.lat_max AND p.lon BETWEEN b.lon_min AND b.lon_max",
        "t_months": """SELECT CAST(date_trunc('month', time) AS DATE) AS month_start, avg(mean_N2) AS mean_N2, stddev_samp(mean_N2) AS std_N2,
 avg(strat_index) AS mean_strat, stddev_samp(strat_index) AS std_strat, count(lat) AS n_profiles FROM t_unc GROUP BY 1""",
        "t_midx": "SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, avg(enso) AS enso, avg(dmi) AS dmi, avg(pdo) AS pdo FROM t_idx GROUP BY 1",
        "t_strat": f"SELECT *, month(month_start) AS month, {ENSO} AS enso_phase, {IOD} AS iod_phase, {PDO} AS pdo_phase FROM t_months LEFT JOIN t_midx USING (month_start)",
        "t_clim": """SELECT variable, month, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, count(value) AS n FROM (
 SELECT 'sst_argo' AS variable, month(time) AS month, sst_argo AS value FROM t_unc UNION ALL SELECT 'mld', month(time), mld FROM t_unc
 UNION ALL SELECT 'ohc_700m', month(time), ohc_700m FROM t_unc) GROUP BY 1, 2""",
        "t_norm0": f"""SELECT *, lat AS latitude, lon AS longitude, CAST(round(lat, 2) AS VARCHAR) || '_' || CAST(round(lon, 2) AS VARCHAR) AS float_id, {BASIN} AS basin FROM t_unc""",
        "t_norm": "SELECT *, float_id || '_' || strftime(time, '%Y%m%d') || '_' || dac || '_' || CAST(profile_idx AS VARCHAR) AS profile_id FROM t_norm0",
        "t_yearly": """SELECT year, max(sst) AS sst, max(sst_anomaly) AS sst_anomaly, max(ohc) AS ohc, max(mld) AS mld, max(mhw_days) AS mhw_days FROM (
 SELECT year(d) AS year, avg(s) AS sst, avg(a) AS sst_anomaly, NULL AS ohc, NULL AS mld, NULL AS mhw_days FROM (SELECT time AS d, avg(sst) AS s, avg(sst_anomaly) AS a FROM t_sst GROUP BY 1) GROUP BY 1
 UNION ALL SELECT year(time), NULL, NULL, avg(ohc_700m), avg(mld), NULL FROM t_argo GROUP BY 1
 UNION ALL SELECT year(date), NULL, NULL, NULL, NULL, count(*) FROM t_days WHERE is_mhw GROUP BY 1) GROUP BY year""",
    }
)
