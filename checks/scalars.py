"""Projections, filters, text and array functions."""

from pyspark.sql import functions as F

from halocline import constants as K
from halocline.functions import arrays as A
from halocline.functions import labels as L
from halocline.functions import numeric as N
from halocline.functions import physics as P
from halocline.functions import text as X
from halocline.operators import detect, fields, grid, listing, nearest, profiles, series
from halocline.sources import tables

from . import frames
from .common import TABLES, query
from .tables import DENSITY

CELL = "time$ lat lon "


@query("P1_wind_stress", CELL + "wind_speed~ tau_x~ tau_y~ tau_mag~", "SELECT * FROM t_stress")
def _(m):
    return frames.stress(m)


@query("P2_ekman_transport", CELL + "ekman_x~ ekman_y~", "SELECT * FROM t_ekman")
def _(m):
    return fields.ekman_transport(frames.stress(m))


@query("P3_net_heat_flux", CELL + "qnet~", "SELECT * FROM t_flux")
def _(m):
    return fields.heat_flux(m("surface"))


@query("P4_seawater_density", "dac profile_idx level_idx pres temp~4 psal~4 rho~",
       f"SELECT *, CASE WHEN r BETWEEN 1000 AND 1060 THEN r END AS rho FROM (SELECT *, {DENSITY} AS r FROM t_levels)")
def _(m):
    return profiles.with_density(m("levels"))


TABLES["t_aspot"] = """SELECT p.*, c.lat AS cell_lat, c.lon AS cell_lon FROM t_argo p, (SELECT DISTINCT lat, lon FROM t_surface) c
 WHERE sqrt(pow(p.lat - c.lat, 2) + pow(p.lon - c.lon, 2)) < 30
 QUALIFY row_number() OVER (PARTITION BY dac, profile_idx ORDER BY sqrt((p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon)), c.lat, c.lon) = 1"""
TABLES["t_areading"] = """SELECT p.dac, p.profile_idx, w.wind_speed FROM t_aspot p JOIN t_wind w ON p.cell_lat = w.lat AND p.cell_lon = w.lon
 WHERE w.wind_speed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p.dac, p.profile_idx
 ORDER BY abs(epoch_us(CAST(p.time AS TIMESTAMP)) - epoch_us(CAST(w.time AS TIMESTAMP))), w.time) = 1"""


@query("P5_wind_mixing_index", "dac profile_idx wind_speed~ wmi~9",
       """SELECT dac, profile_idx, wind_speed, CASE WHEN mld > 0 THEN pow(1.225E0 * 1.3E-3 * wind_speed * wind_speed, 3) / (1025.0E0 * mld) * 1e6 END AS wmi
 FROM t_argo LEFT JOIN t_areading USING (dac, profile_idx)""")
def _(m):
    keys = ["dac", "profile_idx"]
    near = nearest.nearest_reading(frames.argo(m), frames.stress(m), ["wind_speed"], keys, radius=30.0, spacing=10.0)
    index = P.wind_mixing_index(F.col("nearest.wind_speed"), F.col("mld")) * 1e6
    return near.select(*keys, "nearest.wind_speed", index.alias("wmi"))


@query("P6_phase_labels", "date$ enso_phase iod_phase pdo_phase", "SELECT date, enso_phase, iod_phase, pdo_phase FROM t_days")
def _(m):
    return frames.days(m)


@query("P7_heatwave_category", "date$ mhw_category#", "SELECT date, mhw_category FROM t_daily")
def _(m):
    return grid.daily_heatwave_metrics(grid.with_intensity(m("grid"), "sst"))


@query("P8_category_labels", "date$ label", "SELECT date, CASE mhw_category WHEN 0 THEN 'None' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Strong' WHEN 3 THEN 'Severe' ELSE 'Extreme' END AS label FROM t_daily")
def _(m):
    return frames.days(m).withColumn("label", L.category_label(F.col("mhw_category")))


@query("P9_day_labels", "date$ label", "SELECT date, CASE WHEN NOT is_mhw THEN 'Normal' WHEN mean_intensity >= 3 THEN 'Severe' WHEN mean_intensity >= 2 THEN 'Moderate' ELSE 'Mild MHW' END AS label FROM t_days")
def _(m):
    return frames.days(m).withColumn("label", L.day_label(F.col("is_mhw"), F.col("mean_intensity")))


@query("P10_two_degree_bins", "dac profile_idx lat_bin lon_bin", "SELECT dac, profile_idx, floor(lat / 2) * 2 AS lat_bin, floor(lon / 2) * 2 AS lon_bin FROM t_profiles")
def _(m):
    return detect.cell_month(m("profiles"))


@query("P11_date_parts", "date$ year# month# day# week# weekday# doy# month_start$",
       "SELECT date, year(date) AS year, month(date) AS month, day(date) AS day, weekofyear(date) AS week, isodow(date) - 1 AS weekday, dayofyear(date) AS doy, CAST(date_trunc('month', date) AS DATE) AS month_start FROM (SELECT DISTINCT time AS date FROM t_grid)")
def _(m):
    d = m("grid").select(F.col("time").alias("date")).distinct()
    return d.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"),
        F.weekofyear("date").alias("week"), F.weekday("date").alias("weekday"), F.dayofyear("date").alias("doy"),
        F.trunc("date", "month").alias("month_start"),
    )


TREND_ROWS = """SELECT CASE variable WHEN 'SST anomaly' THEN 'sst' WHEN 'OHC_700m' THEN 'ohc_700m' WHEN 'MLD' THEN 'mld' ELSE 'qnet' END AS variable,
 CASE WHEN variable = 'OHC_700m' THEN round(slope_per_year, 5) * 10 / 1e6 ELSE round(slope_per_year, 5) * 10 END AS slope_per_decade,
 round(r2, 5) AS r2, round(greatest(0, least(1, round(r2, 5))), 4) AS trend_confidence, 0.05E0 AS p_value,
 CASE WHEN slope_per_year * 10 > 0.001 THEN 'rising' WHEN slope_per_year * 10 < -0.001 THEN 'falling' ELSE 'stable' END AS direction FROM t_trends"""


@query("P12_trend_directions", "variable slope_per_decade~3 r2~4 trend_confidence~3 p_value direction", TREND_ROWS)
def _(m):
    from halocline.plans import views

    rows = views.trend_rows(frames.trends(m))
    big = F.col("variable") == "ohc_700m"
    return rows.withColumn("slope_per_decade", F.when(big, F.col("slope_per_decade") / 1e6).otherwise(F.col("slope_per_decade")))


@query("P13_finite_or_default", "event_id value_text$", """SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE value END AS DECIMAL(18, 2)) AS value_text FROM events""")
def _(m):
    raw = m.raw("events")
    dirty = F.when(F.col("event_id") % 10 == 0, "n/a").when(F.col("event_id") % 5 == 0, "NaN").otherwise(F.col("value").cast("string"))
    return raw.select("event_id", N.finite_or(dirty, -1.0, 4).cast("decimal(18,2)").alias("value_text"))


@query("P14_single_basin", "dac profile_idx basin", "SELECT dac, profile_idx, basin FROM t_norm0")
def _(m):
    return m("profiles").withColumn("basin", L.basin_of(F.col("lat"), F.col("lon")))


@query("P15_instrument_errors", "dac profile_idx temp_uncertainty~ psal_uncertainty~ density_uncertainty~9 mld_uncertainty~ ohc_uncertainty~2",
       """SELECT dac, profile_idx, 0.002E0 AS temp_uncertainty, 0.010E0 AS psal_uncertainty, sqrt(pow(0.2E0 * 0.002E0, 2) + pow(0.8E0 * 0.01E0, 2)) AS density_uncertainty,
 sqrt(pow(0.2E0 * 0.002E0, 2) + pow(0.8E0 * 0.01E0, 2)) / 0.01E0 AS mld_uncertainty, 1025.0E0 * 3985.0E0 * 0.002E0 * 700.0E0 AS ohc_uncertainty FROM t_cnt""")
def _(m):
    return frames.unc(m)


@query("P16_risk_labels", "date$ risk", "SELECT date, CASE WHEN mhw_confidence >= 0.7 THEN 'High' WHEN mhw_confidence >= 0.5 THEN 'Elevated' WHEN mhw_confidence >= 0.3 THEN 'Moderate' ELSE 'Low' END AS risk FROM t_mhw")
def _(m):
    return frames.mhw(m).withColumn("risk", L.risk_level(F.col("mhw_confidence")))


@query("P17_normalise_profiles", "profile_id float_id latitude~2 longitude~2 basin confidence~2 sparse_flag",
       "SELECT profile_id, float_id, latitude, longitude, basin, 0.8E0 AS confidence, FALSE AS sparse_flag FROM t_norm")
def _(m):
    return listing.normalise_profiles(frames.argo(m))


@query("P18_normalise_days", "date$ is_mhw intensity~", "SELECT date, frac_mhw > 0.1 AS is_mhw, coalesce(mean_intensity, 0) AS intensity FROM t_daily")
def _(m):
    foreign = frames.days(m).select(
        F.col("date").cast("timestamp").alias("time"), F.when(F.col("frac_mhw") > 0.1, 1).otherwise(0).alias("category"),
        F.col("mean_intensity").cast("string").alias("peak_intensity"),
    )
    return listing.normalise_days(foreign)


@query("P19_unit_vectors", CELL + "ux~ uy~",
       "SELECT time, lat, lon, CASE WHEN tau_mag > 0 THEN tau_x / tau_mag * 1.5E0 ELSE tau_x * 1.5E0 END AS ux, CASE WHEN tau_mag > 0 THEN tau_y / tau_mag * 1.5E0 ELSE tau_y * 1.5E0 END AS uy FROM t_stress")
def _(m):
    mag = F.col("tau_mag")
    return frames.stress(m).withColumns({"ux": P.unit_component(F.col("tau_x"), mag), "uy": P.unit_component(F.col("tau_y"), mag)})


@query("P20_decode_profile_time", "event_id time",
       """SELECT event_id, CASE WHEN event_id % 4 <> 3 AND event_id % 6 <> 5 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS time FROM events""")
def _(m):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    raw = F.when(F.col("event_id") % 4 == 3, -ns).when(F.col("event_id") % 6 == 5, ns * 2).otherwise(ns)
    return tables.decode_time(m.raw("events").withColumn("juld", raw)).withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query("P21_parse_time", "event_id t$", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN date_trunc('second', ts) END AS t FROM events")
def _(m):
    text = F.when(F.col("event_id") % 3 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return tables.parse_time(m.raw("events").withColumn("t", text), "t")


@query("P22_min_max_scale", "dac profile_idx position~",
       "SELECT dac, profile_idx, CASE WHEN hi > lo THEN (mld - lo) / (hi - lo) WHEN mld IS NOT NULL THEN 0.5E0 END AS position FROM t_argo, (SELECT min(mld) AS lo, max(mld) AS hi FROM t_argo)")
def _(m):
    return series.min_max_position(frames.argo(m), "mld", "position")


@query("P23_output_units", "date coverage_pct~4 intensity4~5",
       "SELECT strftime(date, '%Y-%m-%d') AS date, frac_mhw * 100 AS coverage_pct, CASE WHEN max_intensity = 0 THEN 0 ELSE round(max_intensity * pow(10.0, 3 - floor(log10(abs(max_intensity)))) + 1e-7) / pow(10.0, 3 - floor(log10(abs(max_intensity)))) END AS intensity4 FROM t_daily")
def _(m):
    return frames.days(m).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), (F.col("frac_mhw") * 100).alias("coverage_pct"),
        N.round_significant(F.col("max_intensity") + F.when(F.col("max_intensity") == 0, 0.0).otherwise(1e-11), 4).alias("intensity4"),
    )


@query("F1_valid_levels", "dac profile_idx level_idx pres temp~4 psal~4", "SELECT * FROM t_vl")
def _(m):
    return profiles.valid_levels(m("levels"))


@query("F2_usable_profiles", "dac profile_idx n_valid_levels#",
       "SELECT c.dac, c.profile_idx, n_valid_levels FROM t_cnt c JOIN t_profiles p USING (dac, profile_idx) WHERE lat > -30")
def _(m):
    heads = m("profiles").withColumn("lat", F.when(F.col("lat") > -30, F.col("lat")))
    return profiles.profile_physics(m("levels"), heads)


@query("F3_drop_missing", CELL + "sst~4", "SELECT * FROM t_grid WHERE sst IS NOT NULL")
def _(m):
    return m("grid").dropna(subset=["sst", "time"])


@query("F4_choose_adjusted", "dac profile_idx level_idx pres~3 temp~4 psal~4",
       """SELECT l.dac, profile_idx, level_idx, CASE WHEN up THEN pres_adjusted ELSE pres END AS pres, CASE WHEN ut THEN temp_adjusted ELSE temp END AS temp,
 CASE WHEN us THEN psal_adjusted ELSE psal END AS psal FROM t_levels_adjusted l JOIN (SELECT dac, count(pres_adjusted) >= 0.5 * count(pres) AS up,
 count(temp_adjusted) >= 0.5 * count(temp) AS ut, count(psal_adjusted) >= 0.5 * count(psal) AS us FROM t_levels_adjusted GROUP BY dac) c ON l.dac = c.dac""")
def _(m):
    return profiles.choose_adjusted(m("levels_adjusted"))


@query("F5_bounding_box", CELL + "sst~4", "SELECT * FROM t_grid WHERE lat BETWEEN -25 AND 5 AND lon BETWEEN 50 AND 90")
def _(m):
    return grid.in_box(m("grid"), (-25.0, 5.0), (50.0, 90.0))


@query("F6_text_search", "profile_id float_id", "SELECT profile_id, float_id FROM t_norm WHERE contains(lower(float_id), 'dac3') OR contains(lower(profile_id), 'dac3')")
def _(m):
    return listing.search(listing.normalise_profiles(frames.argo(m)), " DAC3 ")


@query("F6_pattern_search", "profile_id", "SELECT profile_id FROM t_norm WHERE regexp_matches(lower(profile_id), '_2001.*dac[0-3]_')")
def _(m):
    return listing.search(listing.normalise_profiles(frames.argo(m)), "_2001.*dac[0-3]_", pattern=True)


@query("F7_basin_filter", "profile_id basin", "SELECT profile_id, basin FROM t_norm WHERE basin = 'Southern Indian Ocean'")
def _(m):
    return listing.in_basin(listing.in_basin(listing.normalise_profiles(frames.argo(m)), "All Basins"), "Southern Indian Ocean")


@query("F8_nearby", "profile_id distance~", "SELECT profile_id, sqrt(lat * lat + (lon - 60) * (lon - 60)) AS distance FROM t_norm WHERE lat BETWEEN -2 AND 2 AND lon BETWEEN 58 AND 62")
def _(m):
    return listing.nearby(listing.normalise_profiles(frames.argo(m)), 0.0, 60.0)


@query("F9_time_range", "profile_id time$", "SELECT profile_id, time FROM t_norm WHERE time >= TIMESTAMP '2001-06-01' AND time <= TIMESTAMP '2001-09-30'")
def _(m):
    return listing.between_times(listing.normalise_profiles(frames.argo(m)), "2001-06-01", "2001-09-30")


@query("F10_event_filter", "event_id# duration_days# peak_category#", "SELECT * FROM t_ev WHERE duration_days >= 5 AND peak_category = 1")
def _(m):
    from halocline.operators import events

    return events.filter_events(frames.event_table(m), 5, 1)


@query("F11_last_days", "date$ frac_mhw~", "SELECT * FROM t_days WHERE date >= (SELECT max(date) FROM t_days) - 30")
def _(m):
    d = frames.days(m)
    return d.where(F.col("date") >= F.date_sub(d.agg(F.max("date")).scalar(), 30))


@query("F12_spatial_stride", CELL + "sst~4",
       """SELECT g.* FROM t_grid g WHERE lat IN (SELECT lat FROM (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS i FROM (SELECT DISTINCT lat FROM t_grid)) WHERE i % 2 = 0)
 AND lon IN (SELECT lon FROM (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS i FROM (SELECT DISTINCT lon FROM t_grid)) WHERE i % 2 = 0)""")
def _(m):
    return grid.spatial_stride(m("grid"), 2)


STEPS = "SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM t_grid)"


@query("F13_time_stride", CELL + "sst~4", f"SELECT g.* FROM t_grid g JOIN ({STEPS}) s ON g.time = s.time WHERE i % greatest(1, CAST(ceil(n / 24.0E0) AS BIGINT)) = 0")
def _(m):
    return grid.time_stride(m("grid"), 24)


@query("F14_even_times", "time$", f"SELECT s.time FROM ({STEPS}) s JOIN (SELECT k FROM range(30) AS r(k)) ON i = CAST(floor(k * (n - 1) / 29.0E0) AS BIGINT)")
def _(m):
    return grid.even_times(m("grid"), 30)


@query("F15_keyed_sample", "dac profile_idx lat~2 lon~2", "SELECT * FROM t_profiles ORDER BY md5(dac || '|' || profile_idx), dac, profile_idx LIMIT 500")
def _(m):
    return listing.top_sample(m("profiles"), ["dac", "profile_idx"], 500)


@query("F16_keyword_lookup", "value~", "SELECT coalesce((SELECT slope_per_year FROM t_trends WHERE contains(lower(variable), 'sst')), 0) AS value")
def _(m):
    return listing.first_match(frames.trends(m), "SST")


@query("F17_profile_by_id", "float_id lat~2 lon~2",
       "SELECT float_id, lat, lon FROM t_norm0 WHERE float_id = '-36.0_45.0' LIMIT 1")
def _(m):
    named = listing.normalise_profiles(frames.argo(m).withColumn("float", F.concat(F.round("lat", 2).cast("string"), F.lit("/"), F.round("lon", 2).cast("string"))))
    return listing.profile_by_id(named, "-36.0/45.0_missing").withColumn("float_id", F.replace(F.col("float_id"), F.lit("/"), F.lit("_")))


def range_sql(table, variables):
    parts = []
    for v in variables:
        low, high = K.RANGE_BOUNDS[v]
        parts.append(
            f"SELECT '{v}' AS variable, CAST(min({v}) AS DOUBLE) AS min_value, CAST(max({v}) AS DOUBLE) AS max_value, count(*) - count({v}) AS n_missing,"
            f" 100.0E0 * (count(*) - count({v})) / count(*) AS pct_missing, coalesce(min({v}) >= {low} AND max({v}) <= {high}, FALSE) AS in_range FROM {table}"
        )
    return " UNION ALL ".join(parts)


RANGE = "variable min_value~3 max_value~3 n_missing# pct_missing~ in_range"


@query("F18_range_check_fields", RANGE, range_sql("t_ekman", ["wind_speed", "tau_x", "tau_y", "ekman_x", "ekman_y"]))
def _(m):
    return grid.range_check(fields.ekman_transport(frames.stress(m)), ["wind_speed", "tau_x", "tau_y", "ekman_x", "ekman_y"])


@query("F18_range_check_sst", RANGE, range_sql("t_sst", ["sst", "sst_anomaly"]))
def _(m):
    return grid.range_check(frames.sst(m), ["sst", "sst_anomaly"])


@query("F18_range_check_profiles", RANGE, range_sql("t_argo", ["mld", "thermocline", "sst_argo"]))
def _(m):
    return grid.range_check(frames.argo(m), ["mld", "thermocline", "sst_argo"])


FENCE = "chr(96) || chr(96) || chr(96)"
ANSWERS = f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || chr(10) || {FENCE} || 'json' || chr(10) || '{{"title": "T' || CAST(conv_id AS VARCHAR) || '", "data": [{{"x": "a", "y": 1}}]}}' || chr(10) || {FENCE} || chr(10) || 'end'
 WHEN turn % 3 = 1 THEN text || ' ' || {FENCE} || 'json [{{"type": "bar", "x_label": "n"}}, {{"type": "area"}}] ' || {FENCE}
 ELSE text || ' ' || {FENCE} || 'json {{broken ' || {FENCE} END AS text FROM conversations"""


def answers(m):
    fence = F.lit("```")
    t, k = F.col("text"), F.col("turn") % 3
    one = F.concat(t, F.lit("\n"), fence, F.lit('json\n{"title": "T'), F.col("conv_id").cast("string"), F.lit('", "data": [{"x": "a", "y": 1}]}\n'), fence, F.lit("\nend"))
    two = F.concat(t, F.lit(" "), fence, F.lit('json [{"type": "bar", "x_label": "n"}, {"type": "area"}] '), fence)
    bad = F.concat(t, F.lit(" "), fence, F.lit("json {broken "), fence)
    return m.raw("conversations").withColumn("text", F.when(k == 0, one).when(k == 1, two).otherwise(bad))


@query("X1_extract_charts", "conv_id turn type title x_label y_label n_data#",
       """SELECT conv_id, turn, u.type AS type, u.title AS title, u.x_label AS x_label, 'Y' AS y_label, u.n AS n_data FROM conversations,
 (VALUES (0, 'line', NULL, 'X', 1), (1, 'bar', 'Chart', 'n', 0), (1, 'area', 'Chart', 'X', 0)) AS v(k, type, title, x_label, n),
 LATERAL (SELECT v.type, coalesce(v.title, 'T' || CAST(conv_id AS VARCHAR)) AS title, v.x_label, v.n) AS u WHERE turn % 3 = v.k""")
def _(m):
    return answers(m).select("conv_id", "turn", F.explode(X.charts_of(F.col("text"))).alias("c")).select("conv_id", "turn", "c.*", F.size("c.data").alias("n_data"))


@query("X1_text_without_charts", "conv_id turn text",
       f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN text WHEN turn % 3 = 1 THEN regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')
 ELSE regexp_replace(text, '^\\s+', '') || chr(10) || chr(10) || 'end' END AS text FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN (text || ' ' || {FENCE} || 'json {{broken ' || {FENCE}) ELSE text END AS text FROM conversations)""")
def _(m):
    return answers(m).withColumn("text", X.without_charts(F.col("text")))


@query("X2_last_messages", "conv_id turn role", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def _(m):
    return series.tail_rows(m.raw("conversations"), 10, "turn", ["conv_id"])


@query("X4_string_helpers", "conv_id turn padded prefix is_user role_upper trimmed_len#",
       "SELECT conv_id, turn, lpad(CAST(conv_id AS VARCHAR), 8, '0') AS padded, split_part(role || '_' || CAST(turn AS VARCHAR), '_', 1) AS prefix, ends_with(role, 'user') AS is_user, upper(role) AS role_upper, length(trim(text)) AS trimmed_len FROM conversations")
def _(m):
    return m.raw("conversations").select(
        "conv_id", "turn", X.zero_padded(F.col("conv_id"), 8).alias("padded"),
        X.id_prefix(F.concat_ws("_", "role", F.col("turn").cast("string"))).alias("prefix"),
        F.endswith("role", F.lit("user")).alias("is_user"), F.upper("role").alias("role_upper"), F.length(F.trim("text")).alias("trimmed_len"),
    )


@query("X5_array_helpers", "dac profile_idx n_unique# area~3 mean_temp~ coldest# first_rank# clipped_max~2",
       """SELECT dac, profile_idx, count(*) AS n_unique, sum((temp + t1) / 2 * (pres - p1)) AS area, avg(temp) AS mean_temp,
 arg_min(i, (temp, i)) AS coldest, arg_min(i, (temp, i)) AS first_rank, max(least(temp, 20.0E0)) AS clipped_max
 FROM (SELECT *, row_number() OVER (PARTITION BY dac, profile_idx ORDER BY pres) - 1 AS i FROM t_gt) GROUP BY 1, 2""")
def _(m):
    unique = profiles.unique_pressures(profiles.with_density(profiles.valid_levels(m("levels"))))
    p = unique.groupBy("dac", "profile_idx").agg(F.array_sort(F.collect_list(F.struct("pres", "temp"))).alias("lv"))
    pres, temp = F.col("lv.pres"), F.col("lv.temp")
    return p.select(
        "dac", "profile_idx", F.size(A.array_unique_sorted(pres)).alias("n_unique"), A.array_trapezoid(temp, pres).alias("area"),
        A.array_mean(temp).alias("mean_temp"), A.array_argmin(temp).alias("coldest"), A.array_argsort(temp)[0].alias("first_rank"),
        F.array_max(A.array_clip(temp, -5.0, 20.0)).alias("clipped_max"),
    )
