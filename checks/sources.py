"""Sources and sinks."""

from pyspark.sql import functions as F

from halocline.operators import detect, forecast, grid
from halocline.session import shared_dir
from halocline.sources import sinks, tables

from . import frames
from .common import query

GRID = "time$ lat lon sst~4"


@query("S1_read_grid", GRID, "SELECT * FROM t_grid")
def _(m):
    path = shared_dir(m.spark, "grid")
    sinks.write_grid(m("grid"), path)
    return tables.read_grid(m.spark, path, ["time", "lat", "lon", "sst"])


@query("S1_canonical_grid", "time$ lat lon u10~4 v10~4",
       "SELECT time, lat, lon, CASE WHEN u10 > 8 THEN NULL ELSE u10 END AS u10, v10 FROM t_surface")
def _(m):
    foreign = m("surface").withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    foreign = foreign.withColumn("u10", F.when(F.col("u10") > 8, F.lit(float("nan"))).otherwise(F.col("u10")))
    return tables.canonical(foreign.withColumn("zlev", F.lit(0.0)))


@query("S2_read_profiles", "dac n# n_profiles# sum_temp~3",
       "SELECT dac, count(*) AS n, count(DISTINCT profile_idx) AS n_profiles, sum(temp) AS sum_temp FROM t_levels GROUP BY dac")
def _(m):
    path = shared_dir(m.spark, "levels")
    m("levels").write.partitionBy("dac").parquet(path)
    return tables.read_profiles(m.spark, path).groupBy("dac").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("profile_idx").alias("n_profiles"), F.sum("temp").alias("sum_temp")
    )


@query("S3_read_result", "date$ frac_mhw~ is_mhw", "SELECT * FROM t_days")
def _(m):
    path = shared_dir(m.spark, "result")
    sinks.write_result(frames.days(m), path)
    return tables.read_result(m.spark, path, "date date, frac_mhw double, is_mhw boolean")


@query("S4_read_indices", "date$ enso~ dmi~ pdo~", "SELECT * FROM t_idx")
def _(m):
    path = shared_dir(m.spark, "indices")
    sinks.write_result(m("indices"), path)
    return tables.read_indices(m.spark, path)


@query("S5_read_years", "date$ frac_mhw~", "SELECT * FROM t_days WHERE year(date) IN (1996, 1997)")
def _(m):
    path = shared_dir(m.spark, "years")
    sinks.write_years(frames.days(m), path)
    return tables.read_years(m.spark, path, [1996, 1997])


def upload_folder(m):
    path = shared_dir(m.spark, "csv")
    rows = m("profiles").select(
        F.when(F.col("profile_idx") % 7 == 0, "no date").otherwise(F.date_format("time", "yyyy-MM-dd HH:mm:ss")).alias("time"),
        "lat", "lon", F.lit(None).cast("double").alias("sst_argo"), F.lit(None).cast("double").alias("mld"),
        F.lit(None).cast("double").alias("ohc_700m"),
    )
    rows.write.option("header", True).csv(path)
    return path


UPLOADED = "SELECT CASE WHEN profile_idx % 7 <> 0 THEN time END AS time, lat, lon FROM t_profiles"


@query("S6_read_csv_upload", "time$ lat~2 lon~2", UPLOADED)
def _(m):
    return tables.parse_time(tables.read_upload(m.spark, upload_folder(m)))


@query("S7_first_existing_table", "dac profile_idx lat~2 lon~2", "SELECT * FROM t_profiles")
def _(m):
    m("profiles").createOrReplaceTempView("halocline_profiles")
    return tables.first_existing(m.spark, ["halocline_missing", "halocline_profiles"])[0]


@query("S8_date_range", "min_date$ max_date$", "SELECT min(time) AS min_date, max(time) AS max_date FROM t_grid")
def _(m):
    return grid.date_range(m("grid"))


@query("S9_preview", "n_rows# columns n_head#",
       "SELECT count(*) AS n_rows, 'dac, profile_idx, lat, lon, time' AS columns, least(5, count(*)) AS n_head FROM t_profiles")
def _(m):
    return tables.preview(m("profiles")).withColumn("n_head", F.size("head"))


@query("S10_read_state", "dataset last_time$",
       "SELECT 'mhw' AS dataset, max(CAST(time AS TIMESTAMP)) AS last_time FROM t_grid UNION ALL SELECT 'rapid', min(CAST(time AS TIMESTAMP)) FROM t_grid")
def _(m):
    path = shared_dir(m.spark, "state")
    low, high = (str(v) for v in grid.date_range(m("grid")).first())
    sinks.save_mark(m.spark, path, "mhw", low)
    sinks.save_mark(m.spark, path, "mhw", high)
    sinks.save_mark(m.spark, path, "rapid", low)
    return tables.read_state(m.spark, path)


PER_YEAR = "SELECT year(time) AS year, count(*) AS n FROM t_grid GROUP BY 1"


@query("K1_write_grid", "year n#", PER_YEAR)
def _(m):
    path = shared_dir(m.spark, "grid")
    sinks.write_grid(m("grid"), path)
    return m.spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("K2_write_result", "variable slope_per_year~3 r2~ n_months#",
       "SELECT CASE variable WHEN 'OHC_700m' THEN 'OHC_700m' ELSE variable END AS variable, CASE WHEN variable = 'OHC_700m' THEN slope_per_year / 1e6 ELSE slope_per_year END AS slope_per_year, r2, n_months FROM t_trends")
def _(m):
    path = shared_dir(m.spark, "trends")
    sinks.write_result(frames.trends(m), path)
    scaled = F.when(F.col("variable") == "OHC_700m", F.col("slope_per_year") / 1e6).otherwise(F.col("slope_per_year"))
    return tables.read_result(m.spark, path).withColumn("slope_per_year", scaled)


@query("K3_write_years", "year n# overwritten#",
       "SELECT year(date) AS year, count(*) AS n, count(*) FILTER (WHERE year(date) = 1997) AS overwritten FROM t_days GROUP BY 1")
def _(m):
    path = shared_dir(m.spark, "years")
    d = frames.days(m).select("date", "frac_mhw").withColumn("mark", F.lit(0))
    sinks.write_years(d, path)
    sinks.write_years(d.withColumn("mark", F.lit(1)), path)
    newer = d.where(F.year("date") == 1997).withColumn("mark", F.lit(2))
    stored = sinks.write_years(newer, path, overwrite=True)
    return stored.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mark") == 2).alias("overwritten"))


@query("K4_write_all_years", "name year n#",
       """SELECT 'mhw_timeseries' AS name, year(date) AS year, count(*) AS n FROM t_days GROUP BY 2
 UNION ALL SELECT 'rapid_changes', year(date), count(*) FROM t_rapid GROUP BY 2
 UNION ALL SELECT 'unusual_mld', year(time), count(*) FROM t_argo WHERE mld IS NOT NULL GROUP BY 2""")
def _(m):
    given = {
        "mhw_timeseries": frames.days(m), "rapid_changes": frames.rapid(m),
        "unusual_mld": detect.unusual_mixed_layers(frames.argo(m), m("indices")),
    }
    stored = sinks.write_all_years(given, shared_dir(m.spark, "all_years"))
    counts = [t.groupBy("year").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(n)) for n, t in stored.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("K5_write_forecast_json", "risk_level as_of_date enso n_historical_days#",
       """SELECT risk_level, as_of_date, enso, n_historical_days FROM t_forecast""")
def _(m):
    path = shared_dir(m.spark, "forecast")
    sinks.write_forecast(forecast.forecast_indicator(frames.mhw(m), frames.rapid(m)), path)
    return m.spark.read.json(path).withColumn("enso", F.col("current_phase.enso"))


@query("K6_append_upload", "dac profile_idx time$ lat~2 lon~2",
       """SELECT dac, profile_idx, time, lat, lon FROM t_profiles
 UNION ALL SELECT NULL, NULL, time, lat, lon FROM t_profiles WHERE profile_idx % 7 <> 0""")
def _(m):
    existing = m("profiles").withColumn("time", F.col("time").cast("timestamp"))
    return sinks.append_upload(existing, tables.read_upload(m.spark, upload_folder(m)))


@query("K6_write_upload", "time$ lat~2 lon~2", "SELECT time, lat, lon FROM t_profiles WHERE profile_idx % 7 <> 0")
def _(m):
    path = shared_dir(m.spark, "uploads")
    sinks.write_upload(tables.read_upload(m.spark, upload_folder(m)), path)
    return m.spark.read.parquet(path)


@query("K7_save_mark", "dataset last_time$", "SELECT 'sst' AS dataset, CAST(max(time) AS TIMESTAMP) AS last_time FROM t_grid")
def _(m):
    path = shared_dir(m.spark, "state")
    sinks.save_mark(m.spark, path, "sst", str(grid.date_range(m("grid")).first()["max_date"]))
    return tables.read_state(m.spark, path, "sst")


@query("K8_relayout", "state mode clustered_by n_rows#",
       """SELECT s AS state, 'spatial_mean' AS mode, 'lat,lon,time' AS clustered_by, (SELECT count(*) FROM t_grid) AS n_rows
 FROM (VALUES ('before'), ('after')) AS v(s)""")
def _(m):
    return sinks.relayout(m("grid"), shared_dir(m.spark, "layout"), "spatial_mean")


@query("K8_relayout_all", "table_name state clustered_by n_rows#",
       """SELECT 'sst' AS table_name, 'before' AS state, 'time,lat,lon' AS clustered_by, count(*) AS n_rows FROM t_grid
 UNION ALL SELECT 'surface', 'before', 'time,lat,lon', count(*) FROM t_surface""")
def _(m):
    return sinks.relayout_all({"sst": m("grid"), "surface": m("surface")}, "", dry_run=True)


@query("U1_union_stores", "dac profile_idx lat~2 note", "SELECT dac, profile_idx, lat, CASE WHEN dac = 'dac1' THEN 'b' END AS note FROM t_profiles")
def _(m):
    p = m("profiles").select("dac", "profile_idx", "lat")
    return sinks.union_stores([p.where("dac <> 'dac1'"), None, p.where("dac = 'dac1'").withColumn("note", F.lit("b"))])


MERGED = """SELECT date, frac_mhw, 'old' AS origin FROM t_days WHERE date < (SELECT min(date) FROM t_days WHERE year(date) = 1999)
 UNION ALL SELECT date, frac_mhw, 'new' FROM t_days WHERE year(date) = 1999"""


@query("U2_merge_from_cutoff", "date$ frac_mhw~ origin", MERGED)
def _(m):
    d = frames.days(m).select("date", "frac_mhw")
    return sinks.merge_from_cutoff(d.withColumn("origin", F.lit("old")), d.where(F.year("date") == 1999).withColumn("origin", F.lit("new")))
