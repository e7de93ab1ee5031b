"""The whole run: fields, profiles, detection, confidence, analysis. Products are written once and
read back from there, so a lost executor repeats one table, not the run."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import detect, events, fields, forecast, grid, profiles as V, regions, sampling, seasonal, series
from ..session import size_shuffles
from ..sources import sinks


#: Variables of each product that are held against their bounds.
CHECKED = {
    "wind_stress": ["wind_speed", "tau_x", "tau_y", "ekman_x", "ekman_y"],
    "qnet": ["qnet"],
    "sst_anomaly": ["sst", "sst_anomaly"],
    "profile_physics": ["mld", "thermocline", "sst_argo"],
}
#: Grids that are also kept in the layout for single days.
BY_DAY = ("wind_stress", "qnet", "sst_anomaly")


#: Columns that the product of the wind adds to the surface, and that of the temperature to its grid.
ADDED = {"wind_speed", "tau_x", "tau_y", "tau_mag", "ekman_x", "ekman_y", "year"}
ADDED_SST = {"sst_clim", "sst_anomaly", "year"}


def _given(grid, product, added):
    """The rows of an input from the product that keeps them all, so that the input is computed once.

    An input that itself has a column the product adds is read again.
    """
    return grid if added & set(grid.columns) else product.select(*grid.columns)


def run_physics(base, sst, surface, levels, heads):
    spark = sst.sparkSession
    sinks.write_grid(fields.ekman_transport(fields.wind_fields(surface)), f"{base}/wind_stress")
    sinks.write_grid(fields.qnet_dataset(_given(surface, spark.read.parquet(f"{base}/wind_stress"), ADDED)), f"{base}/qnet")
    sinks.write_grid(fields.sst_dataset(sst), f"{base}/sst_anomaly")
    sinks.write_result(V.profile_physics(levels, heads), f"{base}/profile_physics")
    out = {n: spark.read.parquet(f"{base}/{n}") for n in CHECKED}
    checks = [grid.range_check(out[n], variables).select(F.lit(n).alias("product"), "*") for n, variables in CHECKED.items()]
    sinks.write_result(reduce(lambda a, b: a.unionByName(b), checks), f"{base}/range_checks")
    return {**out, "range_checks": spark.read.parquet(f"{base}/range_checks")}


def run_layout(base, physics):
    """The grids once more, clustered for reading single days, and a report of pieces and rows before and after."""
    report = sinks.relayout_all({n: physics[n] for n in BY_DAY}, f"{base}/by_day")
    sinks.write_result(report, f"{base}/layout_report")
    spark = report.sparkSession
    return {"layout_report": spark.read.parquet(f"{base}/layout_report"), **{f"{n}_by_day": spark.read.parquet(f"{base}/by_day/{n}") for n in BY_DAY}}


def run_detection(base, sst, indices, physics):
    spark = sst.sparkSession
    anomaly = grid.spatial_mean(physics["sst_anomaly"], {"sst_mean": "sst_anomaly"})
    qnet = grid.spatial_mean(physics["qnet"], {"qnet_mean": "qnet"})
    wind = grid.spatial_mean(physics["wind_stress"], {"ws_mean": "wind_speed"})
    sinks.write_result(detect.heatwave_confidence(detect.heatwave_days(sst, indices)), f"{base}/mhw_timeseries")
    sinks.write_result(detect.unusual_mixed_layers(physics["profile_physics"], indices), f"{base}/unusual_mld")
    sinks.write_result(detect.rapid_confidence(detect.rapid_changes(anomaly, qnet, wind, indices)), f"{base}/rapid_changes")
    trends = detect.long_term_trends(detect.trend_inputs(anomaly, qnet, physics["profile_physics"]))
    sinks.write_result(series.trend_confidence(trends), f"{base}/trends")
    return {n: spark.read.parquet(f"{base}/{n}") for n in ("mhw_timeseries", "unusual_mld", "rapid_changes", "trends")}


def run_uncertainty(base, sst, sla, physics, days):
    spark = sst.sparkSession
    sinks.write_result(V.with_confidence(physics["profile_physics"]), f"{base}/profile_uncertainty")
    sinks.write_result(sampling.sparsity_scores(physics["profile_physics"]), f"{base}/sparsity_scores")
    sinks.write_result(grid.daily_coverage(sst, "sst"), f"{base}/sst_coverage")
    sinks.write_result(grid.grid_uncertainty(sst, physics["qnet"], physics["wind_stress"], sla), f"{base}/grid_uncertainty")
    out = {n: spark.read.parquet(f"{base}/{n}") for n in ("profile_uncertainty", "sparsity_scores", "sst_coverage", "grid_uncertainty")}
    summary = sampling.uncertainty_summary(out["profile_uncertainty"], out["grid_uncertainty"], days)
    sinks.write_result(summary, f"{base}/uncertainty_summary")
    return {**out, "uncertainty_summary": spark.read.parquet(f"{base}/uncertainty_summary")}


def run_analysis(base, indices, physics, detected, certain):
    spark = indices.sparkSession
    days, profiles = detected["mhw_timeseries"], certain["profile_uncertainty"]
    sinks.write_result(events.heatwave_events(days), f"{base}/mhw_events")
    sinks.write_result(seasonal.seasonal_climatology(profiles), f"{base}/seasonal_climatology")
    sinks.write_result(seasonal.with_seasonal_anomaly(profiles), f"{base}/profiles_with_seasonal_anom")
    sinks.write_result(regions.basin_metrics(spark, profiles, physics["sst_anomaly"]), f"{base}/basin_metrics")
    sinks.write_result(seasonal.stratification_months(profiles, indices), f"{base}/stratification_trend")
    sinks.write_forecast(forecast.forecast_indicator(days, detected["rapid_changes"]), f"{base}/mhw_forecast")
    names = ("mhw_events", "seasonal_climatology", "profiles_with_seasonal_anom", "basin_metrics", "stratification_trend")
    out = {n: spark.read.parquet(f"{base}/{n}") for n in names}
    out["mhw_forecast"] = spark.read.json(f"{base}/mhw_forecast")
    return out


def run_all(base, sst, surface, sla, levels, heads, indices, input_bytes=None):
    """All products in order; returns every table. ``input_bytes`` sizes the shuffles of the run."""
    if input_bytes:
        size_shuffles(sst.sparkSession, input_bytes)
    physics = run_physics(base, sst, surface, levels, heads)
    sst = _given(sst, physics["sst_anomaly"], ADDED_SST)
    detected = run_detection(base, sst, indices, physics)
    certain = run_uncertainty(base, sst, sla, physics, detected["mhw_timeseries"])
    analysed = run_analysis(base, indices, physics, detected, certain)
    yearly = sinks.write_all_years({n: detected[n] for n in ("mhw_timeseries", "rapid_changes", "unusual_mld")}, f"{base}/by_year")
    return {**physics, **detected, **certain, **analysed, **run_layout(base, physics), **{f"{n}_by_year": t for n, t in yearly.items()}}


def product_counts(tables, summed=None):
    """Rows per product and the sum of its column in ``summed``, if it has one; one row each."""
    value = lambda n: F.sum(F.col(summed[n])) if n in (summed or {}) else F.lit(None)
    counts = [
        t.agg(F.lit(n).alias("product"), F.count(F.lit(1)).alias("n_rows"), value(n).cast("double").alias("total"))
        for n, t in sorted(tables.items())
    ]
    return reduce(lambda a, b: a.unionByName(b), counts)

