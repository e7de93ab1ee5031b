"""Overlapping basin boxes: assignment, metrics and ranking.

Membership is an array of box names computed per row, then exploded: no join, and a row yields one
row per box that holds it (at most six). Empty basins come back from the box table at the end.
"""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.labels import basins_of
from ..functions.numeric import round_significant
from . import grid, series


def box_table(spark):
    return spark.createDataFrame(
        K.BASIN_BOXES, "basin string, lat_min double, lat_max double, lon_min double, lon_max double"
    )


def in_basins(df, lat="lat", lon="lon"):
    return df.withColumn("basin", F.explode(basins_of(F.col(lat), F.col(lon))))


def basin_heatwaves(anomaly_grid, value="sst_anomaly"):
    """Heatwave days and peak intensity per basin, each cell against its own quantile."""
    daily = grid.daily_heatwave_metrics(
        in_basins(grid.with_intensity(anomaly_grid, value)), keys=["basin"], keep_empty=True
    )
    flagged = series.with_persistence(daily, keys=["basin"])
    peak = F.max(F.when(F.col("frac_mhw").isNotNull(), F.col("max_intensity")))
    return flagged.groupBy("basin").agg(
        F.count_if(F.col("is_mhw")).alias("mhw_days"), F.round(peak, 3).alias("peak_mhw_intensity")
    )


def basin_heatwaves_of(sst):
    """``basin_heatwaves`` from the plain grid: anomaly and quantile share one placement by cell."""
    return basin_heatwaves(grid.with_anomaly(grid.by_cell(sst), "sst", "sst_anomaly"))


MEASURES = ["sst_argo", "mld", "ohc_700m", "confidence"]


def basin_months(profiles):
    """Sums and counts per basin and month: the one pass over the profiles that all metrics use."""
    return in_basins(profiles).groupBy("basin", series.month_end("time").alias("month_end")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"{c}_sum") for c in MEASURES],
        *[F.count(c).alias(f"{c}_n") for c in MEASURES],
    )


def mean_of(column):
    return F.try_divide(F.sum(f"{column}_sum"), F.sum(f"{column}_n"))


def basin_trends(profiles, min_months=4):
    return month_trends(basin_months(profiles), min_months)


def month_trends(months, min_months=4):
    monthly = months.where(F.col("month_end").isNotNull() & (F.col("sst_argo_n") > 0)).withColumn(
        "sst", F.col("sst_argo_sum") / F.col("sst_argo_n")
    )
    return series.linear_trend(monthly, "sst", "month_end", ["basin"], min_months).select(
        "basin", F.round("slope_per_year", 4).alias("sst_trend_per_yr")
    )


def basin_metrics(spark, profiles, anomaly_grid):
    """One row per basin; basins without profiles keep their row with a count of 0."""
    return _metrics_beside(spark, profiles, basin_heatwaves(anomaly_grid))


def basin_metrics_of(spark, profiles, sst):
    """``basin_metrics`` from the plain grid: anomaly and quantile share one placement by cell."""
    return _metrics_beside(spark, profiles, basin_heatwaves_of(sst))


def _metrics_beside(spark, profiles, heatwaves):
    months = basin_months(profiles)
    means = months.groupBy("basin").agg(
        F.sum("n").alias("n"),
        F.round(mean_of("sst_argo"), 3).alias("mean_sst"),
        F.round(mean_of("mld"), 2).alias("mean_mld"),
        round_significant(mean_of("ohc_700m"), 4).alias("mean_ohc_700m"),
        F.round(mean_of("confidence"), 3).alias("mean_confidence"),
    )
    by_month = months.where("month_end is not null").groupBy("basin", F.month("month_end").alias("month")).agg(
        mean_of("sst_argo").alias("m")
    )
    season = by_month.groupBy("basin").agg(
        F.when(F.count("m") >= 6, F.round(F.max("m") - F.min("m"), 3)).alias("sst_seasonal_range")
    )
    table = box_table(spark)
    for part in (means, season, month_trends(months), heatwaves):
        table = table.join(part, "basin", "left")
    n = F.coalesce("n", F.lit(0))
    only_sampled = {
        c: F.when(n > 0, F.col(c)) for c in ("lat_min", "lat_max", "lon_min", "lon_max", "peak_mhw_intensity")
    }
    only_sampled["mhw_days"] = F.when(n > 0, F.coalesce("mhw_days", F.lit(0)))
    return table.withColumns(only_sampled).withColumn("n_profiles", n).drop("n")


def rank_basins(metrics):
    return metrics.orderBy(F.desc_nulls_last("sst_trend_per_yr"), "basin")


def basin_table(current):
    """Count and means of current positions per basin, with the overall row (basin NULL)."""
    return current.groupingSets([["basin"], []], "basin").agg(
        F.count(F.lit(1)).alias("n_floats"),
        F.avg("sst_argo").alias("mean_sst"),
        F.avg("mld").alias("mean_mld"),
        F.avg("confidence").alias("mean_confidence"),
        F.count_distinct("basin").alias("n_basins"),
    )
