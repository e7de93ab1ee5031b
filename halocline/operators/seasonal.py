"""Month-of-year climatology, anomalies, reshaping and stratification trends."""

from pyspark.sql import functions as F

from ..functions.labels import month_name
from . import context, series

CLIMATE_VARIABLES = ["sst_argo", "mld", "ohc_700m"]
ANOMALY_NAMES = {"sst_argo": "sst_seasonal_anom", "mld": "mld_seasonal_anom", "ohc_700m": "ohc_seasonal_anom"}


def seasonal_climatology(profiles, variables=CLIMATE_VARIABLES):
    """Mean, spread and count per variable and month, long form."""
    dated = profiles.where(F.col("time").isNotNull()).withColumn("month", F.month("time"))
    long = dated.unpivot("month", list(variables), "variable", "value")
    return long.groupBy("variable", "month").agg(
        F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.stddev_samp("value"), 4).alias("std"),
        F.count("value").alias("n"),
    )


def with_seasonal_anomaly(profiles, variables=ANOMALY_NAMES):
    """Each profile minus the mean of its month of the year.

    Twelve month means are kept in one small map per variable and read as a subquery; the profiles
    are not gathered by month.
    """
    dated = profiles.where(F.col("time").isNotNull()).withColumn("month", F.month("time"))
    means = dated.groupBy("month").agg(F.struct(*[F.avg(v).alias(v) for v in variables]).alias("m"))
    lookup = means.agg(F.map_from_entries(F.collect_list(F.struct("month", "m")))).scalar()
    out = dated.withColumn("_m", F.try_element_at(lookup, F.col("month")))
    return out.withColumns({name: F.col(v) - F.col(f"_m.{v}") for v, name in variables.items()}).drop("_m")


def seasonal_wide(climatology):
    """Long climatology to one row per month with month names; missing parts are 0."""
    wide = climatology.groupBy("month").pivot("variable", CLIMATE_VARIABLES).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std")
    )
    zero = F.lit(0.0)
    return wide.select(
        "month",
        month_name(F.col("month")).alias("month_name"),
        F.coalesce("sst_argo_mean", zero).alias("sst_mean"),
        F.coalesce("sst_argo_std", zero).alias("sst_std"),
        F.coalesce("mld_mean", zero).alias("mld_mean"),
        F.coalesce("ohc_700m_mean", zero).alias("ohc_mean"),
    )


def seasonal_direct(profiles, spark):
    """The month table straight from profiles, with a row for every month."""
    zero = F.lit(0.0)
    stats = profiles.where(F.col("time").isNotNull()).groupBy(F.month("time").alias("month")).agg(
        F.round(F.avg("sst_argo"), 5).alias("sst_mean"),
        F.round(F.stddev_samp("sst_argo"), 5).alias("sst_std"),
        F.round(F.avg("mld"), 5).alias("mld_mean"),
        F.round(F.avg("ohc_700m"), 5).alias("ohc_mean"),
    )
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return months.join(stats, "month", "left").select(
        "month",
        month_name(F.col("month")).alias("month_name"),
        *[F.coalesce(c, zero).alias(c) for c in ("sst_mean", "sst_std", "mld_mean", "ohc_mean")],
    )


def stratification_months(profiles, indices):
    """Monthly stratification with the month means of the indices."""
    monthly = series.monthly_statistics(profiles)
    return context.months_with_climate(monthly, indices).withColumn("month", F.month("month_start"))


def stratification_trends(monthly, min_months=4):
    """Trend, fit, direction and mean of both stratification measures."""
    long = monthly.unpivot("month_start", ["mean_N2", "mean_strat"], "variable", "value")
    trend = series.linear_trend(long, "value", "month_start", ["variable"], min_months)
    mean = long.groupBy("variable").agg(F.avg("value").alias("mean"))
    return trend.where("n_months is not null").join(mean, "variable").select(
        "variable",
        "slope_per_year",
        "r2",
        F.when(F.col("slope_per_year") > 0, "increasing").otherwise("decreasing").alias("direction"),
        "n_months",
        "mean",
    )


def peak_month(monthly, value="mean_N2"):
    """Month of the year with the highest mean, the first on ties."""
    by_month = monthly.groupBy(F.month("month_start").alias("month")).agg(F.avg(value).alias("v"))
    return by_month.where("v is not null").agg(F.max_by("month", F.struct("v", -F.col("month"))).alias("peak_month"))
