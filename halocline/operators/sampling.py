"""Sampling effort: counts per cell and month, confidence distributions and summaries."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import bin_floor, count_true
from ..session import written
from .quantiles import exact_quantiles


def sparsity_scores(profiles, reference=1):
    placed = profiles.dropna(subset=["time", "lat", "lon"])
    return placed.groupBy(
        bin_floor(F.col("lat")).alias("lat_bin"),
        bin_floor(F.col("lon")).alias("lon_bin"),
        F.trunc(F.to_date("time"), "month").alias("year_month"),
    ).agg(F.count(F.lit(1)).alias("n_profiles")).withColumn(
        "sparsity_score", F.least(F.col("n_profiles") / F.lit(float(reference)), F.lit(1.0))
    )


def confidence_distribution(profiles):
    c = F.col("confidence")
    both = F.col("mld").isNotNull() & F.col("thermocline").isNotNull()
    return profiles.agg(
        F.count(F.lit(1)).alias("n_profiles"),
        F.avg(c).alias("mean_confidence"),
        count_true(c >= 0.8).alias("n_high"),
        count_true((c >= 0.5) & (c < 0.8)).alias("n_medium"),
        count_true(c < 0.5).alias("n_low"),
        count_true(F.col("sparse_flag")).alias("n_sparse"),
        count_true(both & (F.col("mld") < F.col("thermocline"))).alias("n_consistent"),
        count_true(both & (F.col("mld") >= F.col("thermocline"))).alias("n_inconsistent"),
    )


def uncertainty_summary(profiles, grid_uncertainty, days):
    """(item, value) rows over profiles, fields and heatwave days."""
    p = profiles.agg(
        F.count(F.lit(1)).cast("double").alias("profiles"),
        F.avg("confidence").alias("mean confidence"),
        count_true(F.col("confidence") >= 0.8).cast("double").alias("high confidence"),
        count_true(F.col("sparse_flag")).cast("double").alias("sparse profiles"),
        F.lit(K.TEMP_ERROR).alias("temperature uncertainty"),
        F.lit(K.MLD_ERROR).alias("mixed layer uncertainty"),
        F.lit(K.OHC_ERROR).alias("heat content uncertainty"),
    )
    items = p.unpivot([], p.columns, "item", "value")
    fields = grid_uncertainty.select(
        F.concat("field", F.lit(" confidence")).alias("item"), F.col("mean_confidence").alias("value")
    )
    heat = days.where("is_mhw").agg(F.avg("mhw_confidence").alias("value")).select(
        F.lit("heatwave confidence").alias("item"), "value"
    )
    return items.unionByName(fields).unionByName(heat)


def column_summary(df, columns):
    """Minimum, maximum, exact median and non-missing count per column."""
    table = written(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "summary")
    long = table.unpivot([], list(columns), "variable", "value")
    stats = long.groupBy("variable").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("value").alias("n_valid")
    )
    median = exact_quantiles(long, "value", [0.5], ["variable"]).select("variable", F.col("quantile").alias("median"))
    return stats.join(median, "variable", "left")


def consistency_rate(profiles):
    """Share of profiles with the mixed layer above the thermocline, and the colour range."""
    full = written(profiles.dropna(subset=["mld", "thermocline", "sst_argo"]).select("mld", "thermocline", "sst_argo"), "consistency")
    q = exact_quantiles(full, "sst_argo", [0.05, 0.95])
    limits = q.agg(
        F.struct(
            F.max(F.when(F.col("prob") < 0.5, F.col("quantile"))).alias("low"),
            F.max(F.when(F.col("prob") > 0.5, F.col("quantile"))).alias("high"),
        )
    ).scalar()
    rate = full.agg(
        F.count(F.lit(1)).alias("n_profiles"),
        (F.avg((F.col("mld") < F.col("thermocline")).cast("int")) * 100).alias("pass_rate"),
    )
    return rate.withColumn("_l", limits).select(
        "n_profiles", "pass_rate", F.col("_l.low").alias("color_low"), F.col("_l.high").alias("color_high")
    )


def recent_statistics(profiles, days=90, mld="median"):
    """Count and means of the profiles of the last ``days`` before the newest one."""
    profiles = written(profiles.select("time", "sst_argo", "mld", "ohc_700m"), "recent")
    newest = profiles.agg(F.max("time")).scalar()
    recent = profiles.where(F.col("time") >= newest - F.expr(f"INTERVAL {days} DAYS"))
    base = recent.agg(
        F.count(F.lit(1)).alias("n_profiles"),
        F.avg("sst_argo").alias("mean_sst"),
        F.avg("mld").alias("mean_mld"),
        F.avg("ohc_700m").alias("mean_ohc"),
    )
    if mld == "mean":
        return base
    median = exact_quantiles(recent, "mld", [0.5]).agg(F.max("quantile")).scalar()
    return base.withColumn("median_mld", median).drop("mean_mld")


def recent_rapid_counts(rapid, days=30):
    newest = rapid.agg(F.max("date")).scalar()
    return rapid.where(F.col("date") >= F.date_sub(newest, days)).agg(
        count_true(F.col("rapid_sst_rise")).alias("sst_rises_30d"),
        count_true(F.col("rapid_sst_drop")).alias("sst_drops_30d"),
    )
