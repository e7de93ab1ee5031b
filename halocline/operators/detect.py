"""Detection of heatwave days, unusual mixed layers and rapid changes, with confidence."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import bin_floor, flag, to_unit
from . import context, fields, grid, series, thresholds


def heatwave_days(sst, indices, q=0.9, keep_empty=False, backfill=False, half_window=None):
    """Daily heatwave table: cell quantile, intensity, daily metrics, climate phases, persistence.

    One shuffle of the grid, by cell; the daily metrics are combined before the second one. With
    ``half_window`` the threshold follows the season: the quantile over so many days of the year on
    either side, in place of the whole record.
    """
    if half_window is None:
        hot = grid.with_intensity(sst, "sst", q)
    else:
        hot = thresholds.with_seasonal_intensity(sst, "sst", q, half_window)
    daily = grid.daily_heatwave_metrics(hot, keep_empty=keep_empty)
    return series.with_persistence(context.with_climate(daily, indices), backfill=backfill)


def cell_month(df):
    return df.withColumns(
        {
            "month": F.month("time"),
            "lat_bin": bin_floor(F.col("lat")),
            "lon_bin": bin_floor(F.col("lon")),
        }
    )


def mixed_layer_climatology(profiles):
    """Mean, spread and count of the mixed layer per 2-degree cell and month."""
    return cell_month(profiles.dropna(subset=["time", "mld", "lat", "lon"])).groupBy("lat_bin", "lon_bin", "month").agg(
        F.avg("mld").alias("mld_clim"), F.stddev_samp("mld").alias("mld_std"), F.count("mld").alias("n")
    )


def standard_score(value, mean, std):
    return F.try_divide(F.col(value) - F.col(mean), F.when(F.col(std) != 0, F.col(std)))


def unusual_mixed_layers(profiles, indices, bound=2.0):
    """Profiles whose mixed layer lies more than ``bound`` deviations from its cell and month.

    The climatology is aggregated map-side and joined back, so a crowded cell is not gathered in one
    window; the join splits skewed cells.
    """
    kept = cell_month(profiles.dropna(subset=["time", "mld", "lat", "lon"]))
    clim = mixed_layer_climatology(profiles).drop("n")
    scored = kept.join(clim, ["lat_bin", "lon_bin", "month"]).withColumns(
        {
            "mld_anom": F.col("mld") - F.col("mld_clim"),
            "mld_zscore": standard_score("mld", "mld_clim", "mld_std"),
        }
    )
    z = F.col("mld_zscore")
    flagged = scored.withColumns(
        {
            "mld_unusual_deep": flag(z > bound),
            "mld_unusual_shallow": flag(z < -bound),
            "mld_unusual": flag(F.abs(z) > bound),
        }
    )
    return context.profiles_with_climate(flagged, indices)


def rapid_changes(anomaly_daily, qnet_daily, wind_daily, indices):
    """Seven-row changes of three daily series, flagged against their own quantiles."""
    sst = series.with_change(anomaly_daily, "sst_mean", "sst_change7d")
    qnet = series.with_change(qnet_daily, "qnet_mean", "qnet_change7d")
    wind = series.with_change(wind_daily, "ws_mean", "ws_change7d")

    def limits(df, c):
        return df.agg(F.struct(F.percentile(c, 0.95).alias("high"), F.percentile(c, 0.05).alias("low"))).scalar()

    joined = series.align_on(sst, [qnet, wind]).withColumns(
        {"_s": limits(sst, "sst_change7d"), "_q": limits(qnet, "qnet_change7d"), "_w": limits(wind, "ws_change7d")}
    )
    flagged = joined.withColumns(
        {
            "rapid_sst_rise": flag(F.col("sst_change7d") > F.col("_s.high")),
            "rapid_sst_drop": flag(F.col("sst_change7d") < F.col("_s.low")),
            "rapid_qnet_swing": flag(F.abs("qnet_change7d") > F.abs("_q.high")),
            "rapid_wind": flag(F.col("ws_change7d") > F.col("_w.high")),
        }
    ).drop("_s", "_q", "_w")
    return context.with_climate(flagged, indices, ("enso_phase", "iod_phase"))


def rapid_inputs(sst, surface):
    """The three daily means that ``rapid_changes`` compares."""
    anomaly = grid.spatial_mean(fields.sst_dataset(sst), {"sst_mean": "sst_anomaly"})
    air = grid.spatial_mean(
        fields.heat_flux(fields.wind_fields(surface)), {"qnet_mean": "qnet", "ws_mean": "wind_speed"}
    )
    return anomaly, air.select("date", "qnet_mean"), air.select("date", "ws_mean")


def heatwave_confidence(days):
    """Signal over noise with a bonus for persistence."""
    d = series.with_recent_share(days, "is_mhw", "mhw_persistence")
    noise = F.col("mean_intensity") / F.lit(K.SST_NOISE)
    return d.withColumns(
        {
            "mhw_signal_noise": noise,
            "mhw_confidence": to_unit(0.7 * to_unit(noise / (noise + 1)) + 0.3 * F.col("mhw_persistence")),
        }
    )


def rapid_confidence(rapid):
    size = F.abs("sst_change7d")
    hit = F.col("rapid_sst_rise") | F.col("rapid_sst_drop")
    return rapid.withColumn("rapid_confidence", F.when(hit, to_unit(size / (size + F.lit(K.SST_NOISE)))))


def long_term_trends(monthly, min_rows=6):
    """Trends of many monthly series in one pass; ``monthly`` is (variable, month_end, value)."""
    return series.linear_trend(monthly, "value", "month_end", ["variable"], min_rows).select(
        "variable", "slope_per_year", "r2", "n_months"
    )


def trend_inputs(anomaly_daily, qnet_daily, profiles):
    """Monthly means of the four trended variables as one long table."""

    def long(df, name, value, time):
        m = series.resample_month(df.where(F.col(time).isNotNull()), [value], time)
        return m.select(F.lit(name).alias("variable"), "month_end", F.col(value).alias("value"))

    water = (
        profiles.where(F.col("time").isNotNull())
        .select(F.to_date("time").alias("date"), F.col("ohc_700m").alias("OHC_700m"), F.col("mld").alias("MLD"))
        .groupBy(series.month_end("date").alias("month_end"))
        .agg(F.avg("OHC_700m").alias("OHC_700m"), F.avg("MLD").alias("MLD"))
        .unpivot("month_end", ["OHC_700m", "MLD"], "variable", "value")
        .select("variable", "month_end", "value")
    )
    return (
        long(anomaly_daily, "SST anomaly", "sst_mean", "date")
        .unionByName(long(qnet_daily, "Qnet", "qnet_mean", "date"))
        .unionByName(water.where("value is not null"))
    )
