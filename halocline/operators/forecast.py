"""Thirty-day heatwave probability from the daily table."""

from pyspark.sql import functions as F

from ..functions.labels import risk_level
from ..functions.numeric import clip, count_true, to_unit
from . import series


def phase_frequency(days):
    """Share of heatwave days under the newest ENSO and IOD phases: both, else ENSO only, else 0.3."""
    now = days.agg(F.max_by(F.struct("enso_phase", "iod_phase", "pdo_phase", "date"), "date").alias("now"))
    tagged = days.withColumn("_now", now.scalar())
    enso = F.col("enso_phase") == F.col("_now.enso_phase")
    both = enso & (F.col("iod_phase") == F.col("_now.iod_phase"))
    hot = F.col("is_mhw").cast("int")
    freq = tagged.agg(
        F.first("_now").alias("now"),
        F.avg(F.when(both, hot)).alias("both"),
        F.avg(F.when(enso, hot)).alias("enso"),
        count_true(both).alias("n_both"),
        count_true(enso).alias("n_enso"),
    )
    return freq.select(
        "now",
        F.coalesce("both", "enso", F.lit(0.3)).alias("frequency"),
        F.when(F.col("n_both") > 0, F.col("n_both")).otherwise(F.col("n_enso")).alias("n_days"),
    )


def onset_factor(rapid, rows=14):
    rises = series.tail_rows(rapid, rows).agg(count_true(F.col("rapid_sst_rise")).alias("n_rises"))
    return rises.select("n_rises", F.least(F.col("n_rises") * F.lit(0.05), F.lit(0.15)).alias("onset"))


def trend_factor(days, rows=30):
    change = series.mean_recent_change(days, "mean_intensity", rows)
    return change.select(
        "mean_change", F.coalesce(clip(F.col("mean_change") / 0.05, -0.2, 0.2), F.lit(0.0)).alias("trend")
    )


def forecast_indicator(days, rapid):
    """One row: probability, risk level, phases, factors and a short summary."""
    parts = phase_frequency(days).withColumns(
        {
            "_t": trend_factor(days).select(F.struct("mean_change", "trend").alias("s")).scalar(),
            "_o": onset_factor(rapid).select("onset").scalar(),
        }
    )
    f, t, o = F.col("frequency"), F.col("_t.trend"), F.col("_o")
    p = to_unit(0.50 * f + 0.30 * (0.5 + t) + 0.20 * (0.5 + o))
    summary = F.format_string(
        "risk=%s p=%.2f; phases %s/%s: %.0f%% of %d days; trend %+.4f per day; onset factor %.4f",
        risk_level(p), p, F.col("now.enso_phase"), F.col("now.iod_phase"), f * 100, F.col("n_days"),
        F.coalesce(F.col("_t.mean_change"), F.lit(0.0)), F.coalesce(o, F.lit(0.0)),
    )
    return parts.select(
        F.round(p, 3).alias("probability"),
        risk_level(p).alias("risk_level"),
        F.struct(
            F.col("now.enso_phase").alias("enso"), F.col("now.iod_phase").alias("iod"), F.col("now.pdo_phase").alias("pdo")
        ).alias("current_phase"),
        F.round(f, 3).alias("phase_frequency"),
        F.round(t, 4).alias("trend_factor"),
        F.round(o, 4).alias("onset_factor"),
        F.col("n_days").alias("n_historical_days"),
        F.date_format("now.date", "yyyy-MM-dd").alias("as_of_date"),
        summary.alias("summary"),
    )
