"""Heatwave events from the daily table."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def with_event_start(days, keys=(), time="date", condition="is_mhw"):
    """Flagged rows with the number of their run of consecutive flagged rows."""
    w = Window.partitionBy(*keys).orderBy(time)
    begins = F.col(condition) & ~F.coalesce(F.lag(condition).over(w), F.lit(False))
    return days.withColumn("event_id", F.sum(begins.cast("int")).over(w)).where(F.col(condition))


def summarise_events(flagged, keys=(), confidence=None, rounded=True):
    """One row per event: extent, peak (first on ties), means, heat and dominant phases."""
    heat = F.sum(F.col("mean_intensity") * F.col("frac_mhw"))
    trust = F.avg(confidence) if confidence else F.lit(0.5)
    peak = F.struct(F.col("max_intensity"), -F.datediff("date", F.lit("1970-01-01").cast("date")))
    return flagged.groupBy(*keys, "event_id").agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count(F.lit(1)).alias("duration_days"),
        F.max_by("date", peak).alias("peak_date"),
        F.max("max_intensity").alias("peak_intensity"),
        F.avg("mean_intensity").alias("mean_intensity"),
        (F.max("frac_mhw") * 100).alias("peak_coverage"),
        (F.round(heat, 4) if rounded else heat).alias("accumulated_heat"),
        F.max_by("mhw_category", peak).alias("peak_category"),
        F.coalesce(F.mode("enso_phase", True), F.lit("unknown")).alias("dominant_enso"),
        F.coalesce(F.mode("iod_phase", True), F.lit("unknown")).alias("dominant_iod"),
        (F.round(trust, 3) if rounded else trust).alias("mean_confidence"),
    )


def heatwave_events(days, keys=(), confidence=None, rounded=True):
    if confidence is None and "mhw_confidence" in days.columns:
        confidence = "mhw_confidence"
    return summarise_events(with_event_start(days, keys), keys, confidence, rounded)


def filter_events(events, min_duration=5, category=None):
    kept = events.where(F.col("duration_days") >= min_duration)
    return kept if category is None else kept.where(F.col("peak_category") == category)


def order_events(events, sort="date"):
    column = {"intensity": "peak_intensity", "duration": "duration_days"}.get(sort, "start_date")
    return events.orderBy(F.desc_nulls_last(column), F.desc("start_date"))


def yearly_events(events, min_duration=5):
    """Event count and mean duration per start year; a category filter does not apply here."""
    return filter_events(events, min_duration).groupBy(F.year("start_date").alias("year")).agg(
        F.count("event_id").alias("count"), F.round(F.avg("duration_days"), 1).alias("avg_duration")
    )
