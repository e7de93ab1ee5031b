"""Query views over the result tables. Each takes tables and returns a DataFrame."""

from functools import reduce

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import labels as L
from ..functions.numeric import finite_or
from ..operators import detect, events, fields, grid, listing, sampling, series


def heatwave_status(days):
    """The newest day of the heatwave table."""
    return series.latest_row(days).select(
        F.col("latest.is_mhw").alias("is_active"),
        F.col("latest.mhw_category").alias("category"),
        L.category_label(F.col("latest.mhw_category")).alias("category_label"),
        F.round("latest.mean_intensity", 4).alias("mean_intensity"),
        F.round("latest.max_intensity", 4).alias("max_intensity"),
        F.round(F.col("latest.frac_mhw") * 100, 4).alias("coverage_pct"),
        F.col("latest.date").alias("date"),
        F.round("latest.mhw_confidence", 4).alias("confidence"),
    )


def climate_status(indices):
    now = series.latest_row(indices.select(F.to_date("time").alias("date"), "enso", "dmi", "pdo"))
    v = now.select(*[finite_or(F.col(f"latest.{c}"), 0.0).alias(c) for c in ("enso", "dmi", "pdo")])
    return v.select(
        "enso", L.enso_phase(F.col("enso")).alias("enso_phase"),
        "dmi", L.iod_phase(F.col("dmi")).alias("iod_phase"),
        "pdo", L.pdo_phase(F.col("pdo")).alias("pdo_phase"),
    )


def dashboard_summary(days, sst, indices, profiles, trends, rapid):
    """One nested row. If profiles have no surface temperature, the newest grid mean is used."""
    grid_sst = grid.at_time(sst).agg(F.avg("sst")).scalar()
    stats = sampling.recent_statistics(profiles)
    argo = stats.select(
        F.struct(
            "n_profiles",
            finite_or(F.when(F.col("mean_sst") != 0, F.col("mean_sst")).otherwise(F.lit(None)), None).alias("argo_sst"),
            finite_or(F.col("median_mld"), 0.0).alias("median_mld"),
            finite_or(F.col("mean_ohc"), 0.0).alias("mean_ohc"),
        ).alias("a")
    ).scalar()
    confidence = profiles.agg(finite_or(F.avg("confidence"), 0.0)).scalar()

    def one(df):
        return df.select(F.struct("*").alias("s")).scalar()

    slopes = listing.first_matches(trends, {"sst_slope": "sst", "ohc_slope": "ohc", "mld_slope": "mld"})
    row = heatwave_status(days).select(F.struct("*").alias("mhw"))
    return row.withColumns({"_a": argo, "_sst": grid_sst}).select(
        "mhw",
        one(climate_status(indices)).alias("climate_indices"),
        F.struct(
            F.col("_a.n_profiles").alias("n_profiles"),
            F.coalesce(F.col("_a.argo_sst"), finite_or(F.col("_sst"), 0.0)).alias("mean_sst"),
            F.col("_a.median_mld").alias("median_mld"),
            F.col("_a.mean_ohc").alias("mean_ohc"),
            confidence.alias("mean_confidence"),
        ).alias("argo"),
        one(slopes.select(*[finite_or(F.col(c), 0.0).alias(c) for c in slopes.columns])).alias("trends"),
        one(sampling.recent_rapid_counts(rapid)).alias("rapid_changes"),
    )


PROFILE_COLUMNS = ["profile_id", "float_id", "time", "latitude", "longitude", "basin", "sst_argo", "mld", "ohc_700m", "confidence", "sparse_flag"]


def profile_rows(df):
    """Rounded output columns of a profile list."""
    rounded = {c: finite_or(F.col(c)) for c in ("latitude", "longitude", "sst_argo", "mld", "ohc_700m", "confidence")}
    extra = [c for c in ("sst_seasonal_anom",) if c in df.columns]
    return df.withColumns({**rounded, **{c: finite_or(F.col(c)) for c in extra}}).select(*PROFILE_COLUMNS, *extra)


def matching_profiles(profiles, search="", basin="", lat=None, lon=None, radius=2.0, date_from=None, date_to=None):
    df = listing.in_basin(listing.search(listing.normalise_profiles(profiles), search), basin)
    if lat is not None and lon is not None:
        df = listing.nearby(df, lat, lon, radius)
    return listing.between_times(df, date_from, date_to)


def profile_list(profiles, number=1, per_page=20, sort="time_desc", lat=None, lon=None, **filters):
    df = matching_profiles(profiles, lat=lat, lon=lon, **filters)
    near = lat is not None and lon is not None
    return profile_rows(listing.page(listing.order_profiles(df, sort, near), number, per_page))


def profile_total(profiles, **filters):
    return matching_profiles(profiles, **filters).agg(F.count(F.lit(1)).alias("total"))


def profile_detail(profiles, profile_id):
    return profile_rows(listing.profile_by_id(listing.normalise_profiles(profiles), profile_id))


def heatwave_event_list(event_table, min_duration=5, category=None, sort="date"):
    kept = events.order_events(events.filter_events(event_table, min_duration, category), sort)
    return kept.withColumns({c: finite_or(F.col(c)) for c in ("peak_intensity", "mean_intensity", "peak_coverage", "accumulated_heat", "mean_confidence")})


def heatwave_series(days, n=365):
    tail = series.tail_rows(listing.normalise_days(days), n)
    return tail.select(
        "date", "is_mhw", F.round("intensity", 3).alias("intensity"),
        L.day_label(F.col("is_mhw"), F.col("intensity")).alias("category"),
    ).orderBy("date")


def heatwave_totals(days, n=365):
    tail = series.tail_rows(listing.normalise_days(days), n)
    total, hot = F.count(F.lit(1)), F.count_if(F.col("is_mhw"))
    return tail.agg(
        total.alias("total_days"), hot.alias("mhw_days"),
        F.round(F.coalesce(F.try_divide(hot, total), F.lit(0.0)), 3).alias("mhw_fraction"),
    )


def calendar(days, n=105 * 7):
    """A filled calendar of the last weeks; absent days are no heatwave days with intensity 0."""
    d = listing.normalise_days(days)
    return series.date_spine(d, "date", n).join(d, "date", "left").select(
        "date", F.coalesce("is_mhw", F.lit(False)).alias("is_mhw"), F.coalesce("intensity", F.lit(0.0)).alias("intensity")
    )


def calendar_totals(cal):
    hot = F.col("is_mhw")
    return cal.agg(
        F.count_if(hot).alias("mhw_days"),
        F.count_if(F.col("intensity") > 3).alias("severe_days"),
        F.greatest(F.coalesce(F.max(F.when(hot, F.col("intensity"))), F.lit(1.0)), F.lit(1.0)).alias("max_intensity"),
    )


def calendar_cells(days):
    """Year, ISO week, weekday (Monday 0), date parts and the category of true heatwave days."""
    return days.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"),
        F.weekofyear("date").alias("week"), F.weekday("date").alias("weekday"), F.dayofyear("date").alias("doy"),
        F.when(F.col("is_mhw"), F.col("mhw_category")).otherwise(0).alias("plot_cat"),
    )


def trend_rows(trends, p_value=0.05):
    slope = F.round(finite_or(F.col("slope_per_year"), None, 5) * 10, 6)
    r2 = F.coalesce(finite_or(F.col("r2"), None, 5), F.lit(0.0))
    return trends.select(
        L.trend_key(F.col("variable")).alias("variable"),
        F.coalesce(slope, F.lit(0.0)).alias("slope_per_decade"),
        r2.alias("r2"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2)), 4).alias("trend_confidence"),
        F.lit(p_value).alias("p_value"),
        L.trend_direction(slope).alias("direction"),
    )


def yearly_metrics(sst, profiles, days):
    """Five yearly metrics side by side; a year appears if any metric has it."""
    daily = grid.spatial_mean(fields.sst_dataset(sst), {"sst": "sst", "sst_anomaly": "sst_anomaly"})
    water = series.resample_year(
        profiles.where(F.col("time").isNotNull()).withColumnRenamed("ohc_700m", "ohc"), ["ohc", "mld"], "time"
    )
    hot = days.where("is_mhw").groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).cast("double").alias("mhw_days"))
    parts = [
        series.resample_year(daily, ["sst", "sst_anomaly"]).unpivot("year", ["sst", "sst_anomaly"], "metric", "value"),
        water.unpivot("year", ["ohc", "mld"], "metric", "value"),
        hot.unpivot("year", ["mhw_days"], "metric", "value"),
    ]
    long = reduce(lambda a, b: a.unionByName(b), parts)
    wide = long.groupBy("year").pivot("metric", ["sst", "sst_anomaly", "ohc", "mld", "mhw_days"]).agg(F.first("value"))
    return wide.withColumn("mhw_days", F.col("mhw_days").cast("int"))


def yearly_stratification(monthly):
    return monthly.groupBy(F.year("month_start").alias("year")).agg(
        F.round(F.avg("mean_N2"), 9).alias("n2_mean"), F.round(F.avg("mean_strat"), 9).alias("strat_mean")
    )


def heat_content_anomaly(yearly):
    """Yearly heat content against its straight line."""
    line = series.fitted_line(yearly.where("ohc is not null"), "ohc", "year", min_rows=1)
    return line.select("year", "ohc", (F.col("ohc") - F.coalesce("fitted", "ohc")).alias("anomaly"))


def sst_heatmap(sst, target=None, stride=1):
    """Points of the day nearest to ``target``, or of the latest one, with anomaly.

    Only rows of the same day of the year enter the climatology; the time axis is one aggregate.
    """
    chosen = sst.agg(F.max("time")).scalar() if target is None else grid.nearest_time(sst, target)
    same_day = sst.where(F.dayofyear("time") == F.dayofyear(chosen))
    day = fields.sst_dataset(same_day).where(F.col("time") == chosen)
    return grid.heatmap_points(day, stride=stride, axes=sst)


def anomaly_frames(sst, frames=None, stride=1):
    return grid.spatial_stride(grid.time_stride(fields.sst_dataset(sst), frames), stride, sst).select(
        "time", "lat", "lon", "sst_anomaly"
    )


def scatter_points(profiles, color_by="sst_argo", max_points=None):
    """All profiles with a value, or at most ``max_points`` if the caller asks for fewer."""
    kept = profiles.dropna(subset=["lat", "lon", color_by])
    if max_points is not None:
        kept = listing.top_sample(kept, ["dac", "profile_idx"], max_points)
    return kept.select("dac", "profile_idx", "lat", "lon", color_by)


def basin_scatter(profiles):
    """Surface temperature against mixed layer by basin."""
    return listing.normalise_profiles(profiles).dropna(subset=["sst_argo", "mld"]).select(
        "basin", "profile_id", F.round("sst_argo", 4).alias("sst_argo"), F.round("mld", 4).alias("mld")
    )


def context_items(days, indices, trends, profiles):
    """The current state as rows (section, item, value, label), for a caller to word.

    Trends have a row each for the slope and for the fit.
    """

    def items(section, row, found):
        made = [
            F.struct(F.lit(section).alias("section"), F.lit(n).alias("item"), v.cast("double").alias("value"), label.alias("label"))
            for n, v, label in found
        ]
        return row.select(F.inline(F.array(*made)))

    none = F.lit(None).cast("string")
    now = heatwave_status(days).select(F.struct("*").alias("s"))
    heat = items("heatwave", now, [
        ("active", F.col("s.is_active").cast("int"), F.date_format("s.date", "yyyy-MM-dd")),
        ("category", F.col("s.category"), F.when(F.col("s.category") == 0, "none").otherwise(F.col("s.category_label"))),
        ("area_percent", F.col("s.coverage_pct"), none),
        ("intensity", F.col("s.mean_intensity"), none),
    ])
    phases = [(n, F.col(n), F.col(phase)) for n, phase in (("enso", "enso_phase"), ("dmi", "iod_phase"), ("pdo", "pdo_phase"))]
    climate = items("climate", climate_status(indices), phases)
    slopes = [
        trends.select(F.lit(section).alias("section"), F.col("variable").alias("item"), F.col(c).alias("value"), none.alias("label"))
        for section, c in (("trend_per_year", "slope_per_year"), ("trend_r2", "r2"))
    ]
    recent = sampling.recent_statistics(profiles, mld="mean").where("n_profiles > 0")
    water = items("profiles", recent, [
        ("number", F.col("n_profiles"), none), ("mean_sst", F.col("mean_sst"), none), ("mean_mld", F.col("mean_mld"), none)
    ])
    return reduce(lambda a, b: a.unionByName(b), [heat, climate, *slopes, water])


def rapid_view(sst, surface, indices):
    return detect.rapid_changes(*detect.rapid_inputs(sst, surface), indices)


def trends_view(sst, surface, profiles):
    anomaly, qnet, _ = detect.rapid_inputs(sst, surface)
    return detect.long_term_trends(detect.trend_inputs(anomaly, qnet, profiles))
