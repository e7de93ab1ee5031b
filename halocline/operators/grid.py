"""Operators on long grids: one row per (time, lat, lon).

A grid has at most one row per time and cell, so a cell holds no more rows than there are time
steps, and the axes (distinct times, latitudes, longitudes) are short however large the grid is.
One-row facts about a grid (axes, totals) are attached as scalar subqueries, never by a join.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.labels import heatwave_category
from . import axes as A
from .quantiles import exact_quantiles

CELL = ["lat", "lon"]


def axis(df, column, shape=lambda values: values):
    """The sorted distinct values of a coordinate as a one-value subquery, reshaped by ``shape``."""
    return df.agg(F.array_sort(F.collect_set(column)).alias("values")).select(shape(F.col("values"))).scalar()


def by_cell(grid):
    """Place each cell in one partition; every per-cell step after it needs no further shuffle.

    Placement goes by an integer hash of the cell: windows over floating-point keys compare normalised
    values and would not accept a placement by the plain coordinates. The hash only places rows,
    coordinates still decide the groups.
    """
    return grid.withColumn("cell", F.xxhash64(*CELL)).repartition("cell")


def cell_window(grid, *more):
    """Window over a cell, in the partitions of ``by_cell`` where that was called."""
    return Window.partitionBy(*[c for c in ("cell", *CELL) if c in grid.columns], *more)


def day_of_year_climatology(grid, value, out):
    doy = F.dayofyear("time").alias("doy")
    return grid.groupBy(*CELL, doy).agg(F.avg(value).alias(out), F.count(value).alias("n"))


def with_anomaly(grid, value, anomaly, climatology=None):
    """Value minus its day-of-year mean in the cell."""
    w = cell_window(grid, F.dayofyear("time"))
    mean = F.avg(value).over(w)
    if climatology:
        grid = grid.withColumn(climatology, mean)
        return grid.withColumn(anomaly, F.col(value) - F.col(climatology))
    return grid.withColumn(anomaly, F.col(value) - mean)


def observation_threshold(observations, value, q=0.9):
    """``cell_threshold`` for loose observations, of which one cell may hold any number."""
    rows = exact_quantiles(observations, value, [q], CELL)
    return rows.select(*CELL, F.col("quantile").alias("threshold"))


def cell_threshold(grid, value, q=0.9, approximate=False, accuracy=10000):
    """One quantile per cell over the whole record; a cell of a grid has one row per time step."""
    quantile = F.percentile_approx(value, q, accuracy) if approximate else F.percentile(value, q)
    return grid.groupBy(*CELL).agg(quantile.alias("threshold"))


def with_intensity(grid, value, q=0.9, out="intensity"):
    """Value minus its cell's quantile."""
    return grid.withColumn(out, F.col(value) - F.percentile(value, q).over(cell_window(grid)))


def intensity_against(grid, thresholds, value, out="intensity"):
    """Value minus a stored threshold table. The join picks broadcast or merge by measured size."""
    return grid.join(thresholds, CELL, "left").withColumn(out, F.col(value) - F.col("threshold")).drop("threshold")


def daily_heatwave_metrics(grid, value="intensity", keys=(), keep_empty=False):
    """Share of cells above zero, mean positive and maximum intensity per day, with category.

    Days without a valid cell are left out, or kept with a missing share when ``keep_empty``.
    """
    x = F.col(value)
    daily = grid.groupBy(*keys, F.to_date("time").alias("date")).agg(
        F.count(x).alias("n_valid"),
        F.count_if(x > 0).alias("n_above"),
        F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("mean_intensity"),
        F.max(x).alias("max_intensity"),
    )
    if keep_empty:
        daily = daily.withColumn("max_intensity", F.coalesce("max_intensity", F.lit(0.0)))
    else:
        daily = daily.where("n_valid > 0")
    return daily.select(
        *keys,
        "date",
        F.try_divide("n_above", "n_valid").alias("frac_mhw"),
        "mean_intensity",
        "max_intensity",
        heatwave_category(F.col("max_intensity")).alias("mhw_category"),
    )


def spatial_mean(grid, values, keys=(), area_weighted=False):
    """Mean over all cells per day; ``values`` maps output names to columns."""
    if area_weighted:
        w = F.cos(F.radians("lat"))
        aggs = [
            F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(out)
            for out, c in values.items()
        ]
    else:
        aggs = [F.avg(c).alias(out) for out, c in values.items()]
    return grid.groupBy(*keys, F.to_date("time").alias("date")).agg(*aggs)


def daily_coverage(grid, value):
    """Valid cells over all cells of the grid, per day."""
    cells = grid.select(*CELL).distinct().agg(F.count(F.lit(1))).scalar()
    return grid.groupBy(F.to_date("time").alias("date")).agg(F.count(value).alias("n_valid")).select(
        "date", (F.col("n_valid") / cells).alias("sst_coverage")
    )


def date_range(df, time="time"):
    return df.agg(F.min(time).alias("min_date"), F.max(time).alias("max_date"))


def spatial_stride(df, k, axes=None, stored=None):
    """Every k-th latitude and longitude of the axes of ``axes``, the whole grid if ``df`` is a part.

    ``stored`` is the folder of a written axis table, read in place of the grid.
    """
    if k == 1:
        return df
    found = A.values(df if axes is None else axes, CELL) if stored is None else None
    for c in CELL:
        axis_ = A.numbered(found, c) if stored is None else A.read_axis(df.sparkSession, stored, c)
        df = A.every(df, axis_, c, F.lit(k)).select(*df.columns)
    return df


def time_stride(df, frames, time="time", stored=None):
    """Times at a regular step over the whole record, at most ``frames``; all of them for None."""
    if frames is None:
        return df
    axis_ = A.numbered(A.values(df, [time]), time) if stored is None else A.read_axis(df.sparkSession, stored, time)
    step = F.greatest(F.lit(1), F.ceil(A.length(axis_) / F.lit(frames)).cast("int"))
    return A.every(df, axis_, time, step).select(*df.columns)


def even_times(df, n, time="time"):
    """``n`` evenly spaced times from first to last, positions truncated; repeats count once each."""
    return df.agg(F.array_sort(F.collect_set(time)).alias("t")).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(n - 1)),
                lambda i: F.element_at(
                    "t", (F.floor(i * (F.size("t") - 1) / F.lit(n - 1)) + 1).cast("int")
                ),
            )
        ).alias(time)
    )


def nearest_time(df, target, time="time"):
    """The stored time nearest to ``target``, the earlier one on ties, as a subquery."""
    t = F.col(time)
    gap = F.abs(F.unix_seconds(t.cast("timestamp")) - F.unix_seconds(F.lit(target).cast("timestamp")))
    return df.agg(F.min_by(t, F.struct(gap.alias("gap"), t.alias("t")))).scalar()


def at_time(df, target=None, time="time"):
    """The rows of the nearest time, or of the latest one."""
    chosen = df.agg(F.max(time)).scalar() if target is None else nearest_time(df, target, time)
    return df.where(F.col(time) == chosen)


def heatmap_points(grid, target=None, stride=1, value="sst", anomaly="sst_anomaly", axes=None):
    """Points of one day with anomaly; where it is missing, the value minus a fixed mean."""
    day = spatial_stride(at_time(grid, target), stride, grid if axes is None else axes).where(F.col(value).isNotNull())
    fallback = F.col(value) - F.lit(K.SST_FALLBACK_MEAN)
    return day.select(
        "time",
        F.round("lat", 3).alias("latitude"),
        F.round("lon", 3).alias("longitude"),
        F.round(value, 3).alias("sst"),
        F.round(F.coalesce(anomaly, fallback), 3).alias("sst_anomaly"),
    )


def join_anomaly(sst, anomaly):
    """Cell join of a value grid and an anomaly grid held in separate tables."""
    return sst.join(anomaly.select("time", *CELL, "sst_anomaly"), ["time", *CELL], "left")


def point_bounds(points):
    return points.agg(
        *[F.round(f(c), 2).alias(f"{n}_{c}") for c in ("sst", "sst_anomaly") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))],
        F.count(F.lit(1)).alias("n_points"),
    )


def grid_rows(points, value="sst_anomaly"):
    """Points to grid rows: one row per latitude with an array over the shared longitude axis.

    Rows instead of one nested array keep each value as short as the longitude axis. Cells are told
    apart by their coordinates as given.
    """
    p = points.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), value)
    rows = p.groupBy("lat").agg(
        F.map_from_entries(F.collect_list(F.struct("lon", value))).alias("cells")
    )
    return rows.withColumn("lon_values", axis(p, "lon")).select(
        "lat",
        "lon_values",
        F.transform("lon_values", lambda x: F.try_element_at("cells", x)).alias("row_values"),
    )


def range_check(df, variables, bounds=K.RANGE_BOUNDS):
    """Minimum, maximum, missing count and share, and in-range flag per variable, in one pass."""
    parts = []
    for v in variables:
        low, high = bounds[v]
        parts.append(
            F.struct(
                F.lit(v).alias("variable"),
                F.min(v).alias("min_value"),
                F.max(v).alias("max_value"),
                F.count_if(F.col(v).isNull()).alias("n_missing"),
                (F.lit(100.0) * F.try_divide(F.count_if(F.col(v).isNull()), F.count(F.lit(1)))).alias("pct_missing"),
                F.coalesce((F.min(v) >= low) & (F.max(v) <= high), F.lit(False)).alias("in_range"),
            )
        )
    return df.agg(F.array(*parts).alias("checks")).select(F.inline("checks"))


def grid_uncertainty(sst, qnet, wind, sla, samples=None):
    """Error and confidence per field; metrics that a field does not have stay NULL.

    All days count, or ``samples`` evenly spaced ones if the caller asks for them.
    """
    cells = sst.select(*CELL).distinct().agg(F.count(F.lit(1))).scalar()
    per_day = sst.groupBy("time").agg(F.count("sst").alias("n_valid"))
    if samples is not None:
        per_day = per_day.join(even_times(sst, samples), "time")
    per_day = per_day.select((F.lit(1.0) - F.col("n_valid") / cells).alias("missing"))
    total_sst = (K.SST_INSTRUMENT_ERROR**2 + K.SST_BLENDING_ERROR**2) ** 0.5
    sst_row = per_day.agg(
        F.lit("sst").alias("field"),
        F.lit(K.SST_INSTRUMENT_ERROR).alias("instrument_uncertainty"),
        F.round(F.lit(1.0) - F.avg("missing"), 3).alias("mean_confidence"),
        F.lit(round(total_sst, 3)).alias("total_uncertainty_degC"),
        F.round(F.lit(1.0) - F.max("missing"), 3).alias("min_confidence"),
    )
    qnet_row = qnet.agg(
        F.lit("qnet").alias("field"),
        F.lit(K.QNET_ERROR).alias("instrument_uncertainty"),
        F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(K.QNET_ERROR) / F.greatest(F.stddev_pop("qnet"), F.lit(1.0))), 3).alias("mean_confidence"),
        F.lit(K.QNET_ERROR).alias("total_uncertainty_Wm2"),
        F.round(F.avg("qnet"), 2).alias("qnet_mean_Wm2"),
        F.round(F.stddev_pop("qnet"), 2).alias("qnet_std_Wm2"),
    )
    wind_row = wind.agg(
        F.lit("wind").alias("field"),
        F.lit(K.WIND_ERROR).alias("instrument_uncertainty"),
        F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(K.WIND_ERROR) / F.greatest(F.avg("wind_speed"), F.lit(0.1))), 3).alias("mean_confidence"),
        F.lit(K.WIND_ERROR).alias("total_uncertainty_ms"),
        F.round(F.avg("wind_speed"), 2).alias("wind_mean_ms"),
    )
    sla_row = sla.agg(
        F.lit("sla").alias("field"),
        F.lit(K.SLA_ERROR).alias("instrument_uncertainty"),
        F.lit(K.SLA_CONFIDENCE).alias("mean_confidence"),
        F.lit(K.SLA_ERROR).alias("total_uncertainty_m"),
        F.round(F.avg("sla"), 4).alias("sla_mean_m"),
    )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [sst_row, qnet_row, wind_row, sla_row])


def in_box(df, lat_range=K.STUDY_LAT, lon_range=K.STUDY_LON, lat="lat", lon="lon"):
    return df.where(F.col(lat).between(*lat_range) & F.col(lon).between(*lon_range))
