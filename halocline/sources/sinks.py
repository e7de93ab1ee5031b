"""Writers. A table is replaced as a whole or by years; none is written onto the folder it is read from."""

from functools import reduce
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

# Date column of each standard result table that is stored by year.
YEARLY_RESULTS = {"mhw_timeseries": "date", "rapid_changes": "date", "unusual_mld": "time"}
LAYOUTS = {
    "time_slice": ["time", "lat", "lon"],
    "spatial_mean": ["lat", "lon", "time"],
    "profile": ["dac", "profile_idx", "level_idx"],
}


def write_grid(grid, path, time="time"):
    """A grid by year, clustered by cell inside a year for per-cell reads."""
    _refuse_own_folder(grid, path)
    out = grid.withColumn("year", F.year(time))
    out.repartitionByRange("year", "lat", "lon").sortWithinPartitions("year", "lat", "lon", time).write.mode(
        "overwrite"
    ).partitionBy("year").parquet(path)


def write_result(df, path):
    _refuse_own_folder(df, path)
    df.write.mode("overwrite").parquet(path)


def existing_years(spark, path):
    """Years already stored, or None when nothing is."""
    try:
        return spark.read.parquet(path).select("year").distinct()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_years(df, path, date="date", overwrite=False):
    """One folder per year, one of them for rows without a date.

    Stored years are skipped, or replaced alone when ``overwrite``.
    """
    spark = df.sparkSession
    out = df.withColumn("year", F.year(date))
    stored = existing_years(spark, path)
    if stored is not None and not overwrite:
        stored = stored.withColumnRenamed("year", "stored_year")
        out = out.join(stored, F.col("year").eqNullSafe(F.col("stored_year")), "left_anti")
    out.write.mode("overwrite" if overwrite else "append").option("partitionOverwriteMode", "dynamic").partitionBy(
        "year"
    ).parquet(path)
    return spark.read.parquet(path)


def write_all_years(tables, base, overwrite=False):
    """``write_years`` for every standard result that is given."""
    return {
        name: write_years(tables[name], f"{base}/{name}", date, overwrite)
        for name, date in YEARLY_RESULTS.items()
        if name in tables
    }


def write_forecast(df, path):
    df.write.mode("overwrite").json(path)


def append_upload(existing, new, time="time"):
    """Existing rows and new rows with a valid time, missing columns NULL; an error if none is valid."""
    dated = new.withColumn(time, F.try_to_timestamp(F.col(time).cast("string"))).dropna(subset=[time])
    if dated.isEmpty():
        raise ValueError("no valid rows found after parsing")
    return existing.unionByName(dated, allowMissingColumns=True)


def write_upload(new, path, time="time"):
    """Append the valid rows to a stored table."""
    dated = new.withColumn(time, F.try_to_timestamp(F.col(time).cast("string"))).dropna(subset=[time])
    if dated.isEmpty():
        raise ValueError("no valid rows found after parsing")
    dated.write.mode("append").parquet(path)


def save_mark(spark, path, dataset, last_time):
    """Commit a high-water mark by appending it; readers take the newest."""
    row = spark.range(1).select(
        F.lit(dataset).alias("dataset"),
        F.lit(last_time).cast("timestamp").alias("last_time"),
        F.current_timestamp().alias("committed_at"),
    )
    row.write.mode("append").parquet(path)


def _reads_from(df, path):
    """Whether a file of ``df`` lies in the folder, in the same or an unnamed file system."""
    folder = urlparse(path)
    files = [urlparse(f) for f in df.inputFiles()]
    inside = [f for f in files if f"{f.path}/".startswith(folder.path.rstrip("/") + "/")]
    return any(not folder.netloc or f.netloc == folder.netloc for f in inside)


def _refuse_own_folder(df, path):
    if _reads_from(df, path):
        raise ValueError(f"{path} is read from; name another folder")


def relayout(df, path, mode="time_slice", dry_run=False, files=None):
    """Rewrite a table clustered for one access pattern, and report the layout before and after."""
    order = [c for c in LAYOUTS[mode] if c in df.columns]
    if not dry_run:
        _refuse_own_folder(df, path)
        placed = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
        placed.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)

    def report(table, state):
        return table.groupBy(F.spark_partition_id().alias("piece")).agg(F.count(F.lit(1)).alias("n")).agg(
            F.lit(state).alias("state"), F.lit(mode).alias("mode"), F.lit(",".join(order)).alias("clustered_by"),
            F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_pieces"),
        )

    rows = [report(df, "before")]
    if not dry_run:
        rows.append(report(df.sparkSession.read.parquet(path), "after"))
    return reduce(lambda a, b: a.unionByName(b), rows)


def relayout_all(tables, base, mode="time_slice", dry_run=False):
    reports = [
        relayout(df, f"{base}/{name}", mode, dry_run).withColumn("table_name", F.lit(name)) for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), reports)


def union_stores(stores):
    """Rows of several stores as one table; stores that failed to open (None) are left out."""
    present = [s for s in stores if s is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def merge_from_cutoff(old, new, date="date"):
    """Old rows before the first new date, then the new rows; without new rows the old stay."""
    cutoff = new.agg(F.min(date)).scalar()
    kept = old.where(F.coalesce(F.col(date) < cutoff, cutoff.isNull()))
    return kept.unionByName(new)
