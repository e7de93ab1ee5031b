"""Thresholds of cells that grow with the record, or follow the season.

A quantile sketch per cell and year keeps what a threshold needs of the record. Sketches merge, so a new
year costs a sketch of that year alone, and a threshold over any years costs a merge of small rows. The
table of sketches is appended to, each append with a version; readers take the newest sketch of a cell and year.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import quantile_of_sorted
from .grid import CELL, by_cell

#: Size of a sketch. A rank read from sketches of this size, merged or not, is within RANK_ERROR of the true
#: one, as a share of the values, in more than 99 of 100 cases.
SKETCH_SIZE, RANK_ERROR = 800, 0.006
DAYS = 366


def yearly_sketches(grid, value, size=SKETCH_SIZE):
    """One quantile sketch per cell and year, with the number of values; combined map-side."""
    kept = grid.where(F.col(value).isNotNull())
    return kept.groupBy(*CELL, F.year("time").alias("year")).agg(
        F.count(F.lit(1)).alias("n_values"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch")
    )


def append_sketches(sketches, path, version):
    """Add sketches to the table in ``path``; a repeated version replaces itself and nothing else."""
    sketches.write.mode("overwrite").parquet(f"{path}/version={int(version)}")


def newest_sketches(spark, path):
    """The sketches of the highest version per cell and year."""
    stored = spark.read.parquet(path)
    newest = stored.groupBy(*CELL, "year").agg(F.max_by(F.struct("n_values", "sketch", "version"), "version").alias("s"))
    return newest.select(*CELL, "year", "s.*")


def merged_threshold(sketches, q=0.9):
    """One threshold per cell from all its sketches, within RANK_ERROR in rank of the exact quantile."""
    merged = sketches.groupBy(*CELL).agg(F.sum("n_values").alias("n_values"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(*CELL, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("threshold"))


def renew_thresholds(spark, sketches_path, target, q=0.9):
    """Write the frozen threshold table of a stream anew from the sketches; the record is not read."""
    stored = newest_sketches(spark, sketches_path)
    version = stored.agg(F.max("version")).first()[0]
    path = f"{target}/version={version}"
    merged_threshold(stored, q).write.mode("overwrite").parquet(path)
    return path


def newest_thresholds(spark, target):
    """The threshold table of the highest version."""
    stored = spark.read.parquet(target)
    return stored.where(F.col("version") == stored.agg(F.max("version")).first()[0]).drop("version")


def seasonal_threshold(grid, value, q=0.9, half_window=5):
    """One threshold per cell and day of the year, over the values of the days around it.

    The days of the year form a ring of 366: days 366 and 1 are neighbours. All years are pooled. Values of a
    cell and day are gathered first, at most one a year; a cell's days are then repeated at both ends of
    the ring, and one ordered window per cell pools them, in the partition that holds the cell.
    """
    if not 0 <= half_window < DAYS // 2:
        raise ValueError(f"a half window of {half_window} days does not fit in a ring of {DAYS}")
    placed = by_cell(grid.where(F.col(value).isNotNull()))
    days = placed.groupBy("cell", *CELL, F.dayofyear("time").alias("doy")).agg(F.collect_list(F.col(value).cast("double")).alias("v"))
    turns = F.filter(F.array(F.lit(0), F.lit(-DAYS), F.lit(DAYS)), lambda t: (F.col("doy") + t).between(1 - half_window, DAYS + half_window))
    ring = days.select("cell", *CELL, "doy", "v", F.explode(turns).alias("turn")).withColumn("at", F.col("doy") + F.col("turn"))
    w = Window.partitionBy("cell", *CELL).orderBy("at").rangeBetween(-half_window, half_window)
    pooled = ring.withColumn("pool", F.flatten(F.collect_list("v").over(w))).where("turn = 0")
    return pooled.select(*CELL, "doy", quantile_of_sorted(F.array_sort("pool"), q).alias("threshold"))


def with_seasonal_intensity(grid, value, q=0.9, half_window=5, out="intensity"):
    """Value minus the threshold of its cell and day of the year.

    The thresholds are at most 366 rows per cell; the join picks broadcast or merge by measured size.
    """
    limits = seasonal_threshold(grid, value, q, half_window)
    joined = grid.withColumn("doy", F.dayofyear("time")).join(limits, [*CELL, "doy"], "left")
    return joined.withColumn(out, F.col(value) - F.col("threshold")).drop("doy", "threshold")
