"""Coordinate axes as tables: distinct values numbered in order, without one value that holds an axis."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import written

#: Ranges into which distinct values are cut for numbering; each is ordered in its own task.
RANGES = 64


def values(df, columns):
    """The distinct values of several columns, written once: one pass over ``df`` serves all axes made from them.

    Each row holds a value of one column and NULL in the others.
    """
    types = {c: df.schema[c].dataType for c in columns}
    one = [F.struct(*[(F.col(c) if c == held else F.lit(None).cast(types[c])).alias(c) for c in columns]) for held in columns]
    return written(df.select(F.inline(F.array(*one))).distinct(), "axis-values")


def numbered(df, column, ranges=RANGES):
    """(``column``, position) of the distinct values in ascending order, positions from 0; NULL is left out.

    ``df`` is read several times; where it is not stored, give its ``values``.

    Values are cut into ranges by a sketch, ordered inside each range, and lifted by the number of values in the
    ranges before it. The window over all ranges has one row per range.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    marks = [i / ranges for i in range(1, ranges)]
    edges = values.agg(F.percentile_approx(column, marks, 1000).alias("edges")).scalar()
    cut = values.withColumn("_edges", edges)
    cut = cut.select(column, F.size(F.filter("_edges", lambda e: e < F.col(column))).alias("_part"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return cut.withColumn("_place", place).join(sizes, "_part").select(column, (F.col("_before") + F.col("_place")).alias("position"))


def length(axis):
    """Number of values of a numbered axis, as a subquery."""
    return axis.agg(F.count(F.lit(1))).scalar()


def value_at(axis, column, step):
    """The value at a position, counted from the end if negative, as a subquery; NULL beyond the axis."""
    wanted = F.lit(step) if step >= 0 else length(axis) + F.lit(step)
    return axis.where(F.col("position") == wanted).agg(F.max(column)).scalar()


def every(df, axis, column, step):
    """Rows of ``df`` at every ``step``-th value of the axis; the join picks broadcast or merge by measured size."""
    return df.join(axis.where(F.pmod(F.col("position"), step) == 0).select(column), column, "left_semi")


def write_axes(df, path, columns=("time", "lat", "lon")):
    """One small table per axis beside a grid, so that views do not read the grid for its axes."""
    found = values(df, columns)
    for c in columns:
        numbered(found, c).write.mode("overwrite").parquet(f"{path}/{c}")


def read_axis(spark, path, column):
    return spark.read.parquet(f"{path}/{column}")
