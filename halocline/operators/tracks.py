"""Float positions: newest position, trails and moves."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def latest_positions(positions, until=None, key="float_id", order=("time", "profile_idx")):
    """The newest row per float up to a day; combined map-side, so busy floats do not pile up."""
    kept = positions if until is None else positions.where(F.to_date("time") <= F.lit(until).cast("date"))
    return kept.groupBy(key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def trails(positions, until=None, key="float_id", order=("time", "profile_idx")):
    """Time-ordered positions of every float as rows.

    A global sort by float and time cuts a long trail over several ranges, where an array per float
    would have to fit in one task.
    """
    kept = positions if until is None else positions.where(F.to_date("time") <= F.lit(until).cast("date"))
    return kept.select(key, *order, "lat", "lon").orderBy(key, *order)


def with_previous_position(positions, key="float_id", order=("time", "profile_idx")):
    """Each position with the one before it.

    Rows are compared inside one float and month; the first of a month takes the last position of the
    float's previous month from a table of month ends. A float with very many rows is so spread over
    its months.
    """
    spot = F.struct("lat", "lon", "time")
    chunked = positions.withColumn("_chunk", F.trunc(F.to_date("time"), "month"))
    inside = F.lag(spot).over(Window.partitionBy(key, "_chunk").orderBy(*order))
    ends = chunked.groupBy(key, "_chunk").agg(F.max_by(spot, F.struct(*order)).alias("_end"))
    carried = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(key).orderBy("_chunk"))).drop("_end")
    joined = chunked.withColumn("_inside", inside).join(carried, [key, "_chunk"], "left")
    prev = F.coalesce("_inside", "_carry")
    return joined.withColumns(
        {"prev_lat": prev["lat"], "prev_lon": prev["lon"], "prev_time": prev["time"]}
    ).drop("_chunk", "_inside", "_carry")


def moves(positions, tolerance=0.001, key="float_id", order=("time", "profile_idx")):
    """Steps from the previous position; those below the tolerance in both axes are no moves."""
    p = with_previous_position(positions, key, order)
    moved = (F.abs(F.col("lat") - F.col("prev_lat")) >= tolerance) | (
        F.abs(F.col("lon") - F.col("prev_lon")) >= tolerance
    )
    return p.where(moved)


def days_and_floats(positions, key="float_id"):
    """Distinct days and distinct floats as (kind, value) rows, in one pass."""
    pair = F.array(
        F.struct(F.lit("day").alias("kind"), F.date_format("time", "yyyy-MM-dd").alias("value")),
        F.struct(F.lit("float").alias("kind"), F.col(key).cast("string").alias("value")),
    )
    return positions.select(F.explode(pair).alias("p")).select("p.*").distinct().orderBy("kind", "value")
