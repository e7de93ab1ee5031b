"""Running values over long ordered series, chunk by chunk.

A window over a whole series meets in one task. Here rows are ordered inside chunks of time, each chunk hands on a
small state, the states are carried over a table of one row per key and chunk, and every row adds the
state that came before its chunk. A chunk is a calendar month unless named otherwise; a series of hours or
seconds is so spread over its months.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import flag


def _chunk(time, unit):
    return F.date_trunc(unit, F.col(time).cast("timestamp")).alias("_chunk")


def _carried(chunks, keys, state, start, step):
    """(keys, _chunk, ``state``): the state before each chunk.

    One row per chunk is gathered by key, in order, and the states are run through by ``step``; there are
    as many rows as months in the record, however many rows a month has.
    """
    own = [c for c in chunks.columns if c not in (*keys, "_chunk")]
    listed = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_chunk", *own))).alias("_all"))
    empty = F.array(F.struct(F.lit(None).cast("timestamp").alias("_chunk"), start.alias("state"), start.alias("after"))).alias("x")

    def go(done, c):
        before = F.element_at(done, -1)["after"]
        return F.concat(done, F.array(F.struct(c["_chunk"].alias("_chunk"), before.alias("state"), step(before, c).alias("after"))))

    states = F.slice(F.aggregate("_all", empty, go), 2, F.size("_all"))
    return listed.select(*keys, F.explode(states).alias("_s")).select(*keys, F.col("_s._chunk").alias("_chunk"), F.col("_s.state").alias(state))


def _joined(rows, states, keys):
    """Rows with the state of their chunk; NULL keys are equal."""
    same = F.col("rows._chunk") == F.col("states._chunk")
    for k in keys:
        same = same & F.col(f"rows.{k}").eqNullSafe(F.col(f"states.{k}"))
    extra = [c for c in states.columns if c not in (*keys, "_chunk")]
    return rows.alias("rows").join(states.alias("states"), same).select("rows.*", *[f"states.{c}" for c in extra])


def with_running_sum(df, value, out, time, keys=(), unit="month"):
    """Sum of ``value``, NULL as 0, over the series up to and with each row. Rows without a time are left out."""
    keys = list(keys)
    rows = df.where(F.col(time).isNotNull()).select("*", _chunk(time, unit), F.coalesce(value, F.lit(0)).cast("long").alias("_add"))
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum("_add").alias("total"))
    before = _carried(totals, keys, "_before", F.lit(0).cast("long"), lambda state, c: state + c["total"])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _joined(rows.withColumn("_run", F.sum("_add").over(inside)), before, keys).withColumn(out, F.col("_before") + F.col("_run")).drop(
        "_chunk", "_add", "_run", "_before"
    )


def with_run_length(df, condition, out, time, keys=(), unit="month"):
    """Number of successive rows up to and with each row for which ``condition`` holds; 0 where it does not.

    A chunk hands on whether it holds throughout, its rows, and the length of the run at its end.
    """
    keys = list(keys)
    rows = df.where(F.col(time).isNotNull()).select("*", _chunk(time, unit), flag(condition).alias("_holds"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(time))
    rows = rows.withColumn("_number", number).withColumn("_broken", F.max(F.when(~F.col("_holds"), F.col("_number"))).over(inside))
    ends = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("n"), F.max("_broken").alias("broken"))
    before = _carried(
        ends, keys, "_before", F.lit(0).cast("long"),
        lambda state, c: F.when(c["broken"].isNull(), state + c["n"]).otherwise(c["n"] - c["broken"]),
    )
    run = F.when(F.col("_broken").isNull(), F.col("_before") + F.col("_number")).otherwise(F.col("_number") - F.col("_broken"))
    return _joined(rows, before, keys).withColumn(out, run.cast("long")).drop("_chunk", "_holds", "_number", "_broken", "_before")


def with_persistence(df, share="frac_mhw", out="is_mhw", level=0.05, days=5, time="date", keys=(), unit="month"):
    """True from the ``days``-th consecutive row above ``level``, for series of any length."""
    rows = with_run_length(df, F.col(share) > level, "_length", time, keys, unit)
    return rows.withColumn(out, F.col("_length") >= days).drop("_length")


def with_event_start(df, time="date", keys=(), condition="is_mhw", unit="month"):
    """Flagged rows with the number of their run of consecutive flagged rows, for series of any length.

    A run begins where its length is one, so its number is a running sum.
    """
    rows = with_run_length(df, F.col(condition), "_length", time, keys, unit)
    rows = with_running_sum(rows, (F.col("_length") == 1).cast("int"), "event_id", time, keys, unit)
    return rows.where(F.col(condition)).drop("_length")


def with_ordinal(df, value, time, keys=(), unit="month"):
    """Position, from 0, of each row with a value, for series of any length."""
    rows = with_running_sum(df.where(F.col(value).isNotNull()), F.lit(1), "_place", time, keys, unit)
    return rows.withColumn("x", (F.col("_place") - 1).cast("double")).drop("_place")


def linear_trend(df, value, time, keys=(), min_rows=6, steps_per_year=12, flat_r2=0.0, unit="month"):
    """Least squares over the row ordinal, per key, for series of any length; sums are combined map-side."""
    y = F.col(value)
    fit = with_ordinal(df, value, time, keys, unit).groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.regr_slope(y, F.col("x")).alias("slope"),
        F.when(F.var_pop(y) > 0, F.regr_r2(y, F.col("x"))).otherwise(F.lit(flat_r2)).alias("fit"),
    )
    enough = F.col("n") >= min_rows
    return fit.select(
        *keys,
        F.when(enough, F.col("slope") * steps_per_year).alias("slope_per_year"),
        F.when(enough, F.col("fit")).alias("r2"),
        F.when(enough, F.col("n")).alias("n_months"),
    )
