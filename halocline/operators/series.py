"""Operators on ordered series: one row per key and day, month or year.

A series has at most one row per calendar step, so one key holds some ten thousand rows per century
whatever the size of the grid behind it; its windows may run in one task. ``keys`` splits many
series over tasks.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, flag, min_max_scale, to_unit


def ordered(keys, time):
    return Window.partitionBy(*keys).orderBy(time)


def month_end(time):
    return F.last_day(F.to_date(time))


def resample_month(df, values, time="date", keys=()):
    """Means per calendar month, labelled by its last day; months without any value are dropped."""
    monthly = df.groupBy(*keys, month_end(time).alias("month_end")).agg(*[F.avg(v).alias(v) for v in values])
    return monthly.dropna(how="all", subset=list(values))


def resample_year(df, values, time="date", keys=()):
    return df.groupBy(*keys, F.year(time).alias("year")).agg(*[F.avg(v).alias(v) for v in values])


def monthly_statistics(profiles, time="time"):
    """Mean and spread of the stratification measures per month, with the profile count."""
    return profiles.where(F.col(time).isNotNull()).groupBy(F.trunc(F.to_date(time), "month").alias("month_start")).agg(
        F.avg("mean_N2").alias("mean_N2"),
        F.stddev_samp("mean_N2").alias("std_N2"),
        F.avg("strat_index").alias("mean_strat"),
        F.stddev_samp("strat_index").alias("std_strat"),
        F.count("lat").alias("n_profiles"),
    )


def with_change(df, value, out, rows=7, time="date", keys=()):
    return df.withColumn(out, F.col(value) - F.lag(value, rows).over(ordered(keys, time)))


def with_persistence(df, share="frac_mhw", out="is_mhw", level=0.05, days=5, time="date", keys=(), backfill=False):
    """True from the ``days``-th consecutive row above ``level``; ``backfill`` marks the whole run."""
    w = ordered(keys, time)
    above = F.when(flag(F.col(share) > level), 1).otherwise(0)
    full = F.sum(above).over(w.rowsBetween(1 - days, 0)) == days
    if not backfill:
        return df.withColumn(out, full)
    marked = df.withColumn("_full", full)
    ahead = F.max(F.col("_full")).over(w.rowsBetween(0, days - 1))
    return marked.withColumn(out, flag(ahead)).drop("_full")


def with_recent_share(df, condition, out, rows=30, time="date", keys=()):
    """Share of flagged rows among the last ``rows``; the divisor does not shrink at the start."""
    hits = F.sum(F.col(condition).cast("int")).over(ordered(keys, time).rowsBetween(1 - rows, 0))
    return df.withColumn(out, hits / F.lit(float(rows)))


def tail_rows(df, n, time="date", keys=()):
    """The last ``n`` rows of each series."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest_row(df, time="date", keys=()):
    return df.groupBy(*keys).agg(F.max_by(F.struct("*"), time).alias("latest"))


def with_centred_mean(df, value, out, rows=12, min_rows=6, time="month_end", keys=()):
    """Mean over a centred window of an even number of rows, half before and half minus one after."""
    w = ordered(keys, time).rowsBetween(-(rows // 2), (rows - 1) // 2)
    return df.withColumn(out, F.when(F.count(value).over(w) >= min_rows, F.avg(value).over(w)))


def with_month_mean(df, value, out, time="month_end", keys=()):
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*keys, F.month(time))))


def decompose(monthly, value, time="month_end", keys=(), min_months=13):
    """Trend, seasonal part and residual of a monthly series; nothing if it is shorter than 13 months."""
    d = with_centred_mean(monthly, value, "trend", time=time, keys=keys)
    d = d.withColumn("seasonal", F.col(value) - F.col("trend"))
    d = with_month_mean(d, "seasonal", "_cycle", time, keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (
        d.withColumn("residual", F.col("seasonal") - F.col("_cycle"))
        .withColumn("_n", n)
        .where(F.col("_n") >= min_months)
        .select(*keys, time, F.col(value).alias("observed"), "trend", "seasonal", "residual")
    )


def safe_corr(x, y):
    """Pearson correlation over pairs without gaps; NULL when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    cov = F.covar_pop(xs, ys)
    spread = F.stddev_pop(xs) * F.stddev_pop(ys)
    return F.when(spread > 0, cov / F.when(spread > 0, spread))


def lagged_correlation(df, drivers, targets, max_lag=90, step=15, time="date"):
    """Correlation of lagged drivers with targets; missing results are 0.

    Each row becomes one row per driver and lag, so the pairs spread over tasks as groups.
    """
    lags = range(0, max_lag + 1, step)
    w = Window.orderBy(time)
    shifted = df.select(*targets, *[F.lag(d, k).over(w).alias(f"{d}_{k}") for d in drivers for k in lags])
    pairs = F.array(*[
        F.struct(F.lit(d).alias("driver"), F.lit(k).alias("lag_days"), F.col(f"{d}_{k}").alias("x"))
        for d in drivers
        for k in lags
    ])
    long = shifted.select(*targets, F.inline(pairs))
    return long.groupBy("driver", "lag_days").agg(
        *[F.round(F.coalesce(safe_corr(F.col("x"), F.col(t)), F.lit(0.0)), 3).alias(t) for t in targets]
    )


def correlation_matrix(df, columns):
    """All pairwise correlations of a short table, in one pass."""
    cells = [
        F.struct(
            F.lit(a).alias("row"),
            F.lit(b).alias("col"),
            F.coalesce(safe_corr(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)).alias("corr"),
        )
        for a in columns
        for b in columns
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def with_ordinal(df, value, time, keys=()):
    """Position of each non-missing row."""
    kept = df.where(F.col(value).isNotNull())
    return kept.withColumn("x", (F.row_number().over(ordered(keys, time)) - 1).cast("double"))


def linear_trend(df, value, time, keys=(), min_rows=6, steps_per_year=12, flat_r2=0.0):
    """Least squares over the row ordinal, per key. Short series give NULL, constant ones slope 0."""
    y = F.col(value)
    fit = with_ordinal(df, value, time, keys).groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.regr_slope(y, F.col("x")).alias("slope"),
        F.regr_intercept(y, F.col("x")).alias("intercept"),
        F.when(F.var_pop(y) > 0, F.regr_r2(y, F.col("x"))).otherwise(F.lit(flat_r2)).alias("fit"),
    )
    enough = F.col("n") >= min_rows
    return fit.select(
        *keys,
        F.when(enough, F.col("slope") * steps_per_year).alias("slope_per_year"),
        F.when(enough, F.col("fit")).alias("r2"),
        F.when(enough, F.col("n")).alias("n_months"),
        F.when(enough, F.col("slope")).alias("slope"),
        F.when(enough, F.col("intercept")).alias("intercept"),
    )


def fitted_line(df, value, time, keys=(), min_rows=4, band=1.96):
    """Each row with its fitted value and a band of ``band`` residual deviations."""
    w = Window.partitionBy(*keys)
    x, y = F.col("x"), F.col(value)
    rows = with_ordinal(df, value, time, keys)
    line = rows.withColumns(
        {
            "_n": F.count(y).over(w),
            "slope": F.regr_slope(y, x).over(w),
            "intercept": F.regr_intercept(y, x).over(w),
        }
    ).where(F.col("_n") >= min_rows)
    line = line.withColumn("fitted", F.col("intercept") + F.col("slope") * x)
    spread = F.stddev_pop(y - F.col("fitted")).over(w) * band
    return line.select(
        *keys, time, value, "fitted",
        (F.col("fitted") - spread).alias("lower"),
        (F.col("fitted") + spread).alias("upper"),
    )


def trend_confidence(trends):
    return trends.withColumn("trend_confidence", to_unit(F.col("r2")))


def change_thresholds(df, changes, high=0.95, low=0.05):
    """Upper and lower quantile of each change series as one row."""
    return df.agg(*[
        F.percentile(c, q).alias(f"{c}_{side}") for c in changes for side, q in (("high", high), ("low", low))
    ])


def align_on(left, others, on="date"):
    """Other series on the dates of the first one."""
    return reduce(lambda a, b: a.join(b, on, "left"), others, left)


def date_spine(df, time="date", days=105 * 7):
    """Every calendar day of the last ``days`` up to the table's newest day."""
    return df.agg(F.max(time).alias("last")).select(
        F.explode(F.sequence(F.date_sub("last", days - 1), "last")).alias("date")
    )


def mean_recent_change(df, value, rows=30, time="date"):
    recent = tail_rows(df, rows, time)
    step = F.col(value) - F.lag(value).over(Window.orderBy(time))
    return recent.select(step.alias("step")).agg(F.avg("step").alias("mean_change"))


def min_max_position(df, value, out):
    """Value scaled to 0..1 over the table."""
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    return df.withColumn("_span", span).withColumn(
        out, min_max_scale(F.col(value), F.col("_span.lo"), F.col("_span.hi"))
    ).drop("_span")


def clip_change(c, unit, bound):
    return clip(c / F.lit(unit), -bound, bound)
