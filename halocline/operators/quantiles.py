"""Exact quantiles of large groups without collecting a group in one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import written

#: Distinct values of a range that is ordered in one task, about; and ranges per key, at most.
RANGE_VALUES, MOST_RANGES = 100_000, 1024


def _join_null_safe(left, right, keys):
    """Inner join on keys where NULL equals NULL; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(renamed, same).drop(*[f"_{k}" for k in keys])


def _ranges(counts, keys, splits):
    """``counts`` with the number of the range that holds each value, by a sketch of the distinct values."""
    if splits < 2:
        return counts.withColumn("part", F.lit(0))
    marks = [i / splits for i in range(1, splits)]
    sketch = counts.groupBy(*keys).agg(F.percentile_approx("v", marks, 10 * splits).alias("edges"))
    if keys:
        cut = _join_null_safe(counts, sketch, keys)
    else:
        cut = counts.withColumn("edges", sketch.select("edges").scalar())
    return cut.withColumn("part", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")


def exact_quantiles(df, value, probs, keys=(), range_values=RANGE_VALUES):
    """Linear-interpolated exact quantiles, one row per key and probability.

    Equal values are counted first (map-side) and written once; the input is not computed again. Distinct
    values are cut by a sketch into as many ranges as their number asks for, the ranges are counted, and only the
    values of ranges that hold a wanted rank are ordered. No step holds a whole group.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    counts = written(counts, "value-counts")
    cut = _ranges(counts, keys, min(MOST_RANGES, -(-counts.count() // range_values)))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*keys, "part").agg(F.sum("cnt").alias("n")).withColumns(
        {"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy(*keys))}
    )
    spot = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    spots = F.array(*[f(spot(p)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    parts = parts.where(F.exists(spots, lambda s: (s >= F.col("base")) & (s < F.col("base") + F.col("n")))).drop("n")
    kept = _join_null_safe(cut, parts, [*keys, "part"])
    inside = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = kept.withColumn("upto", F.col("base") + F.sum("cnt").over(inside))
    wanted = ranked.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    at = F.col("prob") * (F.col("total") - 1)
    low, high = F.floor(at), F.ceil(at)
    start = F.col("upto") - F.col("cnt")
    holds_low = (low >= start) & (low < F.col("upto"))
    holds_high = (high >= start) & (high < F.col("upto"))
    return (
        wanted.where(holds_low | holds_high)
        .groupBy(*keys, "prob")
        .agg(
            F.max(F.when(holds_low, F.col("v"))).alias("lo"),
            F.max(F.when(holds_high, F.col("v"))).alias("hi"),
            F.max(at - low).alias("w"),
        )
        .select(*keys, "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("quantile"))
    )
