"""Small numeric-array helpers (bounded arrays such as one profile or one grid row)."""

from pyspark.sql import functions as F


def array_unique_sorted(a):
    return F.array_sort(F.array_distinct(a))


def array_diff(a):
    """Differences of neighbours; one element shorter than ``a``."""
    n = F.size(a)
    head = F.when(n > 1, F.slice(a, 1, F.greatest(n - 1, F.lit(1)))).otherwise(F.slice(a, 1, 0))
    tail = F.when(n > 1, F.slice(a, 2, F.greatest(n - 1, F.lit(1)))).otherwise(F.slice(a, 1, 0))
    return F.zip_with(head, tail, lambda x, y: y - x)


def array_mean(a):
    """Mean of the non-missing elements."""
    kept = F.array_compact(a)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(kept))


def array_trapezoid(y, x):
    """Integral of ``y`` over ``x`` by the trapezoid rule."""
    steps = F.zip_with(
        array_diff(x),
        F.zip_with(F.slice(y, 1, F.size(y)), F.slice(y, 2, F.size(y)), lambda a, b: (a + b) / 2.0),
        lambda dx, mid: dx * mid,
    )
    return F.aggregate(F.array_compact(steps), F.lit(0.0), lambda acc, v: acc + v)


def array_argmin(a):
    """Zero-based position of the smallest element, the first on ties."""
    return F.array_position(a, F.array_min(a)) - 1


def array_argsort(a):
    """Zero-based positions in ascending order of the elements, stable on ties."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def array_clip(a, low, high):
    return F.transform(a, lambda x: F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x))))


def quantile_of_sorted(a, q):
    """Linearly interpolated quantile of an ascending array without gaps; NULL for an empty one."""
    spot = F.lit(float(q)) * (F.size(a) - 1)
    low, high = F.get(a, F.floor(spot).cast("int")), F.get(a, F.ceil(spot).cast("int"))
    return F.when(F.size(a) > 0, low + (high - low) * (spot - F.floor(spot)))
