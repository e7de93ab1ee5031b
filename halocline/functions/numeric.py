"""Null-safe numeric helpers. Every function returns a Column."""

from pyspark.sql import functions as F


def nan_to_null(c):
    return F.when(~F.isnan(c), c)


def clip(c, low, high):
    """Clip that keeps NULL; ``least``/``greatest`` alone would replace it by a bound."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def flag(condition):
    return F.coalesce(condition, F.lit(False))


def count_true(condition):
    return F.count_if(flag(condition))


def finite_or(c, default=None, places=4):
    """``c`` as a rounded double; text that is no number, NaN and infinities give ``default``."""
    d = c.try_cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, F.lit(default).cast("double")).otherwise(F.round(d, places))


def min_max_scale(c, low, high):
    """Position of ``c`` between ``low`` and ``high``; 0.5 when the range is flat."""
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.when(c.isNotNull(), F.lit(0.5)))


def round_significant(c, digits=4):
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, c).otherwise(F.round(c * scale) / scale)


def bin_floor(c, width=2):
    """Lower edge of the bin of ``c``; negative values go down, unlike ``div``."""
    return F.floor(c / F.lit(float(width))).cast("double") * F.lit(float(width))


def to_unit(c):
    return clip(c, 0.0, 1.0)


def degrees_between(lat_a, lon_a, lat_b, lon_b):
    """Plane distance in degrees."""
    return F.sqrt((lat_a - lat_b) * (lat_a - lat_b) + (lon_a - lon_b) * (lon_a - lon_b))
