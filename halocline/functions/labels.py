"""Phase, category and region labels as Column expressions."""

from itertools import chain

from pyspark.sql import functions as F

from .. import constants as K


def _phase(value, bound, high, middle, low):
    return (
        F.when(value.isNull(), "unknown")
        .when(value >= bound, high)
        .when(value <= -bound, low)
        .otherwise(middle)
    )


def enso_phase(value):
    return _phase(value, 0.5, "El Nino", "Neutral", "La Nina")


def iod_phase(value):
    return _phase(value, 0.4, "Positive IOD", "Neutral IOD", "Negative IOD")


def pdo_phase(value):
    return _phase(value, 0.5, "Positive PDO", "Neutral PDO", "Negative PDO")


def heatwave_category(max_intensity):
    return (
        F.when(max_intensity.isNull() | (max_intensity <= 0), 0)
        .when(max_intensity < 2, 1)
        .when(max_intensity < 3, 2)
        .when(max_intensity < 4, 3)
        .otherwise(4)
    )


def literal_map(mapping):
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])


def category_label(category):
    return F.coalesce(F.try_element_at(literal_map(K.HEATWAVE_CATEGORY_LABELS), category), F.lit("Unknown"))


def day_label(is_mhw, intensity):
    return (
        F.when(~is_mhw, "Normal")
        .when(intensity >= 3, "Severe")
        .when(intensity >= 2, "Moderate")
        .otherwise("Mild MHW")
    )


def basin_of(lat, lon):
    """One basin per position; the first matching rule wins."""
    north = lat.between(5, 25)
    return (
        F.when(north & lon.between(80, 100), "Bay of Bengal")
        .when(north & lon.between(55, 80), "Arabian Sea")
        .when(lat < -15, "Southern Indian Ocean")
        .when(lat.between(-5, 5), "Equatorial Indian Ocean")
        .otherwise("Indian Ocean")
    )


def basins_of(lat, lon):
    """Array of all overlapping basin boxes that hold a position."""
    hits = [F.when(lat.between(a, b) & lon.between(c, d), F.lit(name)) for name, a, b, c, d in K.BASIN_BOXES]
    return F.array_compact(F.array(*hits))


def risk_level(probability):
    return (
        F.when(probability >= 0.7, "High")
        .when(probability >= 0.5, "Elevated")
        .when(probability >= 0.3, "Moderate")
        .otherwise("Low")
    )


def trend_direction(slope):
    return F.when(slope > 0.001, "rising").when(slope < -0.001, "falling").otherwise("stable")


def trend_key(variable):
    known = F.try_element_at(literal_map(K.TREND_KEYS), variable)
    return F.coalesce(known, F.replace(F.lower(variable), F.lit(" "), F.lit("_")))


def month_name(month):
    return F.element_at(F.array(*[F.lit(m) for m in K.MONTH_NAMES]), month)
