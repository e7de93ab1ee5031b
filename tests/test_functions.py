import math

import pytest
from pyspark.sql import functions as F

from halocline.functions import arrays as A
from halocline.functions import labels as L
from halocline.functions import numeric as N
from halocline.functions import physics as P
from halocline.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def d(x):
    return F.lit(x).cast("double")


def test_clip_keeps_null(spark):
    assert value(spark, N.clip(d(None), -800.0, 600.0)) is None
    assert value(spark, N.clip(d(700.0), -800.0, 600.0)) == 600.0


def test_net_heat_flux_with_missing_part(spark):
    assert value(spark, P.net_heat_flux(d(None), d(-40), d(-60), d(-5))) is None
    assert value(spark, P.net_heat_flux(d(2000), d(-40), d(-60), d(-5))) == 600.0


def test_ekman_factor_missing_at_equator(spark):
    assert value(spark, P.coriolis(d(0.0))) is None
    assert value(spark, P.coriolis(d(30.0))) == pytest.approx(7.2921e-5)


def test_density_of_negative_and_missing_salinity_is_that_of_fresh_water(spark):
    fresh = value(spark, P.seawater_density(d(4.0), d(0.0), d(100.0)))
    assert fresh is not None
    assert value(spark, P.seawater_density(d(4.0), d(-1.0), d(100.0))) == fresh
    assert value(spark, P.seawater_density(d(4.0), d(None), d(100.0))) == fresh


def test_density_reference_value(spark):
    # Published check value of the equation of state: S 35, T 5, P 0 gives 1027.67547.
    assert value(spark, P.seawater_density(d(5.0), d(35.0), d(0.0))) == pytest.approx(1027.67547, abs=1e-5)


def test_nan_never_counts_as_large(spark):
    nan = F.lit(float("nan"))
    assert value(spark, N.flag(N.nan_to_null(nan) > 2)) is False


@pytest.mark.parametrize("v,phase", [(0.5, "El Nino"), (-0.5, "La Nina"), (0.49, "Neutral"), (None, "unknown")])
def test_phase_bounds_are_inclusive(spark, v, phase):
    assert value(spark, L.enso_phase(d(v))) == phase


@pytest.mark.parametrize("v,c", [(0.0, 0), (-1.0, 0), (1.99, 1), (2.0, 2), (3.0, 3), (4.0, 4)])
def test_categories(spark, v, c):
    assert value(spark, L.heatwave_category(d(v))) == c


def test_basin_tie_at_lon_80(spark):
    assert value(spark, L.basin_of(d(10.0), d(80.0))) == "Bay of Bengal"
    assert value(spark, L.basins_of(d(10.0), d(80.0))) == ["Arabian Sea", "Bay of Bengal"]


def test_bins_go_down_for_negative_values(spark):
    assert value(spark, N.bin_floor(d(-0.5))) == -2.0


@pytest.mark.parametrize("raw,out", [("1.23456", 1.2346), ("abc", -9.0), ("NaN", -9.0), ("Infinity", -9.0), (None, -9.0)])
def test_finite_or_default(spark, raw, out):
    assert value(spark, N.finite_or(F.lit(raw), -9.0)) == out


def test_round_significant(spark):
    assert value(spark, N.round_significant(d(5.026846e10), 4)) == 5.027e10
    assert value(spark, N.round_significant(d(0.0), 4)) == 0.0


def test_profile_time(spark):
    inside = F.lit(1_600_000_000_000_000_000).cast("long")
    assert value(spark, F.date_format(P.decode_profile_time(inside), "yyyy-MM-dd")) == "2020-09-13"
    exact = F.lit(1_600_000_000_123_456_789).cast("long")
    assert value(spark, F.unix_micros(P.decode_profile_time(exact))) == 1_600_000_000_123_456
    assert value(spark, P.decode_profile_time(F.lit(float("nan")))) is None
    for bad in (0, -5, 10**18, 4 * 10**18):
        assert value(spark, P.decode_profile_time(F.lit(bad).cast("long"))) is None


def test_arrays(spark):
    a = F.array(*[F.lit(x) for x in (3.0, 1.0, 2.0, 1.0)])
    assert value(spark, A.array_unique_sorted(a)) == [1.0, 2.0, 3.0]
    assert value(spark, A.array_diff(a)) == [-2.0, 1.0, -1.0]
    assert value(spark, A.array_argsort(a)) == [1, 3, 2, 0]
    assert value(spark, A.array_argmin(a)) == 1
    assert value(spark, A.array_trapezoid(a, F.array(*[F.lit(float(x)) for x in range(4)]))) == pytest.approx(5.0)
    assert value(spark, A.array_mean(F.array(F.lit(1.0), d(None), F.lit(3.0)))) == 2.0
    assert value(spark, A.array_diff(F.array(F.lit(1.0)))) == []


def test_charts(spark):
    text = F.lit('Before\n```json\n{"title": "A", "data": [{"x": "1", "y": 2}]}\n```\nmid ```json [{"type": "bar"}] ``` and ```json {bad ``` end')
    charts = value(spark, X.charts_of(text))
    assert [(c["type"], c["title"], c["x_label"], len(c["data"])) for c in charts] == [("line", "A", "X", 1), ("bar", "Chart", "X", 0)]
    assert value(spark, X.without_charts(text)) == "Before\n\nmid  and ```json {bad ``` end"


def test_wind_mixing_needs_positive_depth(spark):
    assert value(spark, P.wind_mixing_index(d(10.0), d(0.0))) is None
    stress = 1.225 * 1.3e-3 * 100
    assert value(spark, P.wind_mixing_index(d(10.0), d(20.0))) == pytest.approx(stress**3 / (1025 * 20))
    assert math.isclose(value(spark, P.unit_component(d(0.0), d(0.0))), 0.0)
