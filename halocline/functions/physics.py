"""Sea-surface and water-column formulas as Column expressions."""

from functools import reduce

from pyspark.sql import functions as F

from .. import constants as K
from .numeric import clip

# Coefficients of the 1983 international equation of state of sea water, lowest
# power of temperature first; one list per factor (powers of salinity S and pressure P in bar).
DENSITY_WATER = [999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9]
DENSITY_S = [8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9]
DENSITY_S15 = [-5.72466e-3, 1.0227e-4, -1.6546e-6]
DENSITY_S2 = [4.8314e-4]
BULK_WATER = [19652.21, 148.4206, -2.327105, 1.360477e-2, -5.155288e-5]
BULK_P = [3.239908, 1.43713e-3, 1.16092e-4, -5.77905e-7]
BULK_P2 = [8.50935e-5, -6.12293e-6, 5.2787e-8]
BULK_S = [54.6746, -0.603459, 1.09987e-2, -6.1670e-5]
BULK_S15 = [7.944e-2, 1.6483e-2, -5.3009e-4]


def polynomial(x, coefficients):
    return reduce(lambda acc, k: acc * x + F.lit(k), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def seawater_density(temp, psal, pres):
    """Density in kg/m3 from temperature, salinity and pressure in dbar; unrealistic results are NULL."""
    bar = pres / 10.0
    salt = F.when(psal >= 0, psal).otherwise(F.lit(0.0))
    salt15 = salt * F.sqrt(salt)
    surface = (
        polynomial(temp, DENSITY_WATER)
        + polynomial(temp, DENSITY_S) * salt
        + polynomial(temp, DENSITY_S15) * salt15
        + polynomial(temp, DENSITY_S2) * salt * salt
    )
    bulk = (
        polynomial(temp, BULK_WATER)
        + polynomial(temp, BULK_P) * bar
        + polynomial(temp, BULK_P2) * bar * bar
        + polynomial(temp, BULK_S) * salt
        + polynomial(temp, BULK_S15) * salt15
    )
    density = F.try_divide(surface, F.lit(1.0) - F.try_divide(bar, bulk))
    return F.when(density.between(*K.DENSITY_RANGE), density)


def wind_speed(u, v):
    return F.sqrt(u * u + v * v)


def wind_stress(component, speed):
    return F.lit(K.RHO_AIR * K.DRAG) * speed * component


def coriolis(lat):
    f = F.lit(2 * K.OMEGA) * F.sin(F.radians(lat))
    return F.when(F.abs(f) >= K.MIN_CORIOLIS, f)


def net_heat_flux(ssr, str_, slhf, sshf):
    return clip(ssr + str_ + slhf + sshf, *K.QNET_RANGE)


def wind_mixing_index(speed, mld):
    stress = F.lit(K.RHO_AIR * K.DRAG) * speed * speed
    return F.when(mld > 0, stress * stress * stress / (F.lit(K.RHO_WATER) * mld))


def unit_component(component, magnitude, scale=1.5):
    """Component of a unit vector times ``scale``; a zero vector stays zero."""
    return component / F.when(magnitude > 0, magnitude).otherwise(F.lit(1.0)) * F.lit(scale)


def decode_profile_time(ns, valid=K.PROFILE_TIME_VALID):
    """Nanoseconds since 1970 to a timestamp; missing, non-positive and out-of-period values are NULL."""
    # a decimal holds every 64-bit integer, which a double does not; NaN has none
    t = F.timestamp_micros(F.floor(ns.try_cast("decimal(20,0)") / 1000).cast("long"))
    low, high = (F.lit(v).cast("timestamp") for v in valid)
    return F.when((ns > 0) & t.between(low, high), t)
