"""Surface fields derived cell by cell; all narrow projections."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import physics as P
from . import axes as A
from . import grid as G


def wind_fields(surface):
    ws = F.col("wind_speed")
    return (
        surface.withColumn("wind_speed", P.wind_speed(F.col("u10"), F.col("v10")))
        .withColumns({"tau_x": P.wind_stress(F.col("u10"), ws), "tau_y": P.wind_stress(F.col("v10"), ws)})
        .withColumn("tau_mag", P.wind_speed(F.col("tau_x"), F.col("tau_y")))
    )


def ekman_transport(stress):
    f = P.coriolis(F.col("lat"))
    return stress.withColumns(
        {
            "ekman_x": F.try_divide(F.col("tau_y"), F.lit(K.RHO_WATER) * f),
            "ekman_y": F.try_divide(-F.col("tau_x"), F.lit(K.RHO_WATER) * f),
        }
    )


def heat_flux(surface):
    return surface.withColumn("qnet", P.net_heat_flux(*[F.col(c) for c in ("ssr", "str", "slhf", "sshf")]))


def qnet_dataset(surface):
    """Net heat flux with climatology and anomaly."""
    return G.with_anomaly(heat_flux(surface), "qnet", "qnet_anom", "qnet_clim")


def sst_dataset(sst):
    """Surface temperature with climatology and anomaly."""
    return G.with_anomaly(sst, "sst", "sst_anomaly", "sst_clim")


def stress_vectors(stress, step=0, stride=1, stored=None):
    """Unit vectors of the wind stress at one time step, counted from 0 or from the end if negative.

    With ``stored``, the folder of a written axis table, only that step of the field is read.
    """
    axes = A.values(stress, ["time", *(G.CELL if stride > 1 else [])]) if stored is None else None
    times = A.numbered(axes, "time") if stored is None else A.read_axis(stress.sparkSession, stored, "time")
    one = stress.where(F.col("time") == A.value_at(times, "time", step))
    mag = F.col("tau_mag")
    return G.spatial_stride(one, stride, axes, stored).select(
        "time", "lat", "lon", "tau_mag",
        P.unit_component(F.col("tau_x"), mag).alias("ux"),
        P.unit_component(F.col("tau_y"), mag).alias("uy"),
    )
