"""Operators on vertical profiles: one row per level, keyed by (dac, profile_idx).

Levels are first combined per distinct pressure with map-side aggregation, so a profile that holds a
large share of all levels is reduced before it meets in one place; what then meets is at most one
row per distinct pressure. Windows over those rows stream and spill.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import physics as P
from ..functions.numeric import degrees_between, to_unit

KEY = ["dac", "profile_idx"]


def valid_levels(levels):
    return levels.where(
        F.col("pres").between(0, 10000)
        & (F.col("temp") > -5) & (F.col("temp") < 45)
        & (F.col("psal") > 0) & (F.col("psal") < 50)
    )


def choose_adjusted(levels, variables=("temp", "psal", "pres"), share=0.5):
    """Per store, take the adjusted variable if it has at least ``share`` of the raw valid values.

    A variable without an adjusted column stays raw, and so does every level without a store. The choice
    is one small map from store to flags, read as a subquery: the levels are not shuffled.
    """
    variables = [v for v in variables if f"{v}_adjusted" in levels.columns]
    if not variables:
        return levels
    counts = levels.where("dac is not null").groupBy("dac").agg(
        F.struct(*[
            (F.count(f"{v}_adjusted") >= F.lit(share) * F.count(v)).alias(v) for v in variables
        ]).alias("use")
    )
    choice = counts.agg(F.map_from_entries(F.collect_list(F.struct("dac", "use")))).scalar()
    picked = levels.withColumn("_use", F.try_element_at(choice, F.col("dac")))
    return picked.withColumns(
        {v: F.when(F.col(f"_use.{v}"), F.col(f"{v}_adjusted")).otherwise(F.col(v)) for v in variables}
    ).drop("_use", *[f"{v}_adjusted" for v in variables])


def with_density(levels):
    return levels.withColumn("rho", P.seawater_density(F.col("temp"), F.col("psal"), F.col("pres")))


def unique_pressures(levels):
    """One row per profile and pressure: the first level wins, sums over all levels are carried along."""
    first_with_density = F.when(F.col("rho").isNotNull(), F.col("level_idx"))
    return levels.groupBy(*KEY, "pres").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("level_idx").alias("level_idx"),
        F.min_by("temp", "level_idx").alias("temp"),
        F.min_by("psal", "level_idx").alias("psal"),
        F.min_by("rho", first_with_density).alias("rho"),
        F.sum("temp").alias("sum_temp"),
        F.sum("psal").alias("sum_psal"),
        F.sum("rho").alias("sum_rho"),
        F.count("rho").alias("n_rho"),
    )


def vertical_steps(unique):
    """Each pressure with its upper neighbour, for temperature and for density."""
    w = Window.partitionBy(*KEY).orderBy("pres")
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    dense = F.col("rho").isNotNull()
    step = unique.withColumns(
        {
            "p_up": F.lag("pres").over(w),
            "t_up": F.lag("temp").over(w),
            "rho_top": F.first("rho", ignorenulls=True).over(upto),
            "rp_up": F.last(F.when(dense, F.col("pres")), ignorenulls=True).over(above),
            "rho_up": F.last("rho", ignorenulls=True).over(above),
        }
    )
    dp = F.col("pres") - F.col("p_up")
    excess = F.col("rho") - F.col("rho_top")
    excess_up = F.col("rho_up") - F.col("rho_top")
    share = (F.lit(K.MLD_DELTA) - excess_up) / (excess - excess_up)
    return step.withColumns(
        {
            "t_grad": F.when(F.col("p_up") >= K.THERMOCLINE_MIN_PRES, (F.col("temp") - F.col("t_up")) / dp),
            "p_mid": (F.col("p_up") + F.col("pres")) / 2.0,
            "heat": F.when(F.col("pres") <= K.HEAT_CONTENT_MAX_PRES, (F.col("temp") + F.col("t_up")) / 2.0 * dp),
            "rho_grad": (F.col("rho") - F.col("rho_up")) / (F.col("pres") - F.col("rp_up")),
            "mixed_depth": F.when(
                excess > K.MLD_DELTA, F.col("rp_up") + share * (F.col("pres") - F.col("rp_up"))
            ),
        }
    )


def profile_measures(levels, min_levels=5):
    """All measures of a profile from its valid levels; profiles with too few levels are dropped."""
    steps = vertical_steps(unique_pressures(with_density(levels)))
    surface = F.col("pres") <= K.SURFACE_PRES
    upper = F.col("rp_up") <= K.UPPER_PRES
    rho_grad = F.col("rho_grad")
    n2 = F.lit(K.GRAVITY / K.RHO_WATER) * rho_grad
    total = steps.groupBy(*KEY).agg(
        F.sum("n").cast("int").alias("n_valid_levels"),
        F.count("rho").alias("n_rho_unique"),
        F.count_if(F.col("pres") >= K.THERMOCLINE_MIN_PRES).alias("n_deep"),
        F.count_if(F.col("pres") <= K.HEAT_CONTENT_MAX_PRES).alias("n_heat"),
        F.sum(F.when(surface, F.col("n"))).alias("n_surface"),
        F.sum(F.when(surface, F.col("n_rho"))).alias("n_surface_rho"),
        F.sum(F.when(surface, F.col("sum_temp"))).alias("surface_temp"),
        F.sum(F.when(surface, F.col("sum_psal"))).alias("surface_psal"),
        F.sum(F.when(surface, F.col("sum_rho"))).alias("surface_rho"),
        F.min_by("mixed_depth", F.when(F.col("mixed_depth").isNotNull(), F.col("pres"))).alias("mixed"),
        F.min_by("p_mid", F.when(F.col("t_grad").isNotNull(), F.struct("t_grad", "pres"))).alias("steepest"),
        F.avg(F.when(upper, F.abs(rho_grad))).alias("strat_upper"),
        F.avg(F.abs(rho_grad)).alias("strat_all"),
        F.avg(n2).alias("n2_mean"),
        F.max(n2).alias("n2_max"),
        F.sum("heat").alias("heat"),
    )
    enough_rho = F.col("n_rho_unique") >= 3
    thermo = F.when((F.col("n_valid_levels") >= 5) & (F.col("n_deep") >= 3), F.col("steepest"))
    mixed = F.when(enough_rho, F.col("mixed"))
    return total.where(F.col("n_valid_levels") >= min_levels).select(
        *KEY,
        "n_valid_levels",
        F.try_divide("surface_temp", "n_surface").alias("sst_argo"),
        F.try_divide("surface_psal", "n_surface").alias("sss_argo"),
        F.try_divide("surface_rho", "n_surface_rho").alias("surf_density"),
        F.when(mixed.between(0, K.MLD_MAX), mixed).alias("mld"),
        F.when(thermo.between(0, K.MLD_MAX), thermo).alias("thermocline"),
        F.when(enough_rho, F.coalesce("strat_upper", "strat_all")).alias("strat_index"),
        F.when(enough_rho, F.col("n2_mean")).alias("mean_N2"),
        F.when(enough_rho, F.col("n2_max")).alias("max_N2"),
        F.when(
            (F.col("n_valid_levels") >= 3) & (F.col("n_heat") >= 2),
            F.lit(K.RHO_WATER * K.HEAT_CAPACITY) * F.col("heat"),
        ).alias("ohc_700m"),
    )


def profile_physics(levels, heads):
    """Measures joined to position and time; profiles without a position are dropped.

    Levels may be raw with adjusted columns, of which the better ones are taken, and heads may have the
    raw time ``juld`` (nanoseconds) in place of ``time``.
    """
    if "time" not in heads.columns and "juld" in heads.columns:
        heads = heads.withColumn("time", P.decode_profile_time(F.col("juld"))).drop("juld")
    placed = heads.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return profile_measures(valid_levels(choose_adjusted(levels))).join(placed, KEY)


def with_confidence(profiles):
    """Sensor errors, confidence parts and the weighted confidence of each profile."""
    mld, thermo = F.col("mld"), F.col("thermocline")
    consistency = (
        F.when(mld < thermo, 1.0)
        .when(mld >= thermo, 0.5)
        .when(mld.isNull() & thermo.isNull(), 0.5)
        .otherwise(0.75)
    )
    out_of_range = F.coalesce((F.col("sst_argo") < -2) | (F.col("sst_argo") > 40), F.lit(False))
    too_deep = F.coalesce(mld > 500, F.lit(False))
    bounds = F.when(out_of_range, 0.3).otherwise(1.0) * F.when(too_deep, 0.7).otherwise(1.0)
    return (
        profiles.withColumns(
            {
                "temp_uncertainty": F.lit(K.TEMP_ERROR),
                "psal_uncertainty": F.lit(K.PSAL_ERROR),
                "density_uncertainty": F.lit(K.DENSITY_ERROR),
                "mld_uncertainty": F.lit(K.MLD_ERROR),
                "ohc_uncertainty": F.lit(K.OHC_ERROR),
                "C_sampling": to_unit(F.col("n_valid_levels") / 50.0),
                "C_instrument": F.lit(1.0 - K.TEMP_ERROR / 35.0),
                "C_physics": consistency,
                "C_bounds": bounds,
                "sparse_flag": F.coalesce(F.col("n_valid_levels") < 10, F.lit(False)),
            }
        )
        .withColumn(
            "confidence",
            to_unit(
                0.25 * F.coalesce("C_sampling", F.lit(0.5))
                + 0.25 * F.col("C_instrument")
                + 0.30 * F.col("C_physics")
                + 0.20 * F.col("C_bounds")
            ),
        )
    )


def nearest_profile(profiles, lat, lon):
    """The profile nearest to a position as a one-row frame; lowest key on ties."""
    d = degrees_between(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    return profiles.where(d.isNotNull()).agg(
        F.min_by(F.struct(*KEY, "lat", "lon"), F.struct(d.alias("d"), *KEY)).alias("hit"),
        F.min(d).alias("distance"),
    ).where("hit is not null").select("hit.*", "distance")


def profile_at(levels, profiles, lat, lon):
    """The valid levels of the profile nearest to a position, in pressure order."""
    hit = nearest_profile(profiles, lat, lon)
    return valid_levels(levels).join(hit.select(*KEY), KEY, "left_semi").orderBy("pres", "level_idx")
