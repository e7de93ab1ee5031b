"""Climate-index context. No broadcast hints: Spark picks the join by measured size."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.labels import enso_phase, iod_phase, pdo_phase

INDEX_COLUMNS = ["enso", "dmi", "pdo"]


def index_table(indices):
    """Indices keyed by day."""
    return indices.select(F.to_date("time").alias("date"), *INDEX_COLUMNS)


def with_phases(df, phases=("enso_phase", "iod_phase", "pdo_phase")):
    makers = {
        "enso_phase": enso_phase(F.col("enso")),
        "iod_phase": iod_phase(F.col("dmi")),
        "pdo_phase": pdo_phase(F.col("pdo")),
    }
    return df.withColumns({p: makers[p] for p in phases})


def with_climate(df, indices, phases=("enso_phase", "iod_phase", "pdo_phase")):
    """Index values and phases by day; days without an index row get NULL and ``unknown``."""
    return with_phases(df.join(index_table(indices), "date", "left"), phases)


def profiles_with_climate(profiles, indices):
    """Index values by the day of the profile time."""
    by_day = index_table(indices).select("date", "enso", "dmi")
    return profiles.withColumn("date", F.to_date("time")).join(by_day, "date", "left").drop("date")


def monthly_indices(indices):
    return index_table(indices).groupBy(F.trunc("date", "month").alias("month_start")).agg(
        *[F.avg(c).alias(c) for c in INDEX_COLUMNS]
    )


def months_with_climate(monthly, indices):
    """Monthly rows with the month means of the indices, one row per month."""
    return with_phases(monthly.join(monthly_indices(indices), "month_start", "left"))


def pdo_context(indices, recent=90):
    """Mean PDO of the record and of its last rows, with phases."""
    w = Window.orderBy(F.desc("date"))
    ranked = index_table(indices).withColumn("_rn", F.row_number().over(w))
    means = ranked.agg(
        F.avg("pdo").alias("pdo_mean"),
        F.avg(F.when(F.col("_rn") <= recent, F.col("pdo"))).alias("pdo_recent"),
    )
    return means.withColumns(
        {
            "pdo_mean_phase": pdo_phase(F.col("pdo_mean")),
            "pdo_recent_phase": pdo_phase(F.col("pdo_recent")),
        }
    )


def phase_counts(df, condition=None):
    """Row counts per value of each phase, all phases in one pass with grouping sets."""
    kept = df.where(condition) if condition is not None else df
    phases = ["enso_phase", "iod_phase", "pdo_phase"]
    sets = kept.groupingSets([[p] for p in phases], *phases).agg(
        F.grouping("enso_phase").alias("g0"),
        F.grouping("iod_phase").alias("g1"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return sets.select(
        F.when(F.col("g0") == 0, "enso_phase").when(F.col("g1") == 0, "iod_phase").otherwise("pdo_phase").alias("kind"),
        F.coalesce(*phases).alias("phase"),
        "n_rows",
    )


def phase_composite(days):
    """Distribution of the maximum intensity on heatwave days per ENSO phase and per IOD phase."""
    flagged = days.where("is_mhw")
    long = flagged.select(
        F.explode(
            F.array(
                F.struct(F.lit("enso_phase").alias("kind"), F.col("enso_phase").alias("phase")),
                F.struct(F.lit("iod_phase").alias("kind"), F.col("iod_phase").alias("phase")),
            )
        ).alias("p"),
        "max_intensity",
    )
    return long.groupBy("p.kind", "p.phase").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg("max_intensity").alias("mean_value"),
        F.min("max_intensity").alias("min_value"),
        F.percentile("max_intensity", 0.25).alias("q25"),
        F.percentile("max_intensity", 0.5).alias("q50"),
        F.percentile("max_intensity", 0.75).alias("q75"),
        F.max("max_intensity").alias("max_value"),
    )
