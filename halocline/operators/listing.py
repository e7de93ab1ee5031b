"""Normalising foreign tables, and filtering, ordering and paging of profile lists."""

from pyspark.sql import functions as F

from ..functions.labels import basin_of
from ..functions.numeric import degrees_between, nan_to_null
from ..functions.text import contains_ignore_case, id_prefix, matches_ignore_case

# Accepted names of the float identifier and of day-table columns.
FLOAT_NAMES = ["platform_number", "PLATFORM_NUMBER", "wmo_id", "float"]
INTENSITY_NAMES = ["mean_intensity", "peak_intensity", "mhw_intensity"]


def normalise_profiles(df):
    """Canonical names and defaults for a profile table of unknown origin.

    The profile id ends in the stable key of the profile instead of a row position, which a
    distributed table does not have.
    """
    have = set(df.columns)
    new = {}
    if "latitude" not in have:
        new["latitude"] = F.col("lat") if "lat" in have else F.lit(0.0)
    if "longitude" not in have:
        new["longitude"] = F.col("lon") if "lon" in have else F.lit(0.0)
    df = df.withColumns(new) if new else df
    if "float_id" not in have:
        alias = next((c for c in FLOAT_NAMES if c in have), None)
        position = F.concat_ws("_", *[F.round(c, 2).cast("string") for c in ("latitude", "longitude")])
        df = df.withColumn("float_id", F.col(alias).cast("string") if alias else position)
    if "profile_id" not in have:
        day = F.coalesce(F.date_format("time", "yyyyMMdd"), F.lit("00000000"))
        key = [F.col(c).cast("string") for c in ("dac", "profile_idx") if c in have]
        df = df.withColumn("profile_id", F.concat_ws("_", "float_id", day, *key))
    rest = {}
    if "basin" not in have:
        rest["basin"] = basin_of(F.col("latitude"), F.col("longitude"))
    if "confidence" not in have:
        rest["confidence"] = F.lit(0.8)
    if "sparse_flag" not in have:
        rest["sparse_flag"] = F.lit(False)
    if "sst_argo" not in have and "sst" in have:
        rest["sst_argo"] = F.col("sst")
    return df.withColumns(rest) if rest else df


def normalise_days(df):
    """Canonical day table: ``date``, ``is_mhw``, ``intensity``."""
    have = set(df.columns)
    day = F.to_date(F.col("date" if "date" in have else "time"))
    if "is_mhw" in have:
        hot = F.col("is_mhw").cast("boolean")
    elif "category" in have:
        hot = F.col("category") > 0
    elif "intensity" in have:
        hot = F.col("intensity") > 0
    else:
        hot = F.lit(False)
    alias = next((c for c in ["intensity", *INTENSITY_NAMES] if c in have), None)
    value = nan_to_null(F.col(alias).try_cast("double")) if alias else hot.cast("double")
    return df.select(
        day.alias("date"), F.coalesce(hot, F.lit(False)).alias("is_mhw"), F.coalesce(value, F.lit(0.0)).alias("intensity")
    )


def search(df, needle, pattern=False):
    if not needle.strip():
        return df
    test = matches_ignore_case if pattern else contains_ignore_case
    return df.where(test(F.col("float_id"), needle) | test(F.col("profile_id"), needle))


def in_basin(df, basin):
    return df if basin in (None, "", "All Basins") else df.where(F.col("basin") == basin)


def nearby(df, lat, lon, radius=2.0):
    """Rows in a square around a position, with their distance."""
    return df.where(
        F.col("latitude").between(lat - radius, lat + radius) & F.col("longitude").between(lon - radius, lon + radius)
    ).withColumn("distance", degrees_between(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon)))


def between_times(df, start=None, end=None, time="time"):
    if start:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end:
        df = df.where(F.col(time) <= F.lit(end).cast("timestamp"))
    return df


def order_profiles(df, sort="time_desc", by_distance=False):
    first = {
        "time_asc": F.asc_nulls_last("time"),
        "sst_desc": F.desc_nulls_last("sst_argo"),
        "confidence_desc": F.desc_nulls_last("confidence"),
    }.get(sort, F.desc_nulls_last("time"))
    return df.orderBy(F.col("distance") if by_distance else first, "profile_id")


def page(df, number=1, per_page=20):
    """One page of an ordered list; planned as a top-k of offset plus page size."""
    return df.offset((number - 1) * per_page).limit(per_page)


def page_after(df, last_time, last_id, per_page=20):
    """The page after a known row of the newest-first order, at the same cost for every depth."""
    t = F.lit(last_time).cast("timestamp")
    later = (F.col("time") < t) | ((F.col("time") == t) & (F.col("profile_id") > last_id)) | F.col("time").isNull()
    return order_profiles(df.where(later)).limit(per_page)


def profile_by_id(df, profile_id):
    """The row of a profile id, else the first row of the float named by the id's prefix."""
    want = F.lit(profile_id)
    exact = F.col("profile_id") == want
    candidates = df.where(exact | (F.col("float_id") == id_prefix(want))).withColumn("_rank", F.when(exact, 0).otherwise(1))
    return candidates.orderBy("_rank", "profile_id").limit(1).drop("_rank")


def top_sample(df, keys, n):
    """At most ``n`` rows, chosen by a hash of the key's text: random in effect and the same on every run."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


def first_match(trends, keyword, value="slope_per_year"):
    """The value of the first variable whose name holds the keyword, else 0."""
    return trends.agg(_first_value(keyword, value).alias("value"))


def first_matches(trends, keywords, value="slope_per_year"):
    """``first_match`` for several keywords in one pass, one column per output name."""
    return trends.agg(*[_first_value(k, value).alias(name) for name, k in keywords.items()])


def _first_value(keyword, value):
    hit = F.contains(F.lower("variable"), F.lit(keyword.lower()))
    return F.coalesce(F.min_by(F.when(hit, F.col(value)), F.when(hit, F.col("variable"))), F.lit(0.0))
