"""Readers. Every reader gives canonical names and NULL for NaN."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nan_to_null
from ..functions.physics import decode_profile_time

CANONICAL_NAMES = {"latitude": "lat", "longitude": "lon"}

# Column layout of the standard tables.
SCHEMAS = {
    "sst": "time timestamp, lat double, lon double, sst double",
    "wind": "time timestamp, lat double, lon double, u10 double, v10 double",
    "heat_flux": "time timestamp, lat double, lon double, ssr double, str double, slhf double, sshf double",
    "sla": "time timestamp, lat double, lon double, sla double",
    "indices": "time timestamp, enso double, dmi double, pdo double",
    "levels": "dac string, profile_idx long, level_idx long, pres double, temp double, psal double",
    "profiles": "dac string, profile_idx long, lat double, lon double, time timestamp",
    "upload": "time string, lat double, lon double, sst_argo double, mld double, ohc_700m double",
}


def canonical(df):
    """Short coordinate names, first depth level only, NaN to NULL."""
    df = df.withColumnsRenamed({old: new for old, new in CANONICAL_NAMES.items() if old in df.columns})
    if "zlev" in df.columns:
        first = df.agg(F.min("zlev")).scalar()
        df = df.where(F.col("zlev").isNull() | (F.col("zlev") == first)).drop("zlev")
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in floats}) if floats else df


def read_grid(spark, path, columns=None, start=None, end=None, box=None):
    """A long grid table; only the named columns are read, and only the years between start and end.

    ``start`` and ``end`` are dates, both included; ``box`` is (lat from, lat to, lon from, lon to).
    Column names are the canonical ones.
    """
    df = spark.read.parquet(path)
    stored = "year" in df.columns
    for bound, at in ((start, "__ge__"), (end, "__lt__")):
        if bound is not None:
            day = F.lit(bound).cast("date") if at == "__ge__" else F.date_add(F.lit(bound).cast("date"), 1)
            df = df.where(getattr(F.col("time"), at)(day.cast("timestamp")))
            if stored:
                year = F.year(F.lit(bound).cast("date"))
                df = df.where(F.col("year") >= year if at == "__ge__" else F.col("year") <= year)
    df = canonical(df)
    if box is not None:
        df = df.where(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:]))
    return df.select(*columns) if columns else df


def read_profiles(spark, path, dac=None):
    """Levels or heads stored by ``dac``; naming one reads only its folder."""
    df = spark.read.parquet(path)
    return canonical(df if dac is None else df.where(F.col("dac") == dac))


def read_result(spark, path, schema=None):
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_indices(spark, path):
    return canonical(spark.read.parquet(path)).select(
        "time", F.to_date("time").alias("date"), "enso", "dmi", "pdo"
    )


def read_years(spark, path, years=None, date="date"):
    """Only the chosen year folders; an error if none of them holds rows."""
    df = spark.read.parquet(path)
    if years is not None:
        df = df.where(F.col("year").isin(list(years)))
    if df.isEmpty():
        raise FileNotFoundError(f"no rows for years {years} in {path}")
    return df.withColumn(date, F.to_date(date)).drop("year")


def read_upload(spark, path, schema=SCHEMAS["upload"]):
    """Uploaded CSV with a header; fields that do not parse are NULL."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def first_existing(spark, names):
    """The first table of an ordered list that the catalog knows, with its name."""
    for name in names:
        if spark.catalog.tableExists(name):
            return spark.table(name), name
    raise FileNotFoundError(f"none of these tables exists: {', '.join(names)}")


def preview(df, n=5):
    """Row count, column names and the first rows in key order, as one row."""
    columns = list(df.columns)
    head = df.orderBy(*columns).limit(n).agg(F.collect_list(F.to_json(F.struct("*")))).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(", ".join(columns)).alias("columns"), head.alias("head")
    )


def parse_time(df, column="time"):
    """Text to timestamp; what does not parse is NULL."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column)))


def utc_instant(column):
    """A ``timestamp_ntz`` read as UTC, independent of the session's time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(column)))


def decode_time(df, ns="juld", out="time"):
    return df.withColumn(out, decode_profile_time(F.col(ns)))


def read_state(spark, path, dataset=None):
    """High-water marks per dataset: the newest committed mark wins."""
    state = spark.read.parquet(path).groupBy("dataset").agg(F.max_by("last_time", "committed_at").alias("last_time"))
    return state if dataset is None else state.where(F.col("dataset") == dataset)
