"""Incremental runs: new data only, once each, with Structured Streaming.

The high-water mark of a batch run is the stream's checkpoint here. Merged results are kept as one
folder per micro-batch, so a merge writes only the new rows; readers drop what later batches replace.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grid


def new_dates(df, last=None, time="time"):
    """Dates after the mark; all of them on the first run. Dates at or before it never come back."""
    dates = df.select(F.col(time).alias("date")).distinct()
    return dates if last is None else dates.where(F.col("date") > last)


def open_stream(spark, path, schema=None, file_format="parquet", options=None, files_per_batch=None):
    """Files of a folder as a stream; the schema is that of the stored table unless given."""
    schema = schema or spark.read.format(file_format).load(path).schema
    reader = spark.readStream.format(file_format).schema(schema).options(**(options or {}))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def process_available(stream, target, checkpoint, partition_by=(), state_partitions=None):
    """Append everything not yet processed to ``target`` and commit it in the checkpoint.

    The first run of a stateful stream fixes the number of state partitions for good, so a stream with
    little state (open days, one run length per series) names a small one.
    """
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .partitionBy(*partition_by)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        conf.set("spark.sql.shuffle.partitions", before)


def append_profiles(spark, source, target, checkpoint, schema, file_format="csv"):
    """Arriving profile files to the profile table; rows without a valid time are dropped."""
    options = {"header": "true"} if file_format == "csv" else {}
    rows = open_stream(spark, source, schema, file_format, options)
    dated = rows.withColumn("time", F.try_to_timestamp("time")).where("time is not null")
    process_available(dated, target, checkpoint)


def write_batch(batch, batch_id, target, date):
    """One micro-batch as its own folder, and its first date in a small table beside it.

    A repeated batch replaces itself.
    """
    rows, firsts = f"{target}/rows/batch_id={batch_id}", f"{target}/firsts/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(rows)
    stored = batch.sparkSession.read.schema(batch.schema).parquet(rows)
    stored.agg(F.min(date).alias("first")).write.mode("overwrite").parquet(firsts)


def merge_stream(stream, target, checkpoint, date):
    query = (
        stream.writeStream.foreachBatch(lambda df, i: write_batch(df, i, target, date))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_merged(spark, target, date="date"):
    """The merged table: a batch keeps its rows before the first date of every later batch.

    One row per batch decides; as a stored table its size is known and Spark broadcasts it while small.
    """
    later = Window.orderBy("batch_id").rowsBetween(1, Window.unboundedFollowing)
    firsts = spark.read.parquet(f"{target}/firsts")
    limits = firsts.select("batch_id", F.min("first").over(later).alias("limit"))
    return (
        spark.read.parquet(f"{target}/rows")
        .join(limits, "batch_id")
        .where(F.col("limit").isNull() | (F.col(date) < F.col("limit")))
        .drop("limit", "batch_id")
    )


def fold_merged(spark, target, folded, date="date"):
    """Write the merged table as one first batch of a new target; later batches of the stream go there.

    Superseded rows and the folders of single batches stay behind in ``target``, which can be removed.
    """
    rows = f"{folded}/rows/batch_id=-1"
    read_merged(spark, target, date).write.parquet(rows)
    spark.read.parquet(rows).agg(F.min(date).alias("first")).write.parquet(f"{folded}/firsts/batch_id=-1")


def drop_late(df, mark, time="time"):
    """Rows at or before the mark are late and dropped."""
    return df.where(F.col(time) > mark) if mark is not None else df


def closed_days(stream, thresholds, delay="1 day", value="sst"):
    """Daily heatwave metrics of a stream against a frozen threshold table, one row per closed day.

    Days are UTC days whatever the session's time zone; watermarks need instants, not ``timestamp_ntz``.
    """
    x = F.col("intensity")
    hot = grid.intensity_against(stream.withWatermark("time", delay), thresholds, value)
    daily = hot.groupBy(F.window("time", "1 day").alias("w")).agg(
        F.count(x).alias("n_valid"),
        F.count_if(x > 0).alias("n_above"),
        F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("mean_intensity"),
        F.max(x).alias("max_intensity"),
    )
    return daily.select(
        F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int")).alias("date"),
        F.try_divide("n_above", "n_valid").alias("frac_mhw"),
        "mean_intensity",
        "max_intensity",
    )
