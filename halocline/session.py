"""Session settings and the shared scratch folder."""

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name="halocline", master=None, extra=None):
    """A session with adaptive execution on; cluster sizing is left to the submit command."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_shuffles(spark, input_bytes, partition_bytes=1024 * 1024 * 1024):
    """Enough shuffle partitions for an input size; adaptive execution joins those that stay small.

    A gigabyte each keeps the map statuses of 100 TB within a driver's memory. Name the bytes after
    pruning of columns and years.
    """
    wanted = -(-int(input_bytes) // partition_bytes)
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(now, wanted)))


def shared_dir(spark, purpose):
    """A new folder for written tables and stream checkpoints.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests, a temporary folder is taken and recorded in the session.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"name a shared folder in {CHECKPOINT_CONF}; executors of {master} do not share local ones")
        base = tempfile.mkdtemp(prefix="halocline-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def written(df, purpose):
    """``df`` written once to the shared folder and read back: computed once, with its lineage cut."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
