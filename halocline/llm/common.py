"""Helpers that several operators share."""

import numpy as np
from pyspark.sql import functions as F

from halocline.session import shared_dir

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark removes the shuffle files of a query when the query ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df, purpose):
    """Write ``df`` once to the shared folder and read it back, which also cuts its lineage.

    The shuffle files behind it go at once, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = shared_dir(spark, f"llm-{purpose}"), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column="text"):
    """The text with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column="text"):
    """128 bits that stand for a text, as two longs."""
    text = whole_text(column)
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("k2")


def mix64(x):
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def auc(labels, scores):
    """Area under the ROC curve, ties counted half."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    values, inverse, counts = np.unique(scores[order], return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks[order] = (ends - (counts - 1) / 2)[inverse]
    pos = labels == 1
    n, m = pos.sum(), (~pos).sum()
    return float((ranks[pos].sum() - n * (n + 1) / 2) / max(1, n * m))
