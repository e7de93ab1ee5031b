"""Importance resampling of documents towards the word statistics of a target.

Texts are lower-cased (A-Z only) and split by an untrained pre-tokenizer, which gives words with offsets.
Features are windows of successive offset pairs, their words joined by one blank; a feature's bucket is the
CRC-32 of its bytes modulo the number of buckets. The bucket histograms of documents and target give every
bucket a gain, a document weighs the mean gain of its features, and Gumbel noise from a seeded hash of its
id turns weights into scores: the highest scores are a sample without replacement in proportion to the
exponentials of the weights.

Words are split once; the buckets of every text are written to the shared folder, and histogram and weights
read them there.
"""

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from halocline.llm.common import stored

#: What words are made of, after lower-casing: digits, a-z and everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words whose checksums a worker remembers.
REMEMBERED = 500_000
#: Rows of a batch that a task hands back, at most.
ROWS = 2048
#: Ranges of ids into which documents of one score are cut for ranking.
ID_RANGES = 1024


@dataclass(frozen=True)
class Features:
    """Runs of ``shortest`` to ``longest`` words, hashed to ``buckets``."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000


class Checksums(dict):
    """CRC-32 of a word's bytes; emptied when full, as any word can be computed again."""

    def __init__(self, most=REMEMBERED):
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = value = zlib.crc32(word.encode())
        return value


def splitter():
    """A pre-tokenizer that keeps the words of a text and their offsets."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORDS), behavior="removed", invert=True)


def lowered(text):
    """The text with A-Z lower-cased, and nothing else."""
    return (text or "").encode("utf-8", "replace").lower().decode()


def feature_buckets(text, split, checksums, features):
    """(number of words, bucket of every feature) of a text."""
    low = lowered(text)
    offsets = [span for _, span in split.pre_tokenize_str(low)]
    words = [low[a:b] for a, b in offsets]
    sums = list(map(checksums.__getitem__, words))
    found = [] if features.shortest > 1 else [sums]
    # a window one word longer continues the checksum of the window that starts at the same word
    tails = [b" " + w.encode() for w in words] if features.longest > 1 else ()
    for width in range(2, features.longest + 1):
        sums = [zlib.crc32(tail, s) for s, tail in zip(sums, tails[width - 1 :])]
        if width >= features.shortest:
            found.append(sums)
    crc = np.array([s for part in found for s in part], np.int64)
    return len(words), (crc % features.buckets).astype("<i4")


def _hashed(features):
    def run(batches):
        split, checksums = splitter(), Checksums()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                *keep, texts = part.columns
                counts, buckets = [], []
                for text in texts:
                    n, found = feature_buckets(text.as_py(), split, checksums, features)
                    counts.append(n)
                    buckets.append(found.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(counts, pa.int64()), pa.array(buckets, pa.binary())],
                    names=[*batch.schema.names[:-1], "n_words", "buckets"],
                )

    return run


def hashed(documents, features=Features(), keep=()):
    """The columns ``keep``, n_words, and buckets: the bucket of every feature as 32-bit numbers."""
    rows = documents.select(*keep, "text")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("buckets", T.BinaryType())])
    return rows.mapInArrow(_hashed(features), schema)


def histogram(rows, buckets):
    """How often each bucket occurs in the column ``buckets``, as one number per bucket.

    Every task counts its own rows and hands over at most one row per bucket.
    """

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer() or b"", "<i4"), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    counts = rows.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def bucket_gains(raw, target):
    """floor(1000 * ln) of the smoothed share in the target over that in the documents, by bucket."""
    size, s, t = len(raw), int(raw.sum()), int(target.sum())
    pairs = zip(raw.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + size) / ((a + 1) * (t + size)))) for a, b in pairs], np.int64)


def _weighted(gains):
    def run(batches):
        for batch in batches:
            *keep, buckets = batch.columns
            sizes = np.array([len(b.as_buffer()) // 4 for b in buckets], np.int64)
            data = b"".join(b.as_buffer() for b in buckets)
            sums = np.concatenate([[0], np.cumsum(gains[np.frombuffer(data, "<i4")])])
            ends = np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes]
            weight = np.where(sizes > 0, total // np.maximum(sizes, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sizes), pa.array(weight)], names=[*batch.schema.names[:-1], "n_features", "weight"]
            )

    return run


def gumbel(id_column, seed):
    """floor(1000 * Gumbel noise) of a row, from the first 32 bits of the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(documents, target, features=Features(), seed=2024, id_column="doc_id"):
    """``_id``, n_words, n_features, weight and score of every document, written once.

    Null texts have no words, and texts without features weigh 0. A null id counts as the empty text in
    the hash.
    """
    rows = documents.select(F.col(id_column).alias("_id"), "text")
    rows = stored(hashed(rows, features, ["_id"]), "resampling-buckets")
    gains = bucket_gains(histogram(rows, features.buckets), histogram(hashed(target, features), features.buckets))
    schema = T.StructType(rows.schema.fields[:-1]).add("n_features", "long").add("weight", "long")
    weighed = rows.mapInArrow(_weighted(gains), schema)
    return stored(weighed.withColumn("score", F.col("weight") + gumbel("_id", seed)), "resampling-scores")


def ranked(rows, percent=10, least_words=20):
    """``rows`` of scored() with rank: 1, 2, 3... by falling score for the drawn ones, else null.

    Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn; ties go to the
    smaller id, null last. Scores are whole numbers within some 100,000 values, whatever the input
    (weights are logarithms of counts, the noise comes from 32 bits), so the driver sees one count for each.
    A rank is the number of rows of higher scores, plus those of lower id ranges of its score, plus the
    place in its own range; no window spans more than a range.
    """
    fit = F.col("n_words") >= least_words
    counts = rows.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()
    draw = sum(r["n"] for r in counts) * percent // 100
    above, heads = 0, []
    for score, n in sorted(((r["score"], r["n"]) for r in counts), reverse=True):
        if above >= draw:
            break
        heads.append((score, above))
        above += n
    shown = ["_id", "n_features", "weight", "score"]
    if not heads:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    high = fit & (F.col("score") >= heads[-1][0])
    top = rows.where(high)
    first, last = top.agg(F.min("_id"), F.max("_id")).first()
    width = (float(last or 0) - float(first or 0)) / ID_RANGES or 1.0
    place = F.floor((F.col("_id").cast("double") - float(first or 0)) / width).cast("int")
    top = top.withColumn("_range", F.coalesce(place, F.lit(ID_RANGES + 1)))
    cells = top.groupBy("score", "_range").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("score").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("score", "_range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_ahead"))
    cells = cells.join(rows.sparkSession.createDataFrame(heads, "score long, _above long"), "score")
    order = W.partitionBy("score", "_range").orderBy(F.col("_id").asc_nulls_last(), "n_features")
    top = top.withColumn("_row", F.row_number().over(order)).join(cells, ["score", "_range"])
    rank = F.col("_above") + F.col("_ahead") + F.col("_row")
    top = top.select(*shown, F.when(rank <= draw, rank).alias("rank"))
    return top.unionByName(rows.where(~high).select(*shown, F.lit(None).cast("long").alias("rank")))


def resample(documents, target, features=Features(), percent=10, least_words=20, seed=2024, id_column="doc_id"):
    """Every document with n_features, weight, score and rank; rank is null for those not drawn.

    ``target`` has a column text. Rows that repeat are rows of their own: they share weight and score, and
    take successive ranks. Without target texts all gains come from smoothing alone; no documents give no
    rows. Columns other than the id and text are not looked at, so their names do not matter. Texts of any
    length are read whole.
    """
    rows = ranked(scored(documents, target, features, seed, id_column), percent, least_words)
    return rows.withColumnRenamed("_id", id_column)
