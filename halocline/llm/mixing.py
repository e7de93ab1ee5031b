"""Mixing sources to target weights by subset-sum budget fitting.

The size of a document is its number of words. Each source has a target, a share of the total by weight
that stops at ``cap`` times its own size. Every document of a source is taken whole as often as the target
holds the source. For the remaining budget the documents are counted by exact size; each size gives its
proportional part, rounded at random, and bounded-knapsack dynamic programming over the sizes fits what is left. Which documents of a size
are taken follows a seeded hash.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.llm.common import WORD, stored

#: The remaining budget, about, that the dynamic programme fits exactly.
EXACT_WORDS = 1 << 15
#: Rows of one size and source that one task ranks, about.
BUCKET_ROWS = 4096


def source_targets(sized, weights=(5, 2, 1), cap=3.0):
    """(source, source_size, target) per source: a common level times the weight, but at most cap sizes.

    Weights go round over the sources in code point order, null last. A source that would get more than
    its cap keeps the cap, and the others share the excess by weight: with the sources in ascending
    order of cap by weight, those before the first one that the rest of the total does not fill are
    capped. The windows hold one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    sources = sources.select(
        "source",
        "source_size",
        (F.col("source_size") * F.lit(float(cap))).alias("most"),
        F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
    )
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    sources = sources.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    sources = sources.withColumn("level", F.max(fits).over(every))
    return sources.select(
        "source", "source_size", F.least(F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"), F.col("most")).alias("target")
    )


def subset_counts(sizes, counts, budget, seed=7):
    """How many of each size to take so that their sum comes nearest to ``budget``.

    sizes: distinct positive whole numbers; counts: how many there are. Sizes give in proportion first,
    rounded up or down by a seeded chance, so that short and long documents keep their shares; what that misses
    by more than EXACT_WORDS is put right by single documents in a seeded order. The rest is fitted by
    the reachable sums, as bits of one number. Nearest below or above, below if equally near.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    total = int((sizes * counts).sum())
    take = np.zeros(len(sizes), np.int64)
    if not total or budget <= 0:
        return take
    if budget >= total:
        return counts.copy()
    chance = np.random.default_rng(seed)
    part = counts * (budget / total)
    take = np.minimum(counts, np.floor(part + chance.random(len(sizes))).astype(np.int64))
    rest = int(round(budget)) - int((sizes * take).sum())
    turns, moved = chance.permutation(len(sizes)), 1
    while moved and not 0 <= rest <= EXACT_WORDS:
        moved = 0
        for k in turns:
            step = -1 if rest < 0 else 1 if rest > max(EXACT_WORDS, int(sizes[k]) - 1) else 0
            if step and 0 <= take[k] + step <= counts[k]:
                take[k] += step
                rest -= step * int(sizes[k])
                moved += 1
    left = counts - take
    order = np.argsort(-sizes)
    if rest <= 0:
        return take
    # sums beyond twice the rest are farther from it than none
    mask = (1 << (2 * rest)) - 1
    reached, items = 1, []
    for k in order:
        size, n, part = int(sizes[k]), int(left[k]), 1
        n = min(n, 2 * rest // size)
        while n > 0 and not reached >> rest & 1:
            part = min(part, n)
            items.append((k, part, reached))
            reached |= reached << (size * part) & mask
            n -= part
            part *= 2
    below = (reached & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reached >> rest
    up = (above & -above).bit_length() - 1 if above else rest + 1
    goal = below if rest - below <= up else rest + up
    for k, part, were in reversed(items):
        if not were >> goal & 1:
            take[k] += part
            goal -= part * int(sizes[k])
    return take


def _fit(rows):
    """Copies of every document and numbers of further ones by size, for one source."""
    rows = rows.sort_values("size")  # the chances go round over the sizes in order
    size, n = rows["size"].to_numpy(), rows["n"].to_numpy()
    target, whole = float(rows["target"].iloc[0]), float((size * n).sum())
    copies = int(np.floor(target / whole + 1e-12)) if whole else 0
    extra = np.zeros(len(size), np.int64)
    extra[size > 0] = subset_counts(size[size > 0], n[size > 0], target - copies * whole)
    return pd.DataFrame({"_src": rows["_src"], "_none": rows["_none"], "size": size, "copies": copies, "extra": extra, "n": n})


def copies_of(documents, weights=(5, 2, 1), cap=3.0, seed=7, keep=("doc_id",)):
    """How often each document is taken.

    Returns the columns ``keep`` and source, size, source_size, target and copies, one row per row.
    Null texts have size 0 and are never taken. A null source is a source of its own. Rows alike in
    doc_id, source and size are interchangeable. Reruns agree. No rows give no rows.
    """
    rows = documents.select(
        *keep, F.col("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size")
    )
    rows = stored(
        rows.select(
            "*",
            F.coalesce("source", F.lit("")).alias("_src"),
            F.col("source").isNull().alias("_none"),
            F.xxhash64(F.lit(seed), *keep, "source", "size").alias("_hash"),
        ),
        "mixing",
    )
    targets = source_targets(rows, weights, cap)
    targets = targets.select(
        F.coalesce("source", F.lit("")).alias("_src"), F.col("source").isNull().alias("_none"), "source_size", "target"
    )
    key = ["_src", "_none", "size"]
    plan = (
        rows.groupBy(key)
        .agg(F.count("*").alias("n"))
        .join(targets, ["_src", "_none"])
        .groupBy("_src", "_none")
        .applyInPandas(_fit, "_src string, _none boolean, size long, copies long, extra long, n long")
    )
    plan = stored(plan, "mixing-plan")
    buckets = rows.count() // BUCKET_ROWS + 1
    rows = rows.join(plan, key).withColumn("_part", F.col("extra").between(F.lit(1), F.col("n") - 1))
    rows = rows.withColumn("_bucket", F.when(F.col("_part"), F.pmod(F.col("_hash"), F.lit(buckets))))
    # the documents of a size in the order of bucket and hash: those before the bucket, and those in it
    bucket = [*key, "_bucket"]
    split = rows.where("_part")
    counts = split.groupBy(bucket).agg(F.count("*").alias("_n"))
    ahead = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*bucket, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = W.partitionBy(bucket).orderBy("_hash", *keep)
    split = split.withColumn("_rank", F.row_number().over(inside)).join(counts, bucket)
    more = (F.col("_ahead") + F.col("_rank") <= F.col("extra")).cast("long")
    shown = [*keep, "source", "size", "_src", "_none"]
    taken = split.select(*shown, (F.col("copies") + more).alias("copies")).unionByName(
        rows.where("not _part").select(*shown, (F.col("copies") + (F.col("extra") > 0).cast("long")).alias("copies"))
    )
    return taken.join(targets, ["_src", "_none"]).drop("_src", "_none")


def mixed(documents, weights=(5, 2, 1), cap=3.0, seed=7):
    """The mix itself: the rows of ``documents``, each as often as it is taken, with the same columns.

    Rows alike in every column share what they are taken.
    """
    both = F.xxhash64(*documents.columns).alias("a"), F.xxhash64(F.lit("second"), *documents.columns).alias("b")
    identity = F.struct(*both).alias("_id")
    copies = copies_of(documents.select("source", "text", identity), weights, cap, seed, keep=("_id",))
    copies = copies.groupBy("_id").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_alike"))
    copies = stored(copies.where("_copies > 0"), "copies")

    def of(chosen):
        row = F.struct(*documents.columns).alias("_row")
        return documents.select(row, identity).join(chosen, "_id").select("_id", "_row", "_copies")

    rows, several = of(copies.where("_alike = 1")), copies.where("_alike > 1")
    if not several.isEmpty():
        rows = rows.unionByName(of(several).dropDuplicates(["_id"]))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return rows.select("_row.*")


def mix_digest(documents):
    """doc_id, size, source_size, target and the words taken, repeats counted."""
    return copies_of(documents).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )
