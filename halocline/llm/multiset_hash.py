"""Document fingerprints: homomorphic multiset hashes of paragraphs, in built-in functions only.

A paragraph (the text between line feeds) has a vector of 60-bit lanes, and a document's fingerprint is
the sum of its paragraphs' vectors, each lane modulo 2**60. Order does not count, and ``insert`` and
``remove`` change a fingerprint by a paragraph without its document. There are two groups of lanes:

* ``EQUALITY`` lanes hash the paragraph as a whole. Equal multisets of paragraphs have equal lanes, and
  others differ but for a chance of about 2**-240.
* One lane counts the paragraph's distinct word triples (shorter paragraphs: its words together), and ``SKETCH``
  lanes hold four 15-bit counters each: how many of the triples have a given hash bit set. The spread of
  the differences of two documents' counters estimates how many triples they do not share.

Empty paragraphs add nothing, so an empty or null text has the zero fingerprint. Counters wrap at 2**15 and
carry into the next one; the differences of two documents' counters are read from the difference of whole
lanes, around the difference that their numbers of triples lead to expect, and are exact while they stay
within 2**14 of it (documents that differ in less than some millions of triples).
"""

from pyspark.sql import Column, functions as F
from pyspark.sql import Window as W

from halocline.llm.common import stored

EQUALITY, SKETCH = 4, 12
LANES = EQUALITY + 1 + SKETCH
MODULUS = 1 << 60
COUNTERS = 1 | 1 << 15 | 1 << 30 | 1 << 45
#: Buckets of 2**8 ids, and of 2**12 buckets, for the order of documents.
BUCKET, UPPER = 8, 20
#: Heads of buckets (25 bytes each) that are broadcast at most.
SENT_HEADS = 1_000_000


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _pieces(paragraph: Column) -> Column:
    """Hashes of the distinct word triples of a paragraph."""
    return _bound(
        F.split(paragraph, " "),
        lambda words: F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
            )
        ),
    )


def _wrap(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MODULUS - 1))


def _hash_sum(parts: Column, seed: int) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: _wrap(acc + _wrap(F.xxhash64(F.lit(seed), p))))


def _counters(hashes: Column, lane: int) -> Column:
    """Sum of four bits of every hash, 15 bits apart."""
    return F.aggregate(
        hashes,
        F.lit(0).cast("long"),
        lambda acc, h: _wrap(acc + F.shiftrightunsigned(h, lane).bitwiseAND(F.lit(COUNTERS))),
    )


def fingerprint(text: Column) -> Column:
    """The lanes of a text as an array of ``LANES`` longs."""

    def lanes(parts):
        equality = [_hash_sum(parts, k) for k in range(EQUALITY)]
        pieces = F.flatten(F.transform(parts, _pieces))
        sketch = _bound(
            pieces, lambda h: F.array(F.size(h).cast("long"), *[_counters(h, k) for k in range(SKETCH)])
        )
        return F.concat(F.array(*equality), sketch)

    return _bound(paragraphs(text), lanes)


def insert(print_: Column, paragraph: Column) -> Column:
    """The fingerprint after adding one paragraph."""
    return F.zip_with(print_, fingerprint(paragraph), lambda a, b: _wrap(a + b))


def remove(print_: Column, paragraph: Column) -> Column:
    """The fingerprint after taking one paragraph away."""
    return F.zip_with(print_, fingerprint(paragraph), lambda a, b: _wrap(a - b + F.lit(MODULUS)))


def as_text(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _apart(x: Column, y: Column, expected: Column) -> Column:
    """Differences of the four counters of two lanes, less ``expected`` (modulo 2**15), each in [-2**14, 2**14)."""
    # with 2**14 added to each there is no borrow between them
    shift = (F.lit(1 << 14) - expected.bitwiseAND(F.lit(0x7FFF))) * F.lit(COUNTERS)
    return _bound(
        _wrap(x - y + shift),
        lambda d: F.array(
            *[
                F.shiftrightunsigned(d, 15 * part).bitwiseAND(F.lit(0x7FFF)).cast("double") - F.lit(float(1 << 14))
                for part in range(4)
            ]
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else about the shared part of the word triples, at most 0.999999.

    Each bit of a triple's hash is set by chance, so the difference of two documents' counters has a
    variance, over the counters, of a quarter of the number of triples that they do not share.
    """
    expected = F.shiftright(F.get(a, EQUALITY) - F.get(b, EQUALITY), 1)
    apart = F.flatten(
        F.zip_with(
            F.slice(a, EQUALITY + 2, SKETCH), F.slice(b, EQUALITY + 2, SKETCH), lambda x, y: _apart(x, y, expected)
        )
    )
    n = float(4 * SKETCH)

    def spread(values):
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        squares = F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)
        return (squares - total * total / n) / (n - 1)

    triples = (F.get(a, EQUALITY) + F.get(b, EQUALITY)).cast("double")
    near = F.lit(1.0) - F.lit(4.0) * _bound(apart, spread) / triples
    return (
        F.when(a == b, 1.0)
        .when(triples == 0, 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.999999), near)))
    )


def with_next(docs, columns):
    """Add ``next``, a struct of ``columns`` of the row after in ascending (null, doc_id, text hash).

    Ids are dealt to buckets of 256 numbers, and each bucket is ordered in one task; null ids follow all
    others, in the order of a hash of their text. The first row of each bucket is sent to the bucket
    before, too, and the very first row to the last bucket. Rows that repeat an id share its bucket.
    """
    keyed = docs.withColumns(
        {
            "_null": F.col("doc_id").isNull(),
            "_id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1))),
        }
    )
    heads = (
        keyed.select("_null", "_id")
        .withColumn("_bucket", F.shiftright("_id", BUCKET))
        .groupBy("_null", "_bucket")
        .agg(F.min("_id").alias("_id"))
        .withColumn("_upper", F.shiftright("_bucket", UPPER - BUCKET))
    )
    inside = W.partitionBy("_null", "_upper").orderBy("_bucket")
    heads = heads.withColumn("_before", F.lag("_bucket").over(inside))
    tops = heads.groupBy("_null", "_upper").agg(F.max("_bucket").alias("_last"))
    every = W.orderBy("_null", "_upper")
    tops = tops.select(
        "_null",
        "_upper",
        F.coalesce(F.lag(F.struct("_null", "_last")).over(every), F.last(F.struct("_null", "_last")).over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_top"),
    )
    heads = heads.join(tops, ["_null", "_upper"]).select(
        "_null",
        "_id",
        F.when(F.col("_before").isNull(), F.col("_top._null")).otherwise(F.col("_null")).alias("_to_null"),
        F.coalesce("_before", "_top._last").alias("_to"),
    )
    # two longs and two flags a bucket: sent to every task while they are few, else joined by shuffling
    heads = stored(heads, "buckets")
    if heads.count() <= SENT_HEADS:
        heads = F.broadcast(heads)
    copies = (
        keyed.join(heads, ["_null", "_id"])
        .withColumns({"_copy": F.lit(True), "_in": F.col("_to"), "_in_null": F.col("_to_null")})
        .drop("_to", "_to_null")
    )
    own = keyed.withColumns({"_copy": F.lit(False), "_in": F.shiftright("_id", BUCKET), "_in_null": F.col("_null")})
    order = W.partitionBy("_in_null", "_in").orderBy("_copy", "_null", "_id", "_tie")
    return (
        own.unionByName(copies)
        .withColumn("_tie", F.xxhash64("text"))
        .withColumn("next", F.lead(F.struct(*columns)).over(order))
        .where("not _copy")
        .drop("_null", "_id", "_copy", "_in", "_in_null", "_tie")
    )


def edited_fingerprints(documents):
    """Fingerprints of documents and of their edited texts.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by as many first
    ones of the next document (all of it, if shorter), in the order of ``with_next``; the document after
    the last is the first. Null texts count as empty, one document alone follows itself, and an empty
    table gives no rows. Other columns than doc_id and text are not read.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("print", fingerprint(F.col("text")))
    n = F.char_length("text")
    cut = F.floor(n / F.lit(4)).cast("int")
    paired = with_next(docs, ["text", "print"])
    edited = paired.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "print",
        F.col("next.print").alias("next_print"),
        F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.col("next.text"), F.lit(1), cut)).alias("edited"),
    )
    edited = edited.select("*", fingerprint(F.col("edited")).alias("edited_print"))
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
