"""Similarity join on five-word shingles: Bayesian pruning of candidate pairs over MinHash values.

Texts with one shingle set form a class, and classes are compared, not their copies. Classes that share a
band of MinHash values are candidates (32 bands of 4: a pair at similarity 0.8 is missed with probability
5e-8, a nearer one with less). Candidates form components, whose classes meet in blocks. In a block the
pairs' values are compared 32 at a time, and a pair is dropped once the posterior probability that its
similarity reaches the threshold falls below a tolerance; what remains is verified on the sets. A block
gives counts of links and spanning edges, never the pairs themselves.
"""

from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F

from halocline.llm.common import mix64, stored

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
BANDS, ROWS, STEP = 32, 4, 32
HASHES = BANDS * ROWS
#: Classes of a component that meet in one task, at most twice as many.
BLOCK = 256
#: Words whose hashes a worker remembers, some 130 bytes each and held beside what other operators keep.
REMEMBERED = 100_000
_random = np.random.default_rng(20240229)
_MULTIPLY = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACE = _random.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word):
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


#: Kept by a worker from task to task.
_words = WordHashes()


def shingles(text, words=_words):
    """Sorted distinct hashes of the text's runs of five words; a shorter text is one run, an empty none.

    Words are parted by ASCII white space and compared in lower case.
    """
    found = text.lower().encode("utf-8", "surrogatepass").split()
    values = np.array([words[w] for w in found], np.uint64)
    if not len(values):
        return values
    n = max(1, len(values) - WORDS + 1)
    total = np.full(n, len(values) if len(values) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(values))):
        total += mix64(values[k : k + n]) * _PLACE[k]
    return np.unique(mix64(total))


def signature(hashes):
    """MinHash values of a set; all ones for the empty set."""
    least = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 4096):
        part = hashes[None, at : at + 4096] * _MULTIPLY[:, None] + _ADD[:, None]
        np.minimum(least, (part >> np.uint64(32)).min(axis=1).astype(np.uint32), out=least)
    return least


def least_matches(compared, threshold=THRESHOLD, tolerance=TOLERANCE):
    """Matches of ``compared`` MinHash values below which a pair is dropped.

    With a uniform prior, the posterior probability of a similarity of at least t after m of n matches
    is the chance of at most m successes in n + 1 trials of probability t.
    """
    total, n = 0.0, compared + 1
    for m in range(n + 1):
        total += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return n


def _as_long(values):
    return values.astype("<u8").view("<i8")


def class_keys(documents, keep, bands=True):
    """keep, k1, k2 (128 bits of the shingle set), size, and the band keys of every row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            keys, sizes, band = np.zeros((len(texts), 2), np.int64), np.zeros(len(texts), np.int64), []
            for i, text in enumerate(texts):
                found = shingles(text or "")
                digest = blake2b(found.astype("<u8").tobytes(), digest_size=16).digest()
                keys[i] = np.frombuffer(digest, "<i8")
                sizes[i] = len(found)
                if bands:
                    band.append(band_keys(signature(found)) if len(found) else np.zeros(0, np.int64))
            columns = [*batch.columns[: len(keep)], pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sizes)]
            names = [*keep, "k1", "k2", "size"]
            if bands:
                columns.append(pa.array([b.tolist() for b in band], pa.list_(pa.int64())))
                names.append("bands")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", bands array<long>" if bands else ""
    return documents.select(*keep, "text").mapInArrow(run, f"{fields}, k1 long, k2 long, size long{more}")


def band_keys(values):
    """One 64-bit key a band, the band's number mixed in."""
    table = values.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        total = mix64(total ^ table[:, k] * _PLACE[k])
    return _as_long(total)


def components(edges):
    """(node, root) of the graph of ``edges`` (a, b), longs; the root is the least node of a component.

    In each round every node ties itself and its neighbours to the least of them, until the edges stay the
    same and form stars; paths halve in a round. Least neighbours are combined map-side, and the edges of
    a hub meet them in a join that can be split.
    """
    edges, state = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges"), None
    while True:
        both = edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        ties = both.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        seen = Observation()
        found = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum"))
        edges = stored(ties.where("a <> b").distinct().observe(seen, found.alias("state")), "edges")
        if seen.get["state"] == state:
            break
        state = seen.get["state"]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def linked_pairs(left, right, same, threshold=THRESHOLD, tolerance=TOLERANCE):
    """Index pairs of sets with Jaccard similarity of at least the threshold.

    left and right: lists of (sorted hashes, signature); same: right is left, and pairs are i < j.
    """
    sizes_l = np.array([len(h) for h, _ in left])
    sizes_r = np.array([len(h) for h, _ in right])
    near = np.minimum(sizes_l[:, None], sizes_r) >= threshold * np.maximum(sizes_l[:, None], sizes_r) - 1e-9
    if same:
        near &= np.triu(np.ones(near.shape, bool), 1)
    a, b = np.nonzero(near)
    sig_l, sig_r = np.array([s for _, s in left]), np.array([s for _, s in right])
    matches = np.zeros(len(a), np.int64)
    for at in range(0, HASHES, STEP):
        for part in range(0, len(a), 65536):
            piece = slice(part, part + 65536)
            matches[piece] += (sig_l[a[piece], at : at + STEP] == sig_r[b[piece], at : at + STEP]).sum(axis=1)
        keep = matches >= least_matches(at + STEP, threshold, tolerance)
        a, b, matches = a[keep], b[keep], matches[keep]
    if not len(a):
        return a, b
    # intersections of one set with all its candidates: marks over the shared numbering of the hashes
    every, number = np.unique(np.concatenate([h for h, _ in right]), return_inverse=True)
    ends = np.cumsum(sizes_r)
    numbers = [number[e - n : e] for e, n in zip(ends, sizes_r)]
    marks, linked = np.zeros(len(every), bool), np.zeros(len(a), bool)
    for i in np.unique(a):
        own = left[i][0]
        at = np.searchsorted(every, own)
        at = at[(at < len(every)) & (every[np.minimum(at, len(every) - 1)] == own)]
        marks[at] = True
        where = np.flatnonzero(a == i) if len(a) < 4096 else np.arange(np.searchsorted(a, i), np.searchsorted(a, i, "right"))
        partners = b[where]
        joined = np.concatenate([numbers[j] for j in partners])
        starts = np.concatenate([[0], np.cumsum(sizes_r[partners])[:-1]])
        shared = np.add.reduceat(marks[joined], starts, dtype=np.int64)
        union = len(own) + sizes_r[partners] - shared
        linked[where] = shared >= threshold * union - 1e-9
        marks[at] = False
    return a[linked], b[linked]


def _meet(tables, threshold, tolerance):
    """Links and spanning edges of one pair of blocks of a component."""
    rows = tables.to_pydict()
    own = [(np.frombuffer(h, "<u8"), np.frombuffer(s, "<u4")) for h, s in zip(rows["hashes"], rows["signature"])]
    first, second = rows["i"][0], rows["j"][0]
    at = {}
    for n, block in enumerate(rows["block"]):
        at.setdefault(block, []).append(n)
    left, right = at.get(first, []), at.get(second, [])
    a, b = linked_pairs([own[n] for n in left], [own[n] for n in right], first == second, threshold, tolerance)
    a, b = np.array(left, np.int64)[a], np.array(right, np.int64)[b]
    copies = np.array(rows["copies"], np.int64)
    links = np.zeros(len(own), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    parent = list(range(len(own)))

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    touched = np.flatnonzero(links)
    k1 = np.array(rows["k1"], np.int64)
    roots = np.array([root(n) for n in touched], np.int64)
    return pa.table({"k1": k1[touched], "links": links[touched], "to": k1[roots]})


def near_classes(documents, threshold=THRESHOLD, tolerance=TOLERANCE):
    """Every row with its class of near duplicates and its number of links.

    Returns doc_id, t1 (a hash of the text), class_key (the same for a class), class_id and links. A link
    is another row of similarity of at least the threshold; rows with equal sets, among them those without
    words, are linked. class_id is the least doc_id connected by links; null where no connected row has
    an id.
    """
    rows = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t1"), "text")
    keyed = stored(class_keys(rows, ["doc_id", "t1"]), "shingle-keys")
    sets = keyed.groupBy("k1", "k2").agg(
        F.count("*").alias("copies"),
        F.min("doc_id").alias("least"),
        F.first("bands").alias("bands"),
    )
    sets = stored(sets, "shingle-sets")
    # in each band the least class stands for those that share a key with it
    banded = sets.select("k1", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high")
    stars = banded.join(shared.select("key", "low"), "key").where("k1 <> low")
    found = stored(components(stars.select(F.col("k1").alias("a"), F.col("low").alias("b"))), "candidates")
    sized = found.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    members = found.join(sized, "root").withColumnRenamed("node", "k1")
    members = stored(sets.select("k1", "k2", "copies", "least").join(members, "k1"), "candidate-classes")
    # the text of one row of every candidate class: that of the least id, if there is one
    texts = keyed.select("k1", "k2", "t1", F.col("doc_id").alias("least"))
    texts = texts.join(members.select("k1", "k2", F.col("least").alias("own")), ["k1", "k2"]).where("least <=> own")
    texts = texts.groupBy("k1", "k2", "least").agg(F.min("t1").alias("t1")).select("t1", "least")
    same = (F.col("rows.t1") == F.col("chosen.t1")) & F.col("rows.doc_id").eqNullSafe(F.col("chosen.least"))
    hashed = _with_hashes(rows.alias("rows").join(texts.alias("chosen"), same, "left_semi")).dropDuplicates(["k1", "k2"])
    met = members.join(hashed, ["k1", "k2"]).withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")))
    others = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")),
    )
    met = met.withColumn("pair", F.explode(others)).select("*", "pair.i", "pair.j").drop("pair", "blocks", "least")
    met = met.groupBy("root", "i", "j").applyInArrow(
        lambda t: _meet(t, threshold, tolerance), "k1 long, links long, to long"
    )
    met = stored(met, "links")
    links = met.groupBy("k1").agg(F.sum("links").alias("more"))
    roots = stored(components(met.select(F.col("k1").alias("a"), F.col("to").alias("b"))), "classes")
    classes = (
        sets.select("k1", "k2", "copies", "least")
        .join(links, "k1", "left")
        .join(roots.withColumnRenamed("node", "k1"), "k1", "left")
        .withColumn("class_key", F.coalesce("root", "k1"))
    )
    names = classes.groupBy("class_key").agg(F.min("least").alias("class_id"))
    classes = classes.join(names, "class_key").select(
        "k1", "k2", "class_key", "class_id", (F.coalesce("more", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    return keyed.select("doc_id", "t1", "k1", "k2").join(classes, ["k1", "k2"]).drop("k1", "k2")


def _with_hashes(texts):
    def run(batches):
        for batch in batches:
            out = {"k1": [], "k2": [], "hashes": [], "signature": []}
            for text in batch.column(0).to_pylist():
                found = shingles(text or "")
                data = found.astype("<u8").tobytes()
                k1, k2 = np.frombuffer(blake2b(data, digest_size=16).digest(), "<i8")
                out["k1"].append(int(k1))
                out["k2"].append(int(k2))
                out["hashes"].append(data)
                out["signature"].append(signature(found).astype("<u4").tobytes())
            types = {"k1": pa.int64(), "k2": pa.int64(), "hashes": pa.binary(), "signature": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in types.items()], names=list(types))

    return texts.select("text").mapInArrow(run, "k1 long, k2 long, hashes binary, signature binary")


def link_counts(documents):
    """doc_id, class_id and links of every document.

    Null texts are empty; repeated rows are rows of their own and are linked to one another. A null doc_id
    is kept and never names a class. Other columns are not read. No rows give no rows.
    """
    return near_classes(documents).select("doc_id", "class_id", "links")


def one_of_each_class(documents, threshold=THRESHOLD):
    """The rows of ``documents`` without near duplicates: of each class the row with the least doc_id.

    All columns are kept. Ties go to the smaller text hash, null ids come last, and of rows alike in
    doc_id and text any one stays.
    """
    classed = near_classes(documents, threshold)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1")
    best = stored(
        classed.groupBy("class_key", "doc_id", "t1").agg(F.count("*").alias("alike"))
        .groupBy("class_key").agg(F.min_by(F.struct("doc_id", "t1", "alike"), rank).alias("best"))
        .select("best.*"),
        "class-heads",
    )
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.struct(*documents.columns).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_t1"))

    def of(heads):
        same = (F.col("rows._t1") == F.col("heads.t1")) & F.col("rows._doc").eqNullSafe(F.col("heads.doc_id"))
        return rows.alias("rows").join(heads.alias("heads"), same, "left_semi")

    several = best.where("alike > 1")
    kept = of(best.where("alike = 1"))
    if not several.isEmpty():
        kept = kept.unionByName(of(several).dropDuplicates(["_doc", "_t1"]))
    return kept.select("_row.*")
