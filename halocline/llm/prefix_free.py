"""Removal of long repeated strings by prefix-free parsing.

A string of ``length`` bytes is repeated if it starts at two places of the corpus. A rolling hash of
``anchor`` bytes marks triggers: a place triggers if its hash is the least in some window of ``length``
bytes. Triggers cut texts into phrases that are the same wherever the same bytes stand, so copies parse
alike. The windows whose least hash is one trigger form its reach. The dictionary holds the distinct
reaches, and settles most windows: a reach that occurs twice is repeated throughout, and one whose trigger
occurs once is not repeated at all. For the rest, suffixes of the dictionary are compared: reaches with
one trigger are cut, at fixed distances before it, into steps of 16 starts, whose common core and the
bytes left and right of it decide each start.

Order among suffixes is not needed, only equality up to ``length`` bytes, so reaches, cores and ends have
names (hashes of 128 bits) in place of ranks. Comparisons are counts by name, combined map-side.

A reach is known by its name alone: its bytes decide where its trigger stands in it. What travels is kept
narrow: places are packed into one number, and texts are shipped compressed.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.llm.common import mix64, stored

LENGTH, ANCHOR, STEP = 400, 96, 16
#: Bits for the distance of a start from its trigger; strings are shorter than 1 << NEAR bytes.
NEAR = 12
#: Texts whose reaches a task remembers to have shown.
SHOWN = 200_000
#: Starts of a text that are parsed at once; places within such a part fit 24 bits.
PART = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_SEEDS = (np.uint64(0x1D8E4E27C47D124F), np.uint64(0xD6E8FEB86659FD93))


def _eights(data):
    """Every eight successive bytes as a number."""
    return np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8").ravel()


def _power(base, n):
    """base**0 .. base**(n-1) modulo 2**64."""
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


def _rolling(data, width):
    """A hash of every ``width`` successive bytes, a multiple of 8, built from runs of doubled length."""
    n = len(data) - width + 1
    run, size, left = mix64(_eights(data)), 1, width // 8
    total, done = np.zeros(n, np.uint64), 0
    while True:
        if left & size:
            total += run[8 * done : 8 * done + n] * np.uint64(pow(_BASE, done, 1 << 64))
            done += size
        if 2 * size > left:
            return mix64(total)
        run = run[: -8 * size] + run[8 * size :] * np.uint64(pow(_BASE, size, 1 << 64))
        size *= 2


def _least_places(values, span):
    """Place of the least value of every ``span`` successive ones, the first of equals.

    Upper bits of a value and its place share one number, and minima run forward and backward over rows
    of ``span``; every window is the end of one row and the beginning of the next.
    """
    n = len(values)
    keys = (values >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // span)
    table = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    table[:n] = keys
    table = table.reshape(rows, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - span + 1], ahead[span - 1 : n])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def _names(data, start, stop):
    """Two 64-bit numbers of each string [start, stop), from running sums of its mixed eights.

    The sums are scaled by powers of a base, and those before the string are taken off.
    """
    eights = _eights(data)
    power = _power(_BASE, len(eights))
    back = _power(pow(_BASE, -1, 1 << 64), len(eights))[start]
    size = (stop - start).astype(np.uint64) * _SEEDS[0]
    out = []
    for seed in _SEEDS:
        sums = np.zeros(len(eights) + 1, np.uint64)
        np.cumsum(mix64(eights ^ seed) * power, out=sums[1:])
        out.append(mix64((sums[stop - 7] - sums[start]) * back + size).view(np.int64))
    return out


def reaches(data, length=LENGTH, anchor=ANCHOR):
    """Triggers of a text: place, first and last start of its windows, trigger hash, and two names."""
    out = []
    for offset in range(0, max(0, len(data) - length + 1), PART):
        part = data[offset : offset + PART + length - 1]
        hashes = _rolling(part, anchor)
        place = _least_places(hashes, length - anchor + 1)
        cuts = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], cuts])
        last = np.concatenate([cuts, [len(place)]]) - 1
        at = place[first]
        out.append((at + offset, first + offset, last + offset, hashes[at].view(np.int64), *_names(part, first, last + length)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 6


def _utf8(text):
    return (text or "").encode("utf-8", "surrogatepass")


def _often(c1, c2):
    """Which rows come after two others of the same name."""
    order = np.lexsort((c2, c1))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(c1[order]) != 0) | (np.diff(c2[order]) != 0)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = np.arange(len(order)) - begin >= 2
    return out


def _parse(length, anchor):
    """Reaches of the texts: place, trigger and names.

    A batch tells of a name twice, which is enough to know that it is repeated. Where it comes again, the starts
    are settled at once: rows without names, with the first and the last start of a run of such reaches in
    place of place and trigger. A passage that many texts hold is thus a range per text.
    """
    names = ["k1", "k2", "place", "trigger", "c1", "c2"]

    def run(batches):
        for batch in batches:
            columns = [[np.zeros(0, np.int64)] for _ in range(len(names) + 1)]
            for row, (k1, k2, text) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                at, first, last, *hashes = reaches(np.frombuffer(_utf8(text), np.uint8), length, anchor)
                place = (at << 2 * NEAR) + (at - first << NEAR) + (at - last)
                for c, v in zip(columns, [np.full(len(at), k1), np.full(len(at), k2), place, *hashes, np.full(len(at), row)]):
                    c.append(v)
            *columns, row = [np.concatenate(c) for c in columns]
            often = _often(*columns[4:])
            told = [pa.array(c[~often]) for c in columns]
            yield pa.RecordBatch.from_arrays(told, names=names)
            k1, k2, place = [c[often] for c in columns[:3]]
            at, farthest, nearest = _unpacked(place)
            first, last, row = at - farthest, at - nearest, row[often]
            begins = np.ones(len(first), bool)
            begins[1:] = (row[1:] != row[:-1]) | (first[1:] != last[:-1] + 1)
            ends = np.append(begins[1:], True)[: len(begins)]
            known = [pa.array(c) for c in (k1[begins], k2[begins], first[begins], last[ends])]
            yield pa.RecordBatch.from_arrays([*known, *[pa.nulls(len(known[0]), pa.int64())] * 2], names=names)

    return run


def _unpacked(place):
    """(trigger, farthest, nearest) distance of starts from it."""
    mask = (1 << NEAR) - 1
    return place >> 2 * NEAR, place >> NEAR & mask, place & mask


def _starts(place):
    """Columns of the first and the last start of a reach."""
    mask = F.lit((1 << NEAR) - 1)
    at = F.shiftright(place, 2 * NEAR)
    far, near = F.shiftright(place, NEAR).bitwiseAND(mask), F.col(place).bitwiseAND(mask)
    return (at - far).alias("first"), (at - near).alias("last")


def _packed(batches):
    """Texts, the last column, as compressed UTF-8; an empty value for null."""
    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        *keep, texts = batch.columns
        out = [compress(_utf8(t.as_py())) for t in texts]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.binary())], names=batch.schema.names)


def _steps(length):
    """Steps of the reaches in question: core names, ends, and the starts of the step that are theirs."""
    names = ["k1", "k2", "at", "step", "low", "high", "n1", "n2", "left", "right", "open"]
    types = [*[pa.int64()] * 3, *[pa.int32()] * 3, *[pa.int64()] * 2, *[pa.binary()] * 2, pa.bool_()]

    def run(batches):
        unpack, shown = zstandard.ZstdDecompressor().decompress, set()
        for batch in batches:
            rows = []
            for k1, k2, packed, wanted in zip(*batch.columns):
                key = k1.as_py(), k2.as_py()
                # copies of a text ask alike; one in another task only repeats rows of settled reaches
                if key in shown:
                    continue
                if len(shown) >= SHOWN:
                    shown.clear()
                shown.add(key)
                data = unpack(packed.as_py())
                for r in wanted.as_py():
                    at, farthest, nearest = _unpacked(r["place"])
                    for step in range(nearest // STEP, farthest // STEP + 1):
                        near = step * STEP
                        far = near + STEP - 1
                        start, stop = at - near, at - far + length
                        core = hashlib.blake2b(data[start:stop], digest_size=16, key=step.to_bytes(4, "little", signed=True))
                        rows.append(
                            (
                                *key, at, step, max(near, nearest), min(far, farthest),
                                *np.frombuffer(core.digest(), "<i8").tolist(),
                                data[max(0, at - far) : start], data[stop : stop + STEP - 1], r["open"],
                            )
                        )
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def _compressed(texts):
    """``texts`` with its last column, text, compressed."""
    schema = T.StructType([*texts.schema.fields[:-1], T.StructField("packed", T.BinaryType())])
    return texts.withColumnRenamed("text", "packed").mapInArrow(_packed, schema)


def repeated_starts(texts, length=LENGTH, anchor=ANCHOR):
    """(k1, k2, first, last) ranges of starts of repeated strings, by the key of the text.

    ``texts`` has k1, k2 (a key of the text) and text, one row per occurrence; equal texts have equal keys.
    """
    longs = "k1 long, k2 long, place long, trigger long, c1 long, c2 long"
    parsed = stored(texts.mapInArrow(_parse(length, anchor), longs), "phrases")
    known = parsed.where("c1 is null").select("k1", "k2", F.col("place").alias("first"), F.col("trigger").alias("last"))
    parsed = parsed.where("c1 is not null")
    key = ["c1", "c2"]
    one = [F.first(c).alias(c) for c in ("trigger", "k1", "k2", "place")]
    dictionary = parsed.groupBy(key).agg(F.count("*").alias("n"), *one)
    # names serve only where a reach occurs again
    dictionary = dictionary.withColumns({c: F.when(F.col("n") > 1, F.col(c)) for c in key})
    dictionary = stored(dictionary, "dictionary")
    settled = parsed.join(dictionary.where("n > 1").select(key), key, "left_semi").select("k1", "k2", *_starts("place"))
    # triggers with several reaches, of which one at least is not settled; each reach is shown once
    several = dictionary.groupBy("trigger").agg(F.count("*").alias("reaches"), F.min("n").alias("fewest"))
    several = several.where("reaches > 1 and fewest = 1").select("trigger")
    asked = dictionary.select("trigger", "k1", "k2", "place", (F.col("n") == 1).alias("open")).join(several, "trigger", "left_semi")
    asked = asked.groupBy("k1", "k2").agg(F.array_agg(F.struct("place", "open")).alias("wanted"))
    steps = _compressed(texts).join(asked, ["k1", "k2"]).select("k1", "k2", "packed", "wanted").mapInArrow(
        _steps(length),
        "k1 long, k2 long, at long, step int, low int, high int, n1 long, n2 long, left binary, right binary, open boolean",
    )
    # open reaches occur once, so no row of theirs comes twice; rows of others may, and only make a name shared that is shared anyway
    steps = stored(steps, "steps")
    own, cut = ["k1", "k2", "at", "step"], ["n1", "n2", "left", "right", "low", "high"]
    cores = steps.groupBy("n1", "n2").agg(F.count("*").alias("m"), F.max("open").alias("open"))
    steps = steps.join(cores.where("m > 1 and open").select("n1", "n2"), ["n1", "n2"], "left_semi")
    steps = stored(steps, "shared-steps")
    alike = steps.groupBy(cut).agg(F.count("*").alias("m"), F.max("open").alias("open"), *[F.first(c).alias(c) for c in own])
    alike = stored(alike, "step-names")
    whole = steps.where("open").join(alike.where("m > 1").select(cut), cut, "left_semi")
    whole = whole.select("k1", "k2", (F.col("at") - F.col("high")).alias("first"), (F.col("at") - F.col("low")).alias("last"))
    # starts of steps that share a core with others: the bytes left and right of it decide
    still = alike.groupBy("n1", "n2").agg(F.max(F.col("open") & (F.col("m") == 1)).alias("ask"), F.count("*").alias("names"))
    starts = alike.join(still.where("ask and names > 1").select("n1", "n2"), ["n1", "n2"], "left_semi")
    starts = starts.withColumn("back", F.explode(F.sequence("low", "high")))
    inner = F.col("back") - F.col("step") * STEP
    beyond = F.length("left") - inner + 1
    starts = starts.withColumns(
        {"a": F.substring(F.col("left"), beyond, inner), "b": F.substring(F.col("right"), F.lit(1), F.lit(STEP - 1) - inner)}
    )
    name = ["n1", "n2", "back", "a", "b"]
    twice = starts.groupBy(name).agg(F.count("*").alias("times")).where("times > 1").select(name)
    start = F.col("at") - F.col("back")
    single = starts.where("open and m = 1").join(twice, name, "left_semi")
    single = single.select("k1", "k2", start.alias("first"), start.alias("last"))
    return settled.unionByName(known).unionByName(whole).unionByName(single)


def kept_bytes(data, ranges, length=LENGTH):
    """(bytes left, number of maximal removed runs) after removing the strings that start in the ranges."""
    left, runs, at = [], 0, 0
    for first, last in sorted(ranges):
        if first > at or not runs:
            runs += 1
            left.append(data[at:first])
        at = max(at, last + length)
    left.append(data[at:])
    return b"".join(left), runs


def _remove(length):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            *keep, texts, ranges = batch.columns
            out = []
            for packed, found in zip(texts, ranges):
                data = unpack(packed.as_py())
                left, runs = kept_bytes(data, [(r["first"], r["last"]) for r in found.as_py() or ()], length)
                out.append((len(data), len(data) - len(left), runs, left))
            types = [*[pa.int64()] * 3, pa.binary()]
            made = [pa.array([row[k] for row in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [*keep, *made], names=[*batch.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return run


def without_repeats(documents, keep=("doc_id",), length=LENGTH, anchor=ANCHOR):
    """Every row with its bytes that no repeated string covers.

    Returns ``keep``, n_bytes, n_removed, n_spans and kept (binary). Null texts are empty, and texts of fewer
    than ``length`` bytes lose nothing. Strings are judged on the input; rows that repeat are places of their
    own, so a row that comes twice loses all its strings. No rows give no rows.
    """
    text = F.coalesce("text", F.lit(""))
    if not anchor <= length < 1 << NEAR:
        raise ValueError(f"strings of {length} bytes with anchors of {anchor} are not supported")
    rows = documents.select(
        *keep, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("other"), text, F.length(text)).alias("k2"), "text"
    )
    starts = repeated_starts(rows.select("k1", "k2", "text"), length, anchor)
    ranges = starts.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    ranges = stored(ranges, "ranges")  # the shuffles of starts go before the texts are shuffled
    rows = _compressed(rows).join(ranges, ["k1", "k2"], "left").select(*keep, "packed", "ranges")
    schema = T.StructType(documents.select(*keep).schema.fields)
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(_remove(length), schema.add("kept", "binary"))


def removal_digest(documents):
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    return without_repeats(documents).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


def cleaned(documents, length=LENGTH, anchor=ANCHOR):
    """The rows of ``documents`` with ``text`` less its repeated strings, and ``n_chars`` to match.

    A code point of which a part is removed goes as a whole. Rows that repeat are places of their own; extra columns may have any name. A null text stays null; texts that are
    repeated throughout become empty, and their rows stay.
    """
    others = {c: f"_{k}" for k, c in enumerate(documents.columns) if c not in ("text", "n_chars")}
    row = F.struct(F.col("text").isNull().alias("absent"), *[F.col(c).alias(name) for c, name in others.items()])
    left = without_repeats(documents.select(row.alias("row"), "text"), ["row"], length, anchor)
    # the text travels once, packed: where nothing is removed, the bytes kept are the text
    kept = F.when(~F.col("row.absent"), F.col("kept"))
    text = F.replace(F.make_valid_utf8(kept.cast("string")), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.col("n_removed") > 0, text).otherwise(kept.cast("string"))
    left = left.select("row", text.alias("new"))
    columns = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return left.select(*[columns[c].alias(c) if c in columns else F.col("row")[others[c]].alias(c) for c in documents.columns])
