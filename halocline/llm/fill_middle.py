"""Fill-in-the-middle: texts cut at two token ranks and rearranged behind sentinels.

A text is a list of tokens, runs of ASCII letters or single other code points. An indexable skip list holds
them: every lane links some tokens, and every link carries its width in tokens and in code points.
Descending from the sparsest lane by accumulated widths finds the code point at which a rank begins, in
a number of steps that grows with the logarithm of the tokens.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halocline.llm.common import mix64

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A token stays for the next lane with a chance of one in four.
LANE_BITS = 2
#: A batch that a task hands back ends after so many rows or characters.
ROWS, CHARS = 1024, 1 << 24


@dataclass(frozen=True)
class Plan:
    """Seed of the cuts, percent of texts that are rearranged, and percent of those with the suffix first."""

    seed: int = 1
    rate: int = 90
    spm: int = 20


def token_starts(text):
    """Code-point places where tokens begin."""
    if text.isascii():
        points = np.frombuffer(text.encode(), np.uint8)
    else:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((points | 32) - points.dtype.type(97)) < 26
    begins = ~letter
    begins[1:] |= ~letter[:-1]
    begins[:1] = True
    return np.flatnonzero(begins)


class Towers:
    """Ranks that stand in each lane; a hash of the rank is its coin, so all texts and reruns agree."""

    def __init__(self):
        self.lanes = [np.zeros(0, np.int64)]
        self.known = 0

    def of(self, n):
        """The lanes over ranks below ``n``, densest first; rank 0 stands in all of them."""
        if n > self.known:
            self.known = max(1024, 2 * n)
            ranks = np.arange(self.known)
            coins = mix64(ranks.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            coins[0] = 0
            self.lanes = [ranks]
            while len(self.lanes[-1]) > 1:
                lane = self.lanes[-1]
                bits = np.uint64((1 << LANE_BITS * len(self.lanes)) - 1)
                self.lanes.append(lane[(coins[lane] & bits) == 0])
        out = []
        for lane in self.lanes:
            out.append(lane[: np.searchsorted(lane, n)])
            if len(out[-1]) <= 1:
                break
        return out


class SkipList:
    """Tokens by rank, with the widths of every link in tokens and in code points."""

    def __init__(self, starts, length, towers):
        self.size, self.length = len(starts), length
        lanes = towers.of(self.size) if self.size else []
        self.units = [np.diff(lane, append=self.size) for lane in lanes]
        self.points = [np.diff(starts[lane], append=length) for lane in lanes]
        #: where a node of a lane stands in the lane below
        self.below = [np.searchsorted(low, high) for low, high in zip(lanes, lanes[1:])]

    def place(self, rank):
        """Code points before the token of this rank; all of them for the rank after the last."""
        units = points = node = 0
        for lane in range(len(self.units) - 1, -1, -1):
            steps, widths = self.units[lane], self.points[lane]
            while node < len(steps) and units + steps[node] <= rank:
                units += int(steps[node])
                points += int(widths[node])
                node += 1
            if units == rank or node == len(steps):
                break
            if lane:
                node = int(self.below[lane - 1][node])
        return points


def numbers(doc_id, seed):
    """Four 32-bit numbers of a document, from the SHA-256 of seed and id; no id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def rearranged(text, doc_id, towers, plan=Plan()):
    """(tokens, form, characters of prefix and of middle, output) of one text."""
    starts = token_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = numbers(doc_id, plan.seed)
    if not text or h3 % 100 >= plan.rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    tokens = SkipList(starts, len(text), towers)
    a, b = sorted(tokens.place(h % (n + 1)) for h in (h1, h2))
    before, between, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < plan.spm:
        return n, "spm", a, b - a, "".join((SUFFIX, after, PREFIX, before, MIDDLE, between))
    return n, "psm", a, b - a, "".join((PREFIX, before, SUFFIX, after, MIDDLE, between))


def _transform(plan):
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        towers = Towers()
        for batch in batches:
            names = [*batch.schema.names[:-2], "n", "form", "prefix_chars", "middle_chars", "output"]
            *keep, ids, texts = batch.columns

            def part(start, rows):
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                return pa.RecordBatch.from_arrays([*[c.slice(start, len(rows)) for c in keep], *made], names=names)

            start, chars, rows = 0, 0, []
            for i, (doc_id, text) in enumerate(zip(ids, texts)):
                rows.append(rearranged(text.as_py() or "", doc_id.as_py(), towers, plan))
                chars += len(rows[-1][-1])
                if len(rows) == ROWS or chars >= CHARS:
                    yield part(start, rows)
                    start, chars, rows = i + 1, 0, []
            yield part(start, rows)

    return run


def fill_in_middle(documents, plan=Plan(), keep=("doc_id",), id_column="doc_id"):
    """Every document's columns ``keep``, and n, form, prefix_chars, middle_chars and output.

    form is plain (output is the text), psm or spm. Null texts are empty, and empty texts stay plain, as do
    texts that hold a sentinel. Equal ids are cut by the same numbers; a null id counts as the empty text.
    Texts of any length are taken whole. Rows that repeat are rows of their own, and no rows give none.
    Columns that are not kept may have any name.
    """
    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    rows = documents.select(*kept, F.col(id_column).cast("string").alias("_doc"), F.col("text").alias("_text"))
    made = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    out = rows.mapInArrow(_transform(plan), T.StructType([*rows.schema.fields[:-2], *made.fields]))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *made.names)


def restored(output="output", form="form"):
    """The text from which an output was made. A sentinel occurs once, as texts that hold one stay plain."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    behind = F.substring(head, 4, 2**31 - 1)
    psm = F.concat(F.substring_index(behind, SUFFIX, 1), middle, F.substring_index(behind, SUFFIX, -1))
    spm = F.concat(F.substring_index(behind, PREFIX, -1), middle, F.substring_index(behind, PREFIX, 1))
    form = F.col(form)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(F.col(output))


def digest(documents, plan=Plan()):
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text restored from it."""
    return fill_in_middle(documents, plan).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )
