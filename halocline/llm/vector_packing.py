"""Packing of token pieces into sequences by vector best fit.

A piece needs tokens, one document slot and attention cost (the square of its tokens). A sequence has a
capacity of each. Pieces are placed longest first; among the open sequences where every capacity
suffices, the one with the least weighted residual norm (or weighted dot product of need and residual)
takes the piece. Pieces are dealt by hash to groups of bounded size, and each group is packed in one task;
a group leaves about one sequence more than a whole packing would.
"""

import re
import string
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SEQUENCE = 2048
#: Pieces that one task packs, about.
GROUP_PIECES = 16384
#: Words whose ids a worker remembers, up to twice as many.
REMEMBERED = 500_000
#: Bytes of text whose words are looked up together.
TOGETHER = 4 << 20
#: Kinds of bytes: blanks, ASCII letters and digits, ASCII marks, all others.
BLANK, LETTER, MARK, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
for _kind, _chars in ((BLANK, " \n\t\r"), (LETTER, string.ascii_letters + string.digits), (MARK, string.punctuation)):
    KINDS[list(_chars.encode())] = _kind
#: Words of lower-case Latin-1 letters alone, which the tokenizer neither changes nor cuts before its merges.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence, and the weights of its residuals."""

    tokens: int = SEQUENCE
    documents: int = SEQUENCE
    attention: int = SEQUENCE * SEQUENCE
    weights: tuple = (1.0, 0.01, 0.01)
    measure: str = "norm"


def lowered(text):
    """``text`` in lower case, as the tokenizer lowers it; left alone beyond Latin-1.

    There every letter has one lower case, whatever stands beside it, and nothing composes.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def segments(data):
    """The words of UTF-8 text, cut at blanks and before a mark behind a letter of PLAIN or a digit, and their starts."""
    codes = np.frombuffer(data, np.uint8)
    kinds = KINDS[codes]
    kinds[1:][(codes[:-1] == 0xC3) & (codes[1:] >= 0x9F) & (codes[1:] != 0xB7)] = LETTER
    blank = kinds == BLANK
    cuts = blank[1:] != blank[:-1]
    cuts |= (kinds[:-1] == LETTER) & (kinds[1:] == MARK)
    starts = np.concatenate([[0], np.flatnonzero(cuts) + 1])
    offsets = pa.py_buffer(np.append(starts, len(data)))
    words = ~blank[starts]
    runs = pa.LargeStringArray.from_buffers(len(starts), offsets, pa.py_buffer(data))
    return runs.filter(pa.array(words)), starts[words]


class WordIds:
    """Ids of words between blanks, as little-endian 32-bit bytes; recent ones are remembered.

    The tokenizer lowers texts, drops white space and never joins across it, so the ids of a text are those
    of its lowered words one after another. It never joins a letter or digit and a mark behind it either, so
    words are cut there too. Texts are cut and their words told apart as arrays, so a word costs a look-up
    once in TOGETHER bytes; the unknown ones are encoded in one call, a line each, those of PLAIN letters by
    ``merges`` if given. A text that may name an added token, which the tokenizer finds before all this, is
    encoded whole.
    """

    def __init__(self, tokenizer, remembered=REMEMBERED, added=(), merges=None):
        self.tokenizer, self.remembered, self.merges = tokenizer, remembered, merges
        self.added = [a.lower() for a in added]
        self.young, self.old = {}, {}

    def encode_words(self, words):
        encoded = self.tokenizer.encode("\n".join(words), add_special_tokens=False)
        ids = np.asarray(encoded.ids, "<u4")
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        places = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(ids))
        self.remember(words, ids, np.searchsorted(places, starts[1:]))

    def remember(self, words, ids, cuts):
        data, at = ids.tobytes(), 0
        for w, end in zip(words, [*(4 * cuts).tolist(), len(data)], strict=True):
            self.young[w] = data[at:end]
            at = end

    def learn(self, unknown):
        plain = [w for w in unknown if PLAIN(w)] if self.merges else []
        made = plain and self.merges(plain)
        if made:
            self.remember(plain, *made)
            unknown = [w for w in unknown if w not in self.young]
        if unknown:
            self.encode_words(sorted(unknown))

    def look_up(self, words):
        """The ids of each of these different words as bytes."""
        if len(self.young) > self.remembered:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        young |= {w: old[w] for w in (words[k] for k in missing) if w in old}
        self.learn([w for w in (words[k] for k in missing) if w not in young])
        for k in missing:
            found[k] = young[words[k]]
        return found

    def encode(self, texts):
        """The ids of each text as bytes, with the closing id 0."""
        lows = [lowered(text) for text in texts]
        whole = {k for k, low in enumerate(lows) if any(a in low for a in self.added)}
        parts = [b"" if k in whole else low.encode() for k, low in enumerate(lows)]
        words, starts = segments(b"\n".join(parts) + b"\n")
        told = words.dictionary_encode()
        ids = pa.array(self.look_up(told.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        ids = ids.take(told.indices)
        ends = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
        places = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.append(0, ends)].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        out = [b"%b\0\0\0\0" % data[a:b] for a, b in zip(places, places[1:])]
        for k in whole:
            encoded = self.tokenizer.encode(texts[k], add_special_tokens=False)
            out[k] = np.array([*encoded.ids, 0], "<u4").tobytes()
        return out


class Merges:
    """The tokenizer's merges alone, for words that it takes as they are; a last token of a word ends in ``suffix``."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare = Tokenizer(tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), level])
        suffix = tokenizer.model.end_of_word_suffix
        self.last = np.zeros(tokenizer.get_vocab_size(), bool)
        self.last[[k for token, k in tokenizer.get_vocab(False).items() if token.endswith(suffix)]] = True

    def __call__(self, words):
        """The ids of the words one after another, and the places where all but the first start; None if these are not clear."""
        (encoded,) = self.bare.encode_batch_fast(["\n".join(words)], add_special_tokens=False)
        ids = np.asarray(encoded.ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, ends[:-1]) if len(ends) == len(words) else None


_word_ids = {}


def word_ids(path, remembered=REMEMBERED):
    """The remembered words of a tokenizer's file, kept by a worker from task to task."""
    if (path, remembered) not in _word_ids:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        merges = Merges(tokenizer) if getattr(tokenizer.model, "end_of_word_suffix", None) else None
        _word_ids[path, remembered] = WordIds(tokenizer, remembered, added, merges)
    return _word_ids[path, remembered]


def together(texts):
    """Lists of texts, in order, of about TOGETHER characters each."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def token_pieces(documents, tokenizer, size=SEQUENCE, remembered=REMEMBERED):
    """Cut every document into pieces of at most ``size`` tokens; only longer ones are cut.

    Returns doc_id, piece, start, length, ids_crc32. A null text is empty and gives one piece with the
    closing id alone. ``tokenizer`` is the path of the tokenizer's file on every machine.
    A worker keeps the ids of up to twice ``remembered`` words, some 150 bytes each; results do not depend on it.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def pieces(batches):
        words = word_ids(tokenizer, remembered)
        for batch in batches:
            rows, out = [], []
            texts = (t.as_py() or "" for t in batch.column(1))
            encoded = (data for some in together(texts) for data in words.encode(some))
            for k, data in enumerate(encoded):
                for piece, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    rows.append(k)
                    out.append((piece, at // 4, len(part) // 4, crc32(part)))
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            table = np.array(out, np.int64).reshape(-1, 4)
            columns = [ids, pa.array(table[:, 0].astype(np.int32)), *[pa.array(table[:, k]) for k in (1, 2, 3)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(
        pieces, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths, capacity=Capacity()):
    """(sequence, offset) of each piece; lengths are at most capacity.tokens."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    limits = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    scale = np.asarray(capacity.weights) / limits**2
    least = lengths.min(initial=capacity.tokens)
    # residuals of the open sequences; one that no piece can enter any more is closed
    left, ids, n_open, made = np.empty((1024, 3)), np.empty(1024, np.int64), 0, 0
    for k in order:
        need = np.array([lengths[k], 1, lengths[k] * lengths[k]], float)
        open_ = left[:n_open]
        fits = (open_[:, 0] >= need[0]) & (open_[:, 1] >= 1) & (open_[:, 2] >= need[2])
        where = np.flatnonzero(fits)
        if len(where):
            rest = open_[where]
            cost = (rest - need) ** 2 @ scale if capacity.measure == "norm" else rest * need @ scale
            at = where[np.argmin(cost)]
        else:
            if n_open == len(left):
                left, ids = np.concatenate([left, np.empty_like(left)]), np.concatenate([ids, np.empty_like(ids)])
            at, n_open = n_open, n_open + 1
            left[at], ids[at] = limits, made
            made += 1
        sequence[k], offset[k] = ids[at], limits[0] - left[at, 0]
        left[at] -= need
        if left[at, 0] < least or left[at, 1] < 1 or left[at, 2] < least * least:
            n_open -= 1
            left[at], ids[at] = left[n_open], ids[n_open]
    return sequence, offset


def packed(pieces, groups, capacity=Capacity()):
    """Add sequence_id and offset to rows with a length; sequence ids hold the group in the upper bits."""
    names = pieces.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def pack(rows):
        order = [("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")]
        rows = rows.sort_by(order)
        sequence, offset = best_fit(rows["length"].to_numpy(), capacity)
        first = rows["_group"][0].as_py() << 32
        rows = rows.select(names)
        return rows.append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    return (
        pieces.withColumn("_group", group)
        .groupBy("_group")
        .applyInArrow(pack, f"{fields}, sequence_id long, offset long")
    )


def pack_documents(documents, tokenizer, capacity=Capacity(), remembered=REMEMBERED):
    """All documents as pieces with their places in sequences.

    Null and empty texts are one token each. Repeated rows are packed as often as they come. Only doc_id
    and text are read. No rows give no rows.
    """
    n, size = documents.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = int(n + (size or 0) // (4 * capacity.tokens)) // GROUP_PIECES + 1
    return packed(token_pieces(documents, tokenizer, capacity.tokens, remembered), groups, capacity)
