"""Operators whose results a plain program gives too: op1, op2, op4, op5, op9, op10."""

import hashlib
import itertools
import re
import sys
import time
import tracemalloc
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from halocline.llm import bayes_join, license_rules, mixing, multiset_hash, prefix_free, vector_packing
from halocline.llm.common import CLEANUP, stored
from halocline.llm.queries import word_tokenizer
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def both(spark, odd_documents, small_dir):
    return [odd_documents, spark.read.parquet(f"{small_dir}/documents.parquet")]


# op1


def expected_targets(sizes):
    """Iterated sharing: whoever exceeds three times its size keeps that, the others share anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, rest, open_ = {}, float(sum(sizes.values())), set(names)
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 3.0 * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
        rest -= sum(target[s] for s in over)
        open_ -= over


def test_mix_targets_and_sums(spark, odd_documents, small_dir):
    for docs in both(spark, odd_documents, small_dir):
        texts = docs.select("doc_id", "text", "source").collect()
        size = Counter()
        for r in texts:
            size[r.source] += len(WORD.findall(r.text or ""))
        targets = expected_targets(size)
        rows = mixing.copies_of(docs).collect()
        assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == Counter(
            (r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in texts
        )
        taken, largest = Counter(), Counter()
        for r in rows:
            largest[r.source] = max(largest[r.source], r["size"])
            assert r.target == pytest.approx(targets[r.source]) and r.source_size == size[r.source]
            assert 0 <= r.copies <= 3
            taken[r.source] += r.copies * r["size"]
        for s, t in targets.items():
            assert abs(taken[s] - t) <= max(1, largest[s] / 2)
        again = mixing.mix_digest(docs).collect()
        assert Counter(again) == Counter(mixing.mix_digest(docs).collect())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=5), st.floats(0, 1))
def test_subset_counts_stay_within_and_near(counts, part):
    sizes, n = list(counts), list(counts.values())
    total = sum(s * c for s, c in counts.items())
    took = mixing.subset_counts(sizes, n, part * total)
    assert all(0 <= t <= c for t, c in zip(took, n))
    reach = {sum(s * k for s, k in zip(sizes, ks)) for ks in itertools.product(*[range(c + 1) for c in n])}
    # the proportional part is kept, so the best sum may be missed by less than the largest size
    best = min(abs(x - part * total) for x in reach)
    assert abs(float(np.dot(sizes, took)) - part * total) <= best + max(sizes)


def test_subset_counts_fill_a_large_remainder():
    sizes = np.arange(1, 4000)
    took = mixing.subset_counts(sizes, np.ones(len(sizes), int), 0.37 * sizes.sum())
    assert abs(int((sizes * took).sum()) - 0.37 * sizes.sum()) <= 1


def test_large_remainders_keep_the_lengths_of_the_source():
    rng = np.random.default_rng(1)
    sizes = np.unique(rng.integers(1, 20000, 4000))
    for n in (np.ones(len(sizes), int), rng.integers(1, 4, len(sizes))):
        took = mixing.subset_counts(sizes, n, 0.4 * (sizes * n).sum())
        mean, whole = (sizes * took).sum() / took.sum(), (sizes * n).sum() / n.sum()
        assert abs(mean / whole - 1) < 0.05
        for part in (sizes < 2000, sizes > 15000):
            assert abs(took[part].sum() / n[part].sum() - 0.4) < 0.06
        assert abs((sizes * took).sum() - 0.4 * (sizes * n).sum()) <= 1


def test_mixed_rows_keep_columns_and_counts(odd_documents):
    rows = mixing.mixed(odd_documents)
    assert rows.columns == odd_documents.columns
    copies = Counter()
    for r in mixing.copies_of(odd_documents).collect():
        copies[(r.doc_id, r["size"])] += r.copies
    got = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows.collect())
    assert got == Counter({k: v for k, v in copies.items() if v})


# op2


def brute_kept(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def test_repeats_are_those_of_brute_force(spark, odd_documents, small_dir):
    for docs in both(spark, odd_documents, small_dir):
        rows = docs.select("doc_id", "text").collect()
        expected = Counter((r.doc_id, *e) for r, e in zip(rows, brute_kept([r.text for r in rows], 400)))
        assert Counter(tuple(r) for r in prefix_free.removal_digest(docs).collect()) == expected


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=5))
def test_reaches_hold_every_window_once(texts):
    for text in texts:
        at, first, last, *_ = prefix_free.reaches(np.frombuffer(text.encode(), np.uint8), 24, 8)
        starts = [s for a, b in zip(first, last) for s in range(a, b + 1)]
        assert starts == list(range(max(0, len(text) - 23)))
        assert all(b <= x <= a + 16 for x, a, b in zip(at, first, last))


def test_repeats_of_short_strings_and_low_entropy(spark):
    texts = ["ab" * 40, "abc" * 30, "a" * 70, "xyzzy" * 9 + "a" * 30, "q" * 23, "abab" + "b" * 40, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = prefix_free.without_repeats(docs, length=24, anchor=8).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert got == dict(enumerate(brute_kept(texts, 24)))


def test_long_texts_are_parsed_in_parts(monkeypatch):
    data = np.frombuffer(np.random.default_rng(1).bytes(5000), np.uint8)
    whole = prefix_free.reaches(data)
    monkeypatch.setattr(prefix_free, "PART", 700)
    parts = prefix_free.reaches(data)
    place = lambda r: [x for x, a, b in zip(r[0], r[1], r[2]) for _ in range(a, b + 1)]
    assert place(whole) == place(parts)


def test_a_name_is_told_twice_a_batch_and_settled_beyond(spark):
    rng = np.random.default_rng(4)
    common, own = rng.integers(97, 123, 900), rng.integers(97, 123, (40, 300))
    texts = [bytes([*own[k][:150], *common, *own[k][150:]]).decode() for k in range(40)]
    keys = pa.array(range(40), pa.int64())
    batch = pa.RecordBatch.from_arrays([keys, keys, pa.array(texts)], names=["k1", "k2", "text"])
    rows = pa.Table.from_batches(prefix_free._parse(240, 48)([batch])).to_pylist()
    told = Counter((r["c1"], r["c2"]) for r in rows if r["c1"] is not None)
    known = [r for r in rows if r["c1"] is None]
    assert max(told.values()) == 2 and Counter(r["k1"] for r in known) == dict.fromkeys(range(2, 40), 1)
    for r in known:
        assert 150 <= r["place"] <= r["trigger"] <= 150 + 900 - 240
    starts = Counter()
    for r in rows:
        at, far, near = prefix_free._unpacked(r["place"])
        starts[r["k1"]] += r["trigger"] - r["place"] + 1 if r["c1"] is None else far - near + 1
    assert starts == dict.fromkeys(range(40), 1200 - 239)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in prefix_free.without_repeats(docs, length=240, anchor=48).collect()}
    assert got == dict(enumerate(brute_kept(texts, 240)))


def test_cleaned_keeps_columns_and_whole_code_points(spark):
    same = "é" * 300
    docs = spark.createDataFrame([(1, "a" + same + "z", 9), (2, "b" + same, 9), (3, None, 9)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: (r.text, r.n_chars) for r in prefix_free.cleaned(docs).collect()}
    assert rows == {1: ("az", 2), 2: ("b", 1), 3: (None, None)}


def test_cleaned_ships_the_text_once(spark, monkeypatch):
    seen, real = [], prefix_free.without_repeats
    monkeypatch.setattr(prefix_free, "without_repeats", lambda docs, *rest: seen.append(docs.schema) or real(docs, *rest))
    docs = [("x", 1, "a" * 500, 500, "y"), ("x", 2, "odd \ufffd" + "b" * 300, 9, None), ("x", 3, "odd \ufffd", 9, "y"), (None, 4, None, 9, "y"), ("x", 5, "", 0, "y")]
    docs = spark.createDataFrame(docs, "absent string, doc_id long, text string, n_chars long, row string")
    cleaned = prefix_free.cleaned(docs, 240, 48)
    assert cleaned.columns == docs.columns and cleaned.dtypes == docs.dtypes
    rows = {r.doc_id: tuple(r)[:1] + tuple(r)[2:] for r in cleaned.collect()}
    assert rows[1] == ("x", "", 0, "y") and rows[2] == ("x", "odd ", 4, None)
    assert rows[3] == ("x", "odd \ufffd", 5, "y") and rows[4] == (None, None, None, "y") and rows[5] == ("x", "", 0, "y")
    carried = [f.dataType.simpleString() for f in seen[0]["row"].dataType]
    assert sorted(carried) == ["bigint", "boolean", "string", "string"]


def test_stored_leaves_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
        return {f.rpartition("/")[2] for f in files.split(",") if "/shuffle_" in f}

    before, kept = shuffles(), spark.conf.get(CLEANUP, None)
    counts = stored(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), "counts")
    deadline = time.monotonic() + 20
    while shuffles() - before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(CLEANUP, None) == kept and counts.count() == 700


# op4


def brute_links(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    links, group = [0] * len(sets), list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and sets[i] | sets[j]:
            links[i] += 1
            links[j] += 1
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    return links, group


def test_links_and_classes_are_those_of_brute_force(spark, odd_documents, small_dir):
    for docs in both(spark, odd_documents, small_dir):
        rows = docs.select("doc_id", "text").collect()
        links, group = brute_links([r.text for r in rows])
        least = defaultdict(lambda: None)
        for r, g in zip(rows, group):
            if r.doc_id is not None:
                least[g] = r.doc_id if least[g] is None else min(least[g], r.doc_id)
        expected = Counter((r.doc_id, least[g], n) for r, g, n in zip(rows, group, links))
        assert Counter(tuple(r) for r in bayes_join.link_counts(docs).collect()) == expected
        kept = bayes_join.one_of_each_class(docs)
        assert kept.columns == docs.columns and kept.count() == len(set(group))


def test_blocks_of_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(bayes_join, "BLOCK", 4)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(0, 200, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, group = brute_links(texts)
    rows = {r.doc_id: (r.class_id, r.links) for r in bayes_join.link_counts(docs).collect()}
    assert rows == {k: (g, n) for k, (g, n) in enumerate(zip(group, links))} and max(links) > 10


def test_remembered_hashes_take_little_memory():
    words = bayes_join.WordHashes()
    tracemalloc.start()
    try:
        found = [words[b"w%d" % k] for k in range(400_000)]
        own = sum(sys.getsizeof(v) for v in found) + sys.getsizeof(found)
        held = tracemalloc.get_traced_memory()[0] - own
    finally:
        tracemalloc.stop()
    assert held < 32 << 20
    assert all(bayes_join.WordHashes()[b"w%d" % k] == found[k] for k in range(0, 400_000, 9_973))


def test_posterior_bounds():
    assert bayes_join.least_matches(128) < 0.8 * 128 < 128
    assert [bayes_join.least_matches(n) for n in (32, 64, 96, 128)] == sorted(bayes_join.least_matches(n) for n in (32, 64, 96, 128))


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    rows = bayes_join.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}


# op5


def test_pieces_and_places(spark, odd_documents, small_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    for docs in both(spark, odd_documents, small_dir):
        expected, total = Counter(), 0
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            total += len(ids)
            for k, at in enumerate(range(0, len(ids), 2048)):
                part = ids[at : at + 2048]
                expected[(r.doc_id, k, at, len(part), crc32(part.tobytes()))] += 1
        rows = vector_packing.pack_documents(docs, word_tokenizer()).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append((r.offset, r.length))
        for places in sequences.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= 2048
        assert len(sequences) <= -(-total // 2048) + 2


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_every_capacity_holds(measure):
    lengths = np.random.default_rng(3).integers(1, 100, 400)
    capacity = vector_packing.Capacity(100, 3, 4000, (1.0, 0.5, 0.5), measure)
    sequence, _ = vector_packing.best_fit(lengths[lengths**2 <= 4000], capacity)
    fit = lengths[lengths**2 <= 4000]
    for s in np.unique(sequence):
        part = fit[sequence == s]
        assert part.sum() <= 100 and len(part) <= 3 and (part**2).sum() <= 4000


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_words_give_the_ids_of_the_text(texts):
    words = vector_packing.word_ids(word_tokenizer())
    for t, data in zip(texts, words.encode(texts)):
        ids = [*words.tokenizer.encode(t, add_special_tokens=False).ids, 0]
        assert data == np.array(ids, "<u4").tobytes()


def test_forms_of_a_word_are_encoded_once():
    known, asked = vector_packing.word_ids(word_tokenizer()).tokenizer, []

    class Asked:
        def encode(self, text, **more):
            asked.extend(text.split("\n"))
            return known.encode(text, **more)

    words = vector_packing.WordIds(Asked())
    texts = ["Éclair éclair, ÉCLAIR! (éclair) don't O'Neil's 3,5. x²!", "«Σας» ΣΑΣ, I\u0307! <\u0338 =\u0338, a\u0301. ½!! été...", "éclair!"]
    for t, data in zip(texts, words.encode(texts), strict=True):
        assert data == np.array([*known.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
    assert len(asked) == len(set(asked)) and [w for w in asked if "clair" in w] == ["(éclair", "éclair"]


def test_plain_words_are_encoded_by_the_merges():
    known, asked = vector_packing.word_ids(word_tokenizer()).tokenizer, []

    class Asked:
        def encode(self, text, **more):
            asked.extend(text.split("\n"))
            return known.encode(text, **more)

    words = vector_packing.WordIds(Asked(), merges=vector_packing.Merges(known))
    texts = ["Été été, ÉTÉ... (été) ÿ! ß÷ µ don't naïve", "ΣΑΣ Été été, I\u0307 aujourd'hui «ß»! Îles", "xyzzy naïve"]
    for t, data in zip(texts, words.encode(texts), strict=True):
        assert data == np.array([*known.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
    marked = ["'hui", "'t", "(été", "...", ",", "!", "«ß»!", "ß÷", ")", "µ"]
    assert set(asked) == {*marked, "ΣΑΣ", "Été", "I\u0307", "Îles"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aZéÉßÿ÷µªΣσ\u0301\u0338 \n\xa0\x85\x1f'.,<|9²s", max_size=25), max_size=6))
def test_words_cut_at_marks_give_the_ids_of_the_text(texts):
    words = vector_packing.word_ids(word_tokenizer())
    for t, data in zip(texts, words.encode(texts), strict=True):
        assert data == np.array([*words.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_added_tokens_in_a_text(spark):
    words = vector_packing.word_ids(word_tokenizer())
    texts = ["one", "a <|endoftext|> b, c", "<|EndOfText|>", "x<|startoftext|>Y<|endoftext|>", "<|endoftext", ""]
    expected = [np.array([*words.tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert np.frombuffer(expected[1], "<u4").max() == 49407
    assert words.encode(texts) == expected
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r.doc_id: r.ids_crc32 for r in vector_packing.token_pieces(docs, word_tokenizer()).collect()}
    assert made == {k: crc32(data) for k, data in enumerate(expected)}


def test_texts_are_looked_up_in_bounded_lots(monkeypatch):
    monkeypatch.setattr(vector_packing, "TOGETHER", 5)
    assert list(vector_packing.together(["abc", "", "de", "f" * 20, "g", ""])) == [["abc", "", "de"], ["f" * 20], ["g", ""]]
    assert list(vector_packing.together([])) == []


def test_words_beyond_the_cache_keep_their_ids():
    known = vector_packing.word_ids(word_tokenizer()).tokenizer
    words = vector_packing.WordIds(known, remembered=3)
    for texts in (["one two three", "four five"], ["one six", "two six seven"], ["eight nine one"], ["one two"], ["six ten", ""]):
        for t, data in zip(texts, words.encode(texts), strict=True):
            assert data == np.array([*known.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert len(words.young) <= 3 + 6 + 1


def test_the_pipeline_remembers_fewer_words_and_packs_alike(spark, small_dir):
    assert 2 * corpus_pipeline.REMEMBERED * 200 < 64 << 20
    words = vector_packing.word_ids(word_tokenizer(), 50)
    for k in range(0, 1000, 20):
        words.encode([" ".join(f"w{n}" for n in range(k, k + 20))])
        assert len(words.young) + len(words.old) <= 2 * (50 + 20 + 1)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    packs = [vector_packing.pack_documents(docs, word_tokenizer(), remembered=n) for n in (50, vector_packing.REMEMBERED)]
    few, many, stage = [Counter(map(tuple, p.collect())) for p in [*packs, corpus_pipeline.packing(spark, docs, small_dir)]]
    assert few == many == stage


# op9

LICENSE = re.compile(license_rules.LICENSE_WORD)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_finds(text):
    tokens = LICENSE.findall((text or "").translate(LOWER))
    norm = " " + " ".join(tokens) + " "
    places = []
    for k, label, keyword, expression, confidence in license_rules.rules():
        if f" {keyword} " in norm:
            for m in re.finditer(expression, norm):
                first = norm[: m.start()].count(" ") - 1
                places.append((first, -(first + m[0].count(" ") + 1), k, label, confidence))
    places.sort()
    kept, end = [], 0
    for p in places:
        if -p[1] > end:
            kept.append(p)
            end = -p[1]
    base = []
    for phrase, label in license_rules.BASE:
        w = phrase.split()
        base += [(k, label) for k in range(len(tokens)) if tokens[k : k + len(w)] == w]
    return len(tokens), sorted(base), kept


def test_license_finds(spark, odd_documents, small_dir):
    more = spark.createDataFrame(
        [
            (1, "mit license mit license, the Mit  licenses"), (2, "Licensed under the Apache License, Version 2.0"),
            (3, "GNU Lesser General Public License v3 or GNU general public license"), (4, "SPDX-License-Identifier: BSD-3-Clause"),
            (5, "MIT license " * 50), (6, "mitlicense émit license"), (7, "All rights reserved. Redistribution and use in source and binary forms, with or without modification"),
        ],
        "doc_id long, text string",
    )
    for docs in [*both(spark, odd_documents, small_dir), more]:
        expected = Counter()
        for r in docs.select("doc_id", "text").collect():
            n, base, kept = brute_finds(r.text)
            labels = sorted({x for _, x in base} | {k[3] for k in kept})
            score = max([0.0, *[0.85 for _ in base], *[k[4] for k in kept]])
            expected[
                (
                    r.doc_id, n, len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted({x for _, x in base})), ",".join(labels), score, len(kept),
                )
            ] += 1
        assert Counter(tuple(r) for r in license_rules.license_summary(docs).collect()) == expected


def test_rules_are_many_and_gated():
    rules = license_rules.rules()
    assert len(rules) > 250
    for _, _, keyword, expression, _ in rules:
        re.compile(expression)
    named = re.compile(license_rules.SHORT_GATE)
    for _, _, keyword, expression, _ in rules:
        assert any(g in f"{keyword} {expression}" for g in license_rules.GATES) or "licen" in expression or named.search(keyword) or named.search(expression)


def ungated_labels(text):
    """Labels of the finds kept when every expression is tried."""
    norm = " " + " ".join(LICENSE.findall(text.translate(LOWER))) + " "
    places = []
    for k, label, _, expression, _ in license_rules.rules():
        for m in re.finditer(expression, norm):
            first = norm[: m.start()].count(" ") - 1
            places.append((first, -(first + m[0].count(" ") + 1), k, label))
    kept, end = set(), 0
    for p in sorted(places):
        if -p[1] > end:
            kept.add(p[3])
            end = -p[1]
    return kept


def test_no_keyword_hides_a_find(spark, odd_documents, small_dir):
    texts = {
        "licensed under GPLv3": "gpl", "licensed under the LGPLv3": "lgpl", "AGPLv3 license": "agpl", "Expat license": "mit",
        "licensed under the Creative Commons Attribution-ShareAlike license": "cc-by-sa", "SSLeay license": "openssl",
        "Beer-Ware license": "beerware", **{
            f"SPDX-License-Identifier: {tag}": label for tag, label in (
                ("UPL-1.0", "upl"), ("ODbL-1.0", "odbl"), ("CPL-1.0", "cpl"), ("BUSL-1.1", "busl"), ("MS-RL", "ms-rl"), ("GPL-2.0-only", "gpl"),
            )
        },
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license_rules.license_summary(docs).collect()
    assert [r.labels for r in sorted(rows)] == list(texts.values())
    for docs in [docs, *both(spark, odd_documents, small_dir)]:
        rows = license_rules.scan(docs).select("doc_id", F.array_sort(F.array_distinct("finds.label")).alias("labels")).collect()
        expected = Counter((r.doc_id, *sorted(ungated_labels(r.text or ""))) for r in docs.select("doc_id", "text").collect())
        assert Counter((r.doc_id, *r.labels) for r in rows) == expected


@settings(max_examples=1500, deadline=None)
@given(st.sampled_from(license_rules.rules()).flatmap(lambda r: st.tuples(st.just(r[2]), st.from_regex(r[3][6:-5], fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz 0123456789"))))
def test_every_match_holds_its_keyword(match):
    keyword, text = match
    assert f" {keyword} " in f" {text} "
    assert any(g in text for g in license_rules.GATES) or re.search(license_rules.SHORT_GATE, text)


REAL = {
    "BSD 3-Clause": "bsd", "Apache-2.0": "apache", "released under the gplv3": "gpl", "This code is under MIT.": "mit",
    "under the terms of the GNU GPL, version 2": "gpl", "SPDX-License-Identifier: GPL-2.0-only OR MIT": "gpl,mit",
    "Redistributions of source code must retain the above copyright notice, this list of conditions": "bsd",
    "you may not use this file except in compliance with the License.": "apache",
    "This program is distributed in the hope that it will be useful,": "gpl", "see the LICENSE.md file for details": "license-file",
    "To the extent possible under law, the author has waived all copyright": "cc0",
    "please submit the mitten to the apaches and ask the permissive librarians": "",
}


def test_sentences_of_real_licenses(spark):
    rows = license_rules.license_summary(spark.createDataFrame(list(enumerate(REAL)), "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(rows)] == list(REAL.values())


def test_very_many_finds(spark):
    text = "MIT license " * 20_000
    row = license_rules.license_summary(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_base, row.first_word, row.last_word, row.n_words) == (20_000, 0, 39_998, 40_000)


# op10


def test_edited_texts_and_likeness(spark, odd_documents, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = sorted(multiset_hash.edited_fingerprints(docs).collect(), key=lambda r: r.doc_id)
    texts = [r.text for r in sorted(docs.select("doc_id", "text").collect())]
    prints = defaultdict(set)
    for k, r in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[text].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)
    assert np.mean([r.near_edited for r in rows]) > 0.6 > 0.2 > np.mean([r.near_next for r in rows])
    odd = multiset_hash.edited_fingerprints(odd_documents).collect()
    assert len(odd) == odd_documents.count() and all(r.near_edited is not None and r.near_next is not None for r in odd)


def test_order_and_edits_of_paragraphs(spark):
    df = spark.createDataFrame([("a b c d\ne f g\n\nh", "h\na b c d\ne f g", "e f g\nh")], "x string, y string, z string")
    x, y, z = (multiset_hash.fingerprint(F.col(c)) for c in "xyz")
    row = df.select(
        (x == y).alias("order"),
        (multiset_hash.insert(z, F.lit("a b c d")) == x).alias("added"),
        (multiset_hash.remove(x, F.lit("a b c d")) == z).alias("taken"),
        (x == z).alias("other"),
    ).first()
    assert tuple(row) == (True, True, True, False)


def test_likeness_where_counters_wrap(spark):
    def lanes(bits):
        """Lanes of a document whose triples have these rows of 48 bits, as ``fingerprint`` sums them."""
        sums = [int(x) for x in bits.sum(axis=0)]
        sketch = [sum(c << 15 * k for k, c in enumerate(sums[i : i + 4])) % multiset_hash.MODULUS for i in range(0, 48, 4)]
        return [len(bits), *[0] * (multiset_hash.EQUALITY - 1), len(bits), *sketch]

    rows, random = [], np.random.default_rng(7)
    for n in (1000, 60_000, 65_600, 70_000, 131_072, 200_000):
        bits = random.integers(0, 2, (n + n // 4, 48), dtype=np.uint8)
        rows.append((n, lanes(bits[:n]), lanes(bits[n // 4 :])))
        rows.append((-n, lanes(bits[:n]), lanes(bits[: n // 2])))
    df = spark.createDataFrame(rows, "n long, a array<long>, b array<long>")
    for r in df.select("n", multiset_hash.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        # unshared triples are a quarter of either, or the half that one lacks
        assert r.near == pytest.approx(0.75 if r.n > 0 else 2 / 3, abs=0.25), r.n


def test_next_crosses_buckets_and_wraps(spark):
    ids = [0, 1, 255, 256, 300, 2**20, 2**20 + 5, 2**33, -7]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "null")], "doc_id long, text string")
    rows = {r.text: r.next.text for r in multiset_hash.with_next(docs, ["text"]).collect()}
    order = [f"t{i}" for i in sorted(ids)] + ["null"]
    assert rows == dict(zip(order, order[1:] + order[:1]))


def test_empty_tables(no_documents):
    for made in (
        mixing.mix_digest(no_documents), prefix_free.removal_digest(no_documents), bayes_join.link_counts(no_documents),
        vector_packing.pack_documents(no_documents, word_tokenizer()), license_rules.license_summary(no_documents),
        multiset_hash.edited_fingerprints(no_documents), mixing.mixed(no_documents), prefix_free.cleaned(no_documents),
        bayes_join.one_of_each_class(no_documents),
    ):
        assert made.count() == 0


# pipeline


def brute_left(texts, length):
    """Texts less every byte that a string of ``length`` bytes covers which starts at two places."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_stage_takes_passages_of_fifty_words_out(spark, odd_documents):
    import corpus_pipeline
    from tests.llm.conftest import words

    rows = odd_documents.where("doc_id is null or doc_id <> 7").collect()
    passage = words(500, 52)
    planted = [(900 + k, words(600 + k, 70) + "\n" + passage + "\n" + words(700 + k, 60)) for k in range(4)]
    clean = [(950 + k, words(800 + k, 200)) for k in range(6)]
    docs = spark.createDataFrame(rows, odd_documents.schema).unionByName(
        spark.createDataFrame(planted + clean, "doc_id long, text string"), allowMissingColumns=True
    )
    given = docs.collect()
    got = corpus_pipeline.repeated_strings(spark, docs, None)
    assert got.columns == docs.columns
    left = brute_left([r.text for r in given], corpus_pipeline.PASSAGE)
    want = Counter((r.doc_id, None if r.text is None else t, r.source) for r, t in zip(given, left))
    got = got.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == want
    texts = {r.doc_id: r.text for r in got}
    middle = passage.split()[20]
    assert len(passage.encode()) >= corpus_pipeline.PASSAGE
    assert not any(middle in texts[i] for i, _ in planted) and all(texts[i] == t for i, t in clean)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
