"""Operators 11 to 13: nearest neighbours by stable projections, importance resampling, fill-in-the-middle."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halocline.llm import fill_middle, stable_knn, target_resampling
from halocline.llm.queries import QUERIES

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op13


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abZ <>PSMé\U0001f600\n1", max_size=300))
def test_skip_list_places(text):
    towers = fill_middle.Towers()
    starts = fill_middle.token_starts(text)
    tokens = TOKEN.findall(text)
    assert [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])] == tokens
    widths = fill_middle.SkipList(starts, len(text), towers)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(int)
    assert [widths.place(r) for r in range(len(tokens) + 1)] == ends.tolist()


def test_skip_list_lanes_thin_out_and_agree():
    towers = fill_middle.Towers()
    long, short = towers.of(100_000), fill_middle.Towers().of(5_000)
    sizes = [len(lane) for lane in long]
    assert len(sizes) < 16 and all(a > 2 * b for a, b in zip(sizes[:4], sizes[1:5]))
    assert all((a[: len(b)] == b).all() for a, b in zip(long, short))
    assert all(lane[0] == 0 for lane in long)


def expected_fim(doc_id, text, seed=1, rate=90, spm=20):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(tokens), "plain", None, None, text
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < spm:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_agrees_with_a_plain_program(spark, odd_documents, small_dir):
    marked = spark.createDataFrame(
        [(1, "a <P> b"), (2, "<S>"), (3, "x <<M> y"), (4, "<P <S <M ends with <P"), (5, "<" * 50), (6, "a" * 300_000), (None, "é" * 999)] * 2,
        "doc_id long, text string",
    )
    for docs in (odd_documents, marked, spark.read.parquet(f"{small_dir}/documents.parquet")):
        want, digests = Counter(), Counter()
        for r in docs.select("doc_id", "text").collect():
            n, form, p, m, out = expected_fim(r.doc_id, r.text)
            want[(r.doc_id, n, form, p, m, out)] += 1
            digests[(r.doc_id, n, form, p, m, sha(out), sha(r.text or ""))] += 1
        assert Counter(tuple(r) for r in fill_middle.fill_in_middle(docs).collect()) == want
        assert Counter(tuple(r) for r in fill_middle.digest(docs).collect()) == digests


def test_fill_in_middle_keeps_columns_and_takes_no_rows(odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(fill_middle, "ROWS", 2)
    plan = fill_middle.Plan(seed=9, rate=100, spm=50)
    rows = fill_middle.fill_in_middle(odd_documents, plan, keep=("doc_id", "source", "kept", "text")).collect()
    assert rows[0].asDict().keys() == {"doc_id", "source", "kept", "text", "n", "form", "prefix_chars", "middle_chars", "output"}
    assert {r.form for r in rows if r.text} == {"psm", "spm"}
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected_fim(r.doc_id, r.text, 9, 100, 50) for r in rows)
    assert fill_middle.digest(no_documents).count() == 0


# op12


def expected_draw(docs, target, shortest=1, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(text):
        words = WORDS.findall(lower(text))
        runs = [" ".join(words[i : i + k]) for k in range(shortest, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    rows = [(r.doc_id, *features(r.text)) for r in docs]
    raw = Counter(b for _, _, found in rows for b in found)
    aim = Counter(b for t in target for b in features(t.text)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in raw}
    out = []
    for doc_id, n, found in rows:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha(f"{seed}:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = Counter()
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        ranks[(r[0], *r[2:], k + 1)] += 1
    for r in [r for r in out if r[1] < least] + fit[percent * len(fit) // 100 :]:
        ranks[(r[0], *r[2:], None)] += 1
    return ranks


@pytest.mark.parametrize("shortest,longest,percent", [(1, 1, 10), (1, 3, 50), (2, 2, 100)])
def test_resampling_agrees_with_a_plain_program(spark, odd_documents, odd_benchmark, small_dir, shortest, longest, percent):
    small = [spark.read.parquet(f"{small_dir}/{n}.parquet") for n in ("documents", "benchmark")]
    features = target_resampling.Features(shortest, longest)
    for docs, target in ([odd_documents, odd_benchmark], small):
        rows = target_resampling.resample(docs, target, features, percent)
        assert rows.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        want = expected_draw(docs.select("doc_id", "text").collect(), target.select("text").collect(), shortest, longest, percent=percent)
        assert Counter(tuple(r) for r in rows.collect()) == want


def test_ranks_of_ties_follow_ids(spark, monkeypatch):
    """Many rows of one score, ids far apart and repeated, in few and in many ranges."""
    ids = [None, -(2**62), 2**62, 5, 5, 5, 7, *range(100, 140)]
    scored = spark.createDataFrame([(i, 30, 30, 1, 40 + k % 2) for k, i in enumerate(ids)], "_id long, n_words long, n_features long, weight long, score long")
    for ranges in (1, 1024):
        monkeypatch.setattr(target_resampling, "ID_RANGES", ranges)
        rows = target_resampling.ranked(scored, 60).collect()
        got = [(r.score, r["_id"]) for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])]
        order = sorted(((40 + k % 2, i) for k, i in enumerate(ids)), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        assert got == order[: len(ids) * 60 // 100]
        assert len(rows) == len(ids)


def test_resampling_of_nothing(spark, odd_documents, no_documents, odd_benchmark):
    assert target_resampling.resample(no_documents, odd_benchmark).count() == 0
    rows = target_resampling.resample(odd_documents, odd_benchmark.where("false"), percent=0).collect()
    assert len(rows) == odd_documents.count() and not any(r["rank"] for r in rows)
    few = target_resampling.Checksums(most=2)
    assert [few[w] for w in "abcabc"] == [zlib.crc32(w.encode()) for w in "abcabc"]


# op11


def brute_nearest(rows, k, every):
    """{query: [(distance, id)]} over distinct (id, vector) rows."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    dims = max((len(v) for _, v in good), default=0)
    good = sorted((i, tuple(v) + (0.0,) * (dims - len(v))) for i, v in good)
    x = np.array([v for _, v in good])
    out = {}
    for q, (i, v) in enumerate(good):
        if i % every == 0:
            apart = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            out.setdefault(i, []).append(sorted((apart[j], good[j][0]) for j in range(len(good)) if j != q)[:k])
    return out


def test_chi_square_is_the_distribution_function():
    for m in (2, 4, 16):
        for x in (0.1, 1.0, 7.0, 30.0):
            closed = 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))
            assert stable_knn.chi_square(x, m) == pytest.approx(closed, abs=1e-12)
        assert stable_knn.chi_square(stable_knn.chi_square_quantile(0.9, m), m) == pytest.approx(0.9)


def test_tree_leaves_hold_their_points():
    points = np.round(np.random.default_rng(3).normal(size=(900, 3)), 1)
    points[:300] = points[0]
    tree = stable_knn.KdTree(points, 50)
    assert sorted(tree.order.tolist()) == list(range(900))
    leaf = tree.leaf_of(points)
    for k, (a, b) in enumerate(tree.spans):
        assert (leaf[tree.order[a:b]] == k).all()
        assert b - a <= 50 or (points[tree.order[a:b]] == points[tree.order[a]]).all()


def test_neighbours_come_in_the_order_of_projected_distance():
    rng = np.random.default_rng(5)
    part = stable_knn.Part(rng.normal(size=(3000, 20)), np.arange(3000), stable_knn.Projection(8))
    point = rng.normal(size=20) @ part.directions
    found = [d for d, _ in part._incremental(point, lambda: np.inf)]
    flat = np.concatenate(found)
    assert len(flat) == 3000 and (np.diff(flat) >= 0).all()


def test_search_stops_before_the_end_where_neighbours_are_near():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32)) * 10
    vectors = np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 32)) * 0.1
    part = stable_knn.Part(vectors, np.arange(4000), stable_knn.Projection(16))
    opened = []
    incremental = part._incremental
    part._incremental = lambda *a: (opened.append(len(b[1])) or b for b in incremental(*a))
    distance, _ = part.nearest(vectors[0], 10)
    want = np.sort(np.sqrt(((vectors - vectors[0]) ** 2).sum(axis=1)))[:10]
    assert distance == pytest.approx(want) and sum(opened) < 400


def check_found(rows, want, k, least):
    hits = total = 0
    for i, lists in want.items():
        got = sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == i)
        assert len(got) == sum(len(w) for w in lists)
        if len(lists) > 1:
            continue
        assert [g[0] for g in got] == list(range(1, len(lists[0]) + 1))
        assert [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
        for (d, _), g in zip(lists[0], got):
            assert g[2] >= d - 1e-12
        hits += len({g[1] for g in got} & {j for _, j in lists[0]})
        total += len(lists[0])
    assert {r.query_id for r in rows} == {i for i, w in want.items() if w[0]}
    assert hits >= least * total


def test_recall_on_the_shipped_table(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        rows = QUERIES["op11_stable_kdtree"](spark, f"/root/testdata/{sf}").collect()
        table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        check_found(rows, brute_nearest([(r.vec_id, r.embedding) for r in table.collect()], 10, 100), 10, 0.95)


def test_odd_vectors_and_many_parts(spark, monkeypatch):
    """Nulls, copies beyond k, ties, repeated ids and rows, short vectors, clashing columns, several parts and query groups."""
    monkeypatch.setattr(stable_knn, "PART_ROWS", 64)
    monkeypatch.setattr(stable_knn, "QUERY_ROWS", 16)
    monkeypatch.setattr(stable_knn, "LEAF_ROWS", 16)
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(500)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300)] + [(1000, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])] * 50
    rows += [(5, None), (None, [1.0] * 6), (6, []), (7, [0.0] * 6), (10, [float("nan")] * 6), (20, [None, 1.0]), (30, [math.inf] * 6), (2000, [3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, cell int, part string, least double")
    got = stable_knn.nearest(df, every=10).collect()
    check_found(got, brute_nearest(rows, 10, 10), 10, 0.95)
    at = [(r["rank"], r.vec_id, r.score) for r in got if r.query_id == 1100]
    assert sorted(at) == [(k + 1, 1000 + k, 0.0) for k in range(10)]


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert stable_knn.nearest(spark.createDataFrame([], schema)).count() == 0
    assert stable_knn.nearest(spark.createDataFrame([(100, [1.0])], schema)).count() == 0
    got = stable_knn.nearest(spark.createDataFrame([(100, [1.0]), (3, [3.0]), (2, [-1.0])], schema)).collect()
    assert [tuple(r) for r in sorted(got)] == [(100, 1, 2, 2.0), (100, 2, 3, 2.0)]
