"""Operators with learned or searched results: op3, op6, op7, op8, and the pipeline."""

import html
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halocline.llm import cover_tree, html_template, quality_rules, toxicity
from halocline.llm.common import auc
from halocline.llm.queries import QUERIES

# op3

PAGE = (
    "<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>{menu}</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div><main><h1>{title}</h1><p>{first}<p>{second}<br>more &amp; more</p>"
    "<!-- note --><ul><li>one</li><li>two</ul><form><input><button>Send</button>Name</form><div class=share-bar>Share</div></main>"
    "<section id=comments><p>{comment}</p></section><aside>Side {menu}</aside><footer>&copy; {menu}</footer></body></html>"
)


def test_article_of_template_pages(spark):
    rows = [
        (k, f"https://News.example.org:80/{k}", PAGE.format(menu=f"menu {k}", title=f"Title {k}", first=f"First  {k}\n text", second=f"<b>Bold</b> {k}", comment="nice " * 80), "x")
        for k in range(6)
    ]
    rows += [(10, None, None, "x"), (11, "u", "", "x"), (12, "https://one.example/", "<p>Only&nbsp;one <i>para</i>graph</p>", "x"), (0, rows[0][1], rows[0][2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_template.extract(pages).collect())
    expected = Counter()
    for k in [*range(6), 0]:
        # the list is the same on every page of the host, so it is template
        text = f"Title {k}\nFirst {k} text\nBold {k} more & more"
        expected[(k, text, len(text))] += 1
    for k, text in ((10, ""), (11, ""), (12, "Only one paragraph")):
        expected[(k, text, len(text))] += 1
    assert got == expected
    assert html_template.extract(pages.where("false")).count() == 0
    # of one page nothing is known to be template, and copies of one page have nothing that varies
    rows = {r.page_id: r.text for r in html_template.extract(pages.where("page_id in (0, 10)")).collect()}
    assert rows == {0: "Title 0\nFirst 0 text\nBold 0 more & more\none\ntwo", 10: ""}


@pytest.mark.parametrize(
    "page,text",
    [
        ("<h1>Title</h1><svg class='i'/><p>First paragraph.</p><svg><path/></svg><p>Second.</p>", "Title\nFirst paragraph.\nSecond."),
        ("<article><p>First.</p><iframe src=x /><p>Second.</p></article>", "First.\nSecond."),
        ("<header>Site</header><article><header class='post-header'><h1>Title</h1></header><p>Text.</p><footer>By me</footer></article>", "Title\nText."),
        ("<article><p>Text.</p><div class='social-history'>About it.</div><div class='social-links'>Like</div><div id='comment_list'>Nice</div></article>", "Text.\nAbout it."),
        ("<div class='top-nav'>Menu</div><div class='post'><p>Intro text.</p><div class='body'><p>Much longer body text.</p></div><p>End.</p></div>", "Intro text.\nMuch longer body text.\nEnd."),
        ("<article><p>Text &amp; more" + "<b>" * 5000, "Text & more"),
        ("<p>Kept.</p><script>var x = '<p>not</p>'", "Kept."),
    ],
)
def test_pages_that_lost_text(spark, page, text):
    html_ = f"<html><body>{page}"
    assert html_template.main_text(html_, None) == text
    pages = spark.createDataFrame([(1, "http://a.example/", html_), (2, "http://b.example/", html_), (3, "http://b.example/2", html_)], "page_id long, url string, html string")
    assert {r.text for r in html_template.extract(pages).collect()} == {text}


def test_very_long_pages(spark):
    page = "<article>" + "".join(f"<p>paragraph {k}</p>" for k in range(60_000)) + "</article>"
    rows = html_template.extract(spark.createDataFrame([(1, None, page)], "page_id long, url string, html string")).collect()
    assert rows[0].text == "\n".join(f"paragraph {k}" for k in range(60_000))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_articles_of_the_shipped_pages(spark, sf):
    small_dir = f"/root/testdata/{sf}"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    rows = QUERIES["op3_html_template"](spark, small_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content has-sidebar'><p>Text</p></div>", "<div id=page class=no-sidebar><p>Text<div class=sidebar>x</div></div>",
        "<article class='post comments-open'><p>Text</p></article><p>More</p>", "<form><main class=search-page><p>Text</p></main></form><p>More</p>",
        "<main>Top<div class=has-sidebar><article><p>Text</p><div class=share>x</div></article></div></main>",
        "<main><article><p>Text</p></article><section id=comments><article><p>Long comment</p></article></section></main>",
    ],
)
def test_names_do_not_hide_the_article(page):
    kept = [t for _, skipped, t in html_template.blocks(f"<body><nav>Menu</nav>{page}</body>")[1] if not skipped]
    assert [t for t in kept if t not in ("More", "Top")] == ["Text"]
    assert "Text" in html_template.main_text(page, None)


def test_all_slots_of_the_article(spark):
    page = "<body><div class=top>{k} top</div><article><h1>T{k}</h1><div class=intro>I{k}</div><div class=body><p>{k} long text</p></div><p>E{k}</p></article></body>"
    rows = [(k, "http://slots.example/" if k < 5 else f"http://alone{k}.example/", page.format(k=k)) for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract(pages).collect()}
    assert got == {k: f"T{k}\nI{k}\n{k} long text\nE{k}" for k in range(6)}
    assert html_template.main_text(page.format(k=7), None) == "T7\nI7\n7 long text\nE7"


def test_occurrence_vectors_form_classes(spark):
    rows = [("h", k, f"<body><div class=a>x{k}</div><div class=b>same</div>{'<p>q</p>' * k}</body>") for k in range(1, 5)]
    tokens = html_template.equivalence_classes(spark.createDataFrame(rows, "host string, page long, html string")).where("kind = 'tag'")
    vectors = {r.token: (r.v1, r.v2, r.pages) for r in tokens.collect()}
    assert vectors["body"] == vectors["body/div.a"] == vectors["body/div.b"] != vectors["body/p"]


# op6


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=6), st.integers(0, 2))
def test_automaton_finds_the_nearest_term(word, terms, most):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    best = min(distance(word, t) for t in terms)
    found = toxicity.Trie([(t, 1.0) for t in terms]).near(word, most)
    assert (found and found[0]) == (best if best <= most else None)


def exchanging(a, b):
    """Edits from a to b, an exchange of neighbours among them, by the whole table."""
    d = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=3, max_size=12), min_size=1, max_size=8, unique=True), st.data())
def test_pieces_lose_no_misspelling(terms, data):
    word = list(data.draw(st.sampled_from(terms)))
    for edit, at in data.draw(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 11)), max_size=3)):
        at = min(at, len(word) - 1)
        if edit == 0:
            word.insert(at, "d")
        elif edit == 1 and len(word) > 1:
            word.pop(at)
        elif edit == 2:
            word[at] = "b"
        elif at:
            word[at - 1], word[at] = word[at], word[at - 1]
    word, weights = "".join(word), {t: 1.0 + k for k, t in enumerate(terms)}
    away = {t: exchanging(t, word) for t in terms}
    near = {t for t in terms if 0 < toxicity.edits_of(len(t)) >= away[t]}
    spellings = toxicity.Spellings(weights)
    assert spellings.near(word) == near
    want = max(((weights[t] * toxicity.EDITED[away[t]], -away[t]) for t in near), default=None)
    found = spellings.best(word)
    assert (found and (found[0], -found[1])) == want


def test_misspellings_of_short_and_of_both_ends():
    terms = [*toxicity.SEED_TERMS, *(t + "s" for t in toxicity.SEED_TERMS)]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 3.0)).prepare()
    edits = {w: lexicon.find(w)[1] for w in ("idot", "losr", "wurthlesz", "merons", "mroon", "you-idiot", "l'idiot,", "x/idioot")}
    assert edits == {"idot": 1, "losr": 1, "wurthlesz": 2, "merons": 1, "mroon": 1, "you-idiot": 0, "l'idiot,": 0, "x/idioot": 1}
    assert lexicon.find("worthless" + "x" * 100) is None and lexicon.find("") is None


def test_learned_terms_are_found_misspelled(spark):
    clean = [(f"gentle river {chr(97 + k % 26)}{chr(97 + k // 26)}morning walks", 0) for k in range(60)]
    toxic = [(f"what a grobulant creature number {k}", 1) for k in range(30)] + [("grobulant in a quotation", 0)]
    rows = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(clean + toxic)], "doc_id long, text string, label int")
    lexicon = toxicity.learn_lexicon(rows).prepare()
    assert lexicon.terms["grobulant"] > toxicity.LEAST_ODDS and "gentle" not in lexicon.terms
    exact, edited = lexicon.find("grobulant"), toxicity.Lexicon(lexicon.terms, {}, lexicon.ordinary, lexicon.edited).prepare().find("grubulnat")
    assert exact[1] == 0 and edited[1] == 2 and exact[0] > edited[0] > 0


def test_coefficients_of_parted_rows():
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(400, 3)))
    y = (np.arange(400) % 10 == 0).astype(float)
    x[:, 0] += 8 * y
    beta = toxicity.fit_logistic(x, y, np.ones(400))
    assert auc(y, x @ beta[:-1] + beta[-1]) == 1.0


def test_context_of_finds():
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.SEED_TERMS, 3.0), {"zorg": 2.0}, frozenset({"closer"})).prepare()
    assert lexicon.find("idi0t!") == (3.0, 0) and lexicon.find("stupiid")[1] == 1 and lexicon.find("zorgling") == (2.0, 0)
    assert lexicon.find("closer") is None and lexicon.find("harmless") is None
    direct, quoted, plain = (toxicity.features(t, lexicon) for t in ("you idiot", 'he said "idiot" again', "an idiot"))
    assert direct[0] > plain[0] > quoted[0] and quoted[1] > 0 == plain[1]
    assert toxicity.features("", lexicon) == [0.0] * toxicity.FEATURES


def folds(rows, folds, fold):
    return {r.doc_id for r in rows if r.doc_id is not None and crc32(str(r.doc_id).encode()) % folds == fold}


# the smaller tables have too few toxic rows in three of the four languages to learn their terms
CLASSIFIERS = [("op6_toxicity", "toxic", 4, 2, 0.3, "sf0.1"), ("op8_quality_rules", "quality", 3, 1, 0.5, "sf0.01")]


@pytest.mark.parametrize("name, label, n, fold, threshold, size", CLASSIFIERS)
def test_classifiers_on_held_out_rows(spark, name, label, n, fold, threshold, size):
    sf_dir = f"/root/testdata/{size}"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf_dir).collect()
    assert {r.doc_id for r in rows if r.held_out} == folds(rows, n, fold)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    known = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    y, score = np.array(known).T
    assert auc(y, score) > 0.9
    again = {r.doc_id: r.score for r in QUERIES[name](spark, sf_dir).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-6) for r in rows)


def test_classifiers_of_odd_rows(odd_documents, no_documents, odd_labels):
    for classify in (quality_rules.classify, toxicity.score_documents):
        rows = classify(odd_documents, odd_labels).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_documents.select("doc_id").collect())
        assert all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
        assert classify(odd_documents, odd_labels.where("false")).count() == len(rows)
        assert classify(no_documents, odd_labels).count() == 0
    kept = quality_rules.accepted(odd_documents, odd_labels)
    assert kept.columns == odd_documents.columns


# op8


def test_rules_of_a_printed_forest():
    text = "x\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 0 > 1.5)\n      Predict: 0.0\n     Else (feature 0 <= 1.5)\n      Predict: 1.0\n    Else (feature 2 > 0.5)\n     Predict: 1.0\n"
    a, b = quality_rules.STATISTICS[2], quality_rules.STATISTICS[0]
    assert set(quality_rules.tree_rules(text)) == {
        ((a, False, 0.5),), ((a, True, 0.5),), tuple(sorted([(a, False, 0.5), (b, True, 1.5)])), tuple(sorted([(a, False, 0.5), (b, False, 1.5)])),
    }


# op7


def brute_top(rows, k):
    good = [(i, np.floor(np.array(v, float) * 256)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for i, q in good:
        if i % 50 == 0:
            scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(q, v))), j) for j, v in good if j != i)[:k]
            for rank, (s, j) in enumerate(scored, 1):
                out[(i, rank, j, -s)] += 1
    return out


def test_top_scores_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK_ROWS", 60)
    monkeypatch.setattr(cover_tree, "GROUP_ROWS", 3)
    monkeypatch.setattr(cover_tree, "LEAF", 8)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=6) + (i % 4)]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(150)] + [(2000, None), (2050, []), (2100, [1.0, None]), (2150, [float("nan")] * 6), (None, [1.0] * 6), (2201, [float("inf")] * 6)]
    rows += [(3000, [2.0, -1.0]), (3001, [2.0] * 8), (3002, [1.0] * 6), (3002, [1.0] * 6)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(tuple(x) for x in cover_tree.top_scores(data).collect())
    assert got == brute_top(rows, 5)
    assert cover_tree.top_scores(data.where("false")).count() == 0
    few = data.where("vec_id in (0, 1, 2)")
    assert Counter(tuple(x) for x in cover_tree.top_scores(few).collect()) == brute_top(rows[:3], 5)


def test_cover_trees_cover():
    points = np.random.default_rng(1).normal(size=(600, 3))
    tree = cover_tree.CoverTree(points)
    assert sorted(tree.order) == list(range(600))
    for node in range(len(tree.start)):
        own = tree.order[tree.start[node] : tree.stop[node]]
        assert np.linalg.norm(points[own] - points[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-12
        for child in tree.children[node]:
            assert tree.start[node] <= tree.start[child] < tree.stop[child] <= tree.stop[node]


def test_products_beyond_doubles_are_exact():
    a = np.array([[2.0**40, 3.0]])
    assert cover_tree.exact_products(a, np.array([[2.0**20, 1.0]]))[0, 0] == 2**60 + 3
    assert cover_tree.exact_products(a, np.array([[2.0**30, 1.0], [-(2.0**30), 0]]))[0].tolist() == [2**63 - 1, -(2**63 - 1)]


# pipeline


def test_stages_of_the_pipeline(spark, odd_documents, no_documents, small_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    for start in (docs, odd_documents, no_documents):
        rows = start
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, rows, small_dir)
            assert name == "packing" or made.columns == rows.columns
            rows = made
        assert rows.count() > 0 or start is no_documents
    assert corpus_pipeline.run(spark, small_dir).count() > 0
