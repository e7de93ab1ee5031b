import random

import pytest

#: Columns of the table, then columns whose names operators use within.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size int, score string, row string, "
    "kept string, piece string, stats string, target string, bands string, t1 string, k1 string, k2 string, "
    "_id string, label string, copies string, found string, print string, next string, n_bytes string"
)


def words(seed, n):
    """Text of n words in lines, distinct for each seed."""
    r = random.Random(seed)
    out = [("".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 8)))) for _ in range(n)]
    return "\n".join(" ".join(out[k : k + 12]) for k in range(0, n, 12))


def odd_texts():
    """(doc_id, text, source) with nulls, empty and long texts, copies, near copies and repeated rows."""
    base, long = words(1, 120), words(2, 6000)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "a"), (2, base, "a"), (3, near, "b"), (4, None, "a"), (5, "", "b"), (6, " \n ", None),
        (7, long, "a"), (8, "x" * 3000, "c"), (9, words(3, 90) + "\n" + base[:500], "b"), (10, words(4, 90) + "\n" + base[:500], "c"),
        (11, "ünïcödé ß é中文 \U0001f600 the MIT License", "b"), (12, "one", "c"), (None, words(5, 50), "a"),
        (None, None, None), (13, words(6, 40), None), (13, words(6, 40), None), (14, "Idiot you IDIOT\nidi0t!", "a"),
    ]
    rows += [(20 + k, words(100 + k, 30 + k), "abc"[k % 3]) for k in range(24)]
    return rows


@pytest.fixture(scope="session")
def odd_documents(spark):
    extra = len(SCHEMA.split(",")) - 5
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *[None] * extra) for i, t, s in odd_texts()], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(20 + k, k % 2, (k + 1) % 2) for k in range(24)] + [(None, 1, 1), (14, None, 1), (999, 0, 0), (1, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_benchmark(spark):
    return spark.createDataFrame([(1, words(1, 40)), (2, None), (3, "the MIT License ünïcödé")], "item_id long, text string")
