"""Quality classification by a sparse ensemble of rules.

Statistics of a text are built-in column expressions. A forest of shallow trees is grown on labelled rows;
every path from a root to a node is a conjunctive rule over the statistics. A lasso logistic regression
keeps few rules with weights, and the model is compiled into one Spark column expression.
"""

import re
from dataclasses import dataclass
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from halocline.llm.common import WORD, stored

#: Labelled rows that are fitted, at most about; chosen by a hash of the id.
FIT_ROWS = 20_000
TREES, DEPTH = 24, 4


def _share(pattern, per):
    return F.regexp_count("_text", F.lit(pattern)) / F.greatest(per, F.lit(1))


def statistics(text):
    """Named statistics of a text column, all doubles; null counts as the empty text.

    Returns two lists for two successive selects: the pieces, and the statistics over them.
    """
    pieces = [
        F.coalesce(text, F.lit("")).alias("_text"),
    ]
    counted = {
        "_chars": F.char_length("_text"),
        "_words": F.regexp_count("_text", F.lit(WORD)),
        "_tokens": F.split("_text", "[ \n]"),
        "_lines": F.split("_text", "\n"),
    }
    chars, words = F.col("_chars"), F.col("_words")
    shares = {
        "length": F.log1p(words.cast("double")),
        "word_length": chars / F.greatest(words, F.lit(1)),
        "upper": _share(r"\p{Lu}", chars),
        "letters": _share(r"\p{L}", chars),
        "digits": _share(r"\p{Nd}", chars),
        "marks": _share(r"[#$%&*!|<>{}\[\]\\^~=_+@]", words),
        "stops": _share(r"[.?]", words),
        "commas": _share(",", words),
        "distinct_words": F.size(F.array_distinct("_tokens")) / F.greatest(F.size("_tokens"), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1)),
        "line_words": words / F.greatest(F.size("_lines"), F.lit(1)),
        "title_words": _share(r"(?<!\S)\p{Lu}", words),
    }
    return pieces, counted, {k: c.cast("double") for k, c in shares.items()}


STATISTICS = (
    "length", "word_length", "upper", "letters", "digits", "marks", "stops", "commas",
    "distinct_words", "distinct_lines", "line_words", "title_words",
)


def with_statistics(df, keep, text="text"):
    """The columns ``keep`` and a struct ``stats`` of all statistics."""
    pieces, counted, shares = statistics(F.col(text))
    return (
        df.select(*keep, *pieces)
        .select("*", *[c.alias(k) for k, c in counted.items()])
        .select(*keep, F.struct(*[shares[k].alias(k) for k in STATISTICS]).alias("stats"))
    )


@dataclass(frozen=True)
class RuleModel:
    """Rules, each a tuple of (statistic, is_above, threshold), with weights."""

    intercept: float
    rules: tuple = ()

    def score(self, stats="stats"):
        """The probability of label 1 as a column over the statistics in the struct ``stats``."""
        terms = [f"CASE WHEN {_holds(r, stats)} THEN {w!r}D ELSE 0D END" for r, w in self.rules] or ["0D"]
        total = F.expr(f"aggregate(array({', '.join(terms)}), {self.intercept!r}D, (a, x) -> a + x)")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(conditions, stats):
    """A rule as SQL text."""
    return " AND ".join(f"{stats}.{name} {'>' if above else '<='} {threshold!r}D" for name, above, threshold in conditions)


def tree_rules(description):
    """All distinct root paths of the trees in a printed forest, as sorted conditions."""
    rules, path = set(), []
    for line in description.splitlines():
        found = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not found:
            continue
        depth = len(found[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (STATISTICS[int(found[3])], found[4] == ">", float(found[5]))))
        rules.add(tuple(sorted(c for _, c in path)))
    return sorted(rules)


def bounded_sample(rows, limit, seed=11):
    """About ``limit`` rows at most, by a hash of doc_id; all of them where there are fewer."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(limit / n * 1_000_000)))


def fit(labelled, seed=3):
    """A RuleModel from rows with ``stats`` and a numeric ``label``; others than 0 and 1 are left out.

    Rows of one label alone, or none, give a model without rules: the label's share, smoothed.
    """
    rows = labelled.where("label in (0, 1) and stats is not null")
    values = F.array(*[F.col(f"stats.{k}") for k in STATISTICS])
    rows = stored(
        rows.select("stats", F.col("label").cast("double").alias("label"), array_to_vector(values).alias("features")).coalesce(4),
        "quality-fit",
    )
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = n.get(1.0, 0), n.get(0.0, 0)
    if not ones or not zeros:
        return RuleModel(log((ones + 1) / (zeros + 1)))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7,
        minInstancesPerNode=5, seed=seed,
    ).fit(rows)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleModel(log((ones + 1) / (zeros + 1)))
    holds = F.expr("array(" + ", ".join(f"CAST({_holds(r, 'stats')} AS DOUBLE)" for r in rules) + ")")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=0.001, maxIter=100, standardization=False).fit(
        stored(rows.select("label", array_to_vector(holds).alias("features")), "quality-rules")
    )
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def held_out(fold, folds, column="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def classify(documents, labels):
    """doc_id, held_out, score and predicted for every row.

    Labels of ids whose crc32 leaves 1 modulo 3 are never read. Null and repeated ids are scored as any
    other; a null id is not held out, and is not learned from. Empty texts are scored by their statistics.
    """
    stats = stored(with_statistics(documents, ["doc_id"]), "quality")
    known = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out(1, 3) & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = bounded_sample(known, FIT_ROWS)
    model = fit(stats.join(known, "doc_id"))
    scored = stats.select("doc_id", held_out(1, 3).alias("held_out"), model.score().alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(documents, labels, threshold=0.5):
    """The rows of ``documents`` whose quality score reaches the threshold, all columns kept."""
    known = labels.select(F.col("doc_id"), F.col("quality").alias("label")).where(~held_out(1, 3) & F.col("label").isNotNull())
    known = bounded_sample(known, FIT_ROWS)
    texts = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    model = fit(with_statistics(texts, ["label"]))
    row = F.struct(*documents.columns).alias("_row")
    scored = with_statistics(documents.select(row, F.col("text").alias("text")), ["_row"])
    # the row number keeps the optimizer from putting each statistic's definition into every rule
    scored = scored.withColumn("_number", F.monotonically_increasing_id())
    return scored.where((model.score() >= threshold) & (F.col("_number") >= 0)).select("_row.*")
