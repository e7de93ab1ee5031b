"""Toxicity by a lexicon trie met with Levenshtein automata, and the context of every find.

The lexicon has seed terms and terms learned from labelled rows: words and word beginnings ("stems") that
toxic rows hold far more often than others. A word of a text is looked up exactly, by its stem, and else
by an automaton that runs down tries of all terms of five letters or more: one edit away from a term of
five to seven letters, two from a longer one; an edit inserts, deletes or replaces a letter or exchanges two
neighbours. So few edits always leave a piece of the term intact, so only the tries of terms that share a
piece with the word are searched, and nothing is lost. A misspelling weighs less the more ordinary words are
as near to the term, and ordinary words of the learned rows are no misspellings. Finds inside quotation marks or beside words of reporting weigh less,
and those beside the second person weigh more. A logistic regression over the finds of a text gives the score.
"""

import re
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from halocline.llm.common import stored
from halocline.llm.quality_rules import bounded_sample, held_out

SEED_TERMS = (
    "idiot", "moron", "stupid", "loser", "worthless", "pathetic", "disgusting", "scum", "trash", "imbecile",
    "dumbass", "retard", "bastard", "bitch", "asshole", "freak", "vermin", "parasite", "degenerate", "cretin",
)
SEED_WEIGHT = 3.0
#: Labelled rows of either label that are learned from, at most about; the lexicon has only terms of these rows.
FIT_ROWS = 15_000
STEMS = (3, 4, 5, 6, 7)
#: A term must be in so many toxic rows, and its log-odds exceed zero by so many standard errors.
LEAST_ROWS, LEAST_Z, LEAST_ODDS = 3, 3.5, 1.5
#: Least letters of a term for one edit and for two, and the weight of a find by its edits.
ONE_EDIT, TWO_EDITS = 5, 8
EDITED = (1.0, 0.8, 0.6)
LETTERS = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
WINDOW = 5
QUOTING = frozenset("said says say called calls quote quoted quotes wrote writes term word words phrase report reported".split())
ADDRESS = frozenset("you your yours youre yourself u ur".split())
LOOKALIKES = str.maketrans("013457@$!", "oleastasi")
EDGES = ".,;:!?\"'()[]{}<>*_~`#%&|-+=/\\“”„«»‘’…"
QUOTES = "\"“”„«»"
REMEMBERED = 400_000
FEATURES = 6


class Trie:
    """Terms by letters; ``reached`` runs a Levenshtein automaton of a word over it.

    ``terms`` are (letters, weight) or (letters, weight, whole term).
    """

    def __init__(self, terms):
        self.root = {}
        for term, weight, *whole in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (max(weight, node.get("", (0.0,))[0]), whole[0] if whole else term)

    def reached(self, word, most, terms=None, swaps=True):
        """The largest weight of the terms at distance 0, 1 and 2 (at most ``most``) of the word; 0 for none.

        The terms themselves are added to ``terms``; with ``swaps`` an exchange of neighbours is one edit.

        State e of the automaton has bit p set if p letters of the word can be read with e edits.
        """
        n, masks = len(word), {}
        for p, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << p
        full = (1 << (n + 1)) - 1
        ones, twos = full if most > 0 else 0, full if most > 1 else 0
        found = [0.0, 0.0, 0.0]
        # a node, its states, and the states and the mask of the letter before, for exchanged neighbours
        stack = [(self.root, 1, 3 & ones, 7 & twos, 0, 0, 0)]
        while stack:
            node, s0, s1, s2, t0, t1, before = stack.pop()
            for c, child in node.items():
                if c == "":
                    for e, s in enumerate((s0, s1, s2)):
                        if s >> n & 1:
                            found[e] = max(found[e], child[0])
                            if terms is not None:
                                terms.add(child[1])
                            break
                    continue
                mask = masks.get(c, 0)
                # the term's letter is extra, is read for another, or a letter of the word is skipped
                x0 = (s0 & mask) << 1
                x1 = ((s1 & mask) << 1 | s0 | s0 << 1 | x0 << 1 | ((t0 & mask) << 1 & before) << 1) & ones
                x2 = ((s2 & mask) << 1 | s1 | s1 << 1 | x1 << 1 | ((t1 & mask) << 1 & before) << 1) & twos
                if x0 or x1 or x2:
                    stack.append((child, x0, x1, x2, s0, s1, mask) if swaps else (child, x0, x1, x2, 0, 0, 0))
        return found

    def near(self, word, most):
        """(Levenshtein distance, weight) of the best term within ``most`` edits of the word, or None."""
        found = self.reached(word, most, swaps=False)
        return next(((e, w) for e, w in enumerate(found) if w), None)


def edits_of(letters):
    """Edits that a misspelling of a term of so many letters may have."""
    return 0 if letters < ONE_EDIT else 1 if letters < TWO_EDITS else 2


def pieces(letters):
    """(start, length) of the pieces of a term, one more than its edits and one letter apart.

    An edit, also an exchange of neighbours, breaks one piece at most, so one stays intact.
    """
    count = edits_of(letters) + 1
    size, rest = divmod(letters - count + 1, count)
    out, at = [], 0
    for k in range(count):
        out.append((at, size + (k < rest)))
        at += out[-1][1] + 1
    return out


def odd_letters(word):
    """The letters that a word has an odd number of times, as bits; an edit changes two at most."""
    bits = 0
    for c in word:
        bits ^= 1 << (ord(c) & 63)
    return bits


class Spellings:
    """Tries of the terms that have a piece in common, by number of letters, piece and its letters."""

    def __init__(self, terms):
        groups = {}
        for term, weight in terms.items():
            m = len(term)
            if edits_of(m):
                for k, (at, size) in enumerate(pieces(m)):
                    groups.setdefault((m, k, term[at : at + size]), []).append((term, weight))
        self.tries = {}
        for (m, k, piece), group in groups.items():
            at, size = pieces(m)[k]
            # what stands before a last piece, and after a first one, is all that can differ
            cut = slice(size, None) if k == 0 else slice(0, at) if at + size == m else slice(None)
            trie = Trie((t[cut], w, t) for t, w in group)
            self.tries.setdefault((m, k), {})[piece] = (trie, [odd_letters(t) for t, _ in group])
        self.lengths, self.places = sorted({m for m, _ in self.tries}), {}

    def _places(self, n):
        """(tries by piece, edits, start, end, rest to compare) where words of n letters may have an intact piece."""
        out = []
        for m in self.lengths:
            most, cut = edits_of(m), pieces(m)
            if abs(m - n) > most:
                continue
            for k, (at, size) in enumerate(cut):
                # the first piece stays in its place, the last one stays at the end, and the middle one is
                # needed only if there is one edit on either side
                shifts = (0,) if k == 0 else (n - m,) if k == len(cut) - 1 else (-1, 0, 1)
                for start, end in ((at + d, at + d + size) for d in shifts):
                    if end <= n:
                        rest = slice(end, None) if k == 0 else slice(0, start) if k == len(cut) - 1 else slice(None)
                        out.append((self.tries[m, k], most, start, end, rest))
        self.places[n] = out
        return out

    def best(self, word):
        """(weight by edits, edits) of the term that the word most likely stands for, or None."""
        best = None
        for trie, most, rest in self._near_tries(word):
            for e, weight in enumerate(trie.reached(rest, most)):
                if weight and (best is None or (weight * EDITED[e], -e) > (best[0], -best[1])):
                    best = (weight * EDITED[e], e)
        return best

    def near(self, word):
        """All terms that the word may stand for."""
        terms = set()
        for trie, most, rest in self._near_tries(word):
            trie.reached(rest, most, terms)
        return terms

    def _near_tries(self, word):
        """(trie, edits, rest of the word) of the terms that share a piece with the word, if one of them has letters so near."""
        found, odd = [], None
        for tries, most, start, end, rest in self.places.get(len(word)) or self._places(len(word)):
            group = tries.get(word[start:end])
            if group:
                if odd is None:
                    odd = odd_letters(word)
                for other in group[1]:
                    if (odd ^ other).bit_count() <= 2 * most:
                        found.append((group[0], most, word[rest]))
                        break
        return found


#: The lexicon that a worker has prepared, kept from task to task.
_prepared = {}


@dataclass
class Lexicon:
    """Terms and stems with weights, and ordinary words that no misspelling stands for.

    ``edited`` has the weights of misspelled terms, by default those of the terms.
    """

    terms: dict
    stems: dict = field(default_factory=dict)
    ordinary: frozenset = frozenset()
    edited: dict | None = None
    key: str = field(default_factory=lambda: uuid4().hex)

    def prepare(self):
        """The lexicon ready to search, with the words that this worker has met so far."""
        if self.key not in _prepared:
            _prepared.clear()
            _prepared[self.key] = self._build()
        return _prepared[self.key]

    def _build(self):
        self.spellings = Spellings(self.terms if self.edited is None else self.edited)
        self.seen, self.before = {}, {}
        return self

    def _stem(self, word):
        return max((self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k), default=0.0)

    def fuzzy(self, word):
        return None if len(word) < ONE_EDIT - 1 or word in self.ordinary else self.spellings.best(word)

    def word(self, word):
        """(weight, edits) of a word, edits 0 for the term itself and for stems; None if it is none."""
        weight = self.terms.get(word) or self._stem(word)
        if weight:
            return weight, 0
        plain = word if word.isalpha() else word.translate(LOOKALIKES)
        return (self.terms[plain], 0) if plain in self.terms else self.fuzzy(plain)

    def find(self, token):
        """The heaviest find of a token without its edges, or of the runs of letters in it."""
        if token in self.before:
            found = self.seen[token] = self.before[token]
            return found
        whole = token.strip(EDGES)
        if whole != token:
            found = self.seen[token] = self.seen[whole] if whole in self.seen else self.find(whole)
            return found
        found = self.word(whole)
        if not found and not whole.isalpha():
            runs = [f for f in map(self.word, LETTERS.findall(whole)) if f]
            found = max(runs, key=lambda f: (f[0], -f[1]), default=None)
        self.seen[token] = found
        return found

    def forget(self):
        """Let go of words not met lately, once there are many."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.before = {}, self.seen


def features(text, lexicon):
    """Sums over the finds of a text: direct, quoted, edited, largest, number, and finds per 100 words.

    All but quoted and largest keep edited finds apart, which are the less sure ones.
    """
    tokens = text.lower().split()
    lexicon.forget()
    find, seen = lexicon.find, lexicon.seen
    hits = [(i, f) for i, f in ((i, seen[t] if t in seen else find(t)) for i, t in enumerate(tokens)) if f]
    out = [0.0] * FEATURES
    if not hits:
        return out
    # a token inside quotation marks has an odd number of them before its end, or carries both itself
    quotes, exact = None, 0
    for i, (weight, edits) in hits:
        near = [t.strip(EDGES) for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]]
        if quotes is None:
            quotes = np.cumsum([0] + [sum(t.count(q) for q in QUOTES) for t in tokens])
        inside = quotes[i] % 2 == 1 or quotes[i + 1] - quotes[i] >= 2
        if inside or not QUOTING.isdisjoint(near):
            out[1] += weight
            weight *= 0.3
        elif not ADDRESS.isdisjoint(near):
            weight *= 1.3
        out[2 if edits else 0] += weight
        out[3] = max(out[3], weight)
        exact += not edits
    out[0], out[1], out[2] = np.log1p(out[0]), np.log1p(out[1]), np.log1p(out[2])
    out[4] = float(np.log1p(exact))
    out[5] = 100.0 * exact / len(tokens)
    return [float(x) for x in out]


def learn_lexicon(rows):
    """Terms and stems from rows with ``text`` and ``label``; counts are of rows, over all rows given.

    A misspelled term weighs less the more ordinary words are as near to it: its weight is pooled, as if from one
    ordinary word, with the words near it, by their log-odds of being toxic against all words'. As for terms
    themselves, LEAST_ODDS or less is no evidence. The rows are a bounded sample, so its strong words and the
    ordinary words near them fit the driver.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{M}]{3,}"), F.lit(0)))
    def starts_of(size):
        return F.transform(
            F.filter("_words", lambda w: F.length(w) > size), lambda w: F.concat(F.substring(w, 1, size), F.lit("*"))
        )

    per_row = rows.select("label", words.alias("_words")).select(
        "label", F.explode(F.array_distinct(F.concat("_words", *[starts_of(k) for k in STEMS]))).alias("term")
    )
    counts = per_row.groupBy("term").agg(
        F.sum("label").cast("double").alias("n1"), F.sum(1 - F.col("label")).cast("double").alias("n0")
    )
    totals = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    ones, zeros = float(totals[0] or 0), float(totals[1] or 0)
    odds = F.log((F.col("n1") + 0.5) / F.lit(ones + 1)) - F.log((F.col("n0") + 0.5) / F.lit(zeros + 1))
    error = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    counts = stored(counts, "toxic-words")
    strong = (
        counts.withColumn("odds", odds)
        .withColumn("z", F.col("odds") / error)
        .where((F.col("n1") >= LEAST_ROWS) & (F.col("odds") > LEAST_ODDS) & ((F.col("z") > LEAST_Z) | (F.col("n0") == 0) & (F.col("n1") >= 4)))
        .collect()
    )
    terms = dict.fromkeys([*SEED_TERMS, *(t + "s" for t in SEED_TERMS if t[-1] != "s")], SEED_WEIGHT)
    terms |= {r["term"]: float(r["odds"]) for r in strong if not r["term"].endswith("*")}
    stems = {r["term"][:-1]: float(r["odds"]) for r in strong if r["term"].endswith("*")}
    # a stem of one strong word alone is that word
    firsts = {}
    for t in terms:
        for k in STEMS:
            firsts[t[:k]] = firsts.get(t[:k], 0) + 1
    stems = {s: w for s, w in stems.items() if firsts.get(s, 0) != 1 and not any(t.startswith(s) for t in SEED_TERMS)}
    words = counts.where(~F.endswith("term", F.lit("*"))).select(
        F.col("term").alias("word"), (F.col("n0") * ones >= F.col("n1") * zeros).alias("ordinary")
    )
    lexicon = Lexicon(terms, stems)
    near = stored(words.mapInArrow(lambda batches: _near_words(batches, lexicon), "word string, ordinary boolean, term string"), "toxic-near")
    around = near.groupBy("term").agg(F.count_if("ordinary").alias("clean"), F.count_if(~F.col("ordinary")).alias("toxic"))
    base = words.agg(F.count_if(~F.col("ordinary")), F.count_if("ordinary")).first()
    base = (base[0] + 0.5) / (base[1] + 0.5)
    edited = dict(terms)
    for r in around.collect():
        weight = edited[r["term"]]
        pooled = np.log((np.exp(weight) * base + r["toxic"]) / (1 + r["clean"]) / base)
        edited[r["term"]] = min(weight, float(pooled))
    edited = {t: w for t, w in edited.items() if w > LEAST_ODDS}
    spared = near.where("ordinary").groupBy("word").agg(F.collect_list("term").alias("terms")).collect()
    spared = frozenset(r["word"] for r in spared if not edited.keys().isdisjoint(r["terms"]))
    return Lexicon(terms, stems, spared, edited)


def _near_words(batches, lexicon):
    """The terms near every word that is none itself."""
    lexicon = lexicon.prepare()
    for batch in batches:
        words, ordinary, terms = [], [], []
        for word, clean in zip(*[c.to_pylist() for c in batch.columns]):
            for term in () if word in lexicon.terms else lexicon.spellings.near(word):
                words.append(word)
                ordinary.append(clean)
                terms.append(term)
        columns = [pa.array(words, pa.string()), pa.array(ordinary, pa.bool_()), pa.array(terms, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "ordinary", "term"])


def with_features(df, keep, lexicon):
    """The columns ``keep`` and ``found``, the features of ``text``."""
    schema = df.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches):
        ready = lexicon.prepare()
        for batch in batches:
            found = [features(t or "", ready) for t in batch.column(len(keep)).to_pylist()]
            columns = [*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "found"])

    return df.select(*keep, "text").mapInArrow(run, f"{fields}, found array<double>")


def fit_logistic(x, y, weight, ridge=1e-2, steps=100):
    """Coefficients (intercept last) of a ridge logistic regression, by Newton's method with halved steps.

    Weights are taken as shares. Full steps may jump to and fro where the two kinds of rows are well parted.
    """
    x = np.column_stack([x, np.ones(len(x))])
    weight = weight / weight.mean()
    beta = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6

    def loss(beta):
        z = x @ beta
        return weight @ (np.logaddexp(0, z) - y * z) + beta @ penalty @ beta / 2

    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty @ beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        while (after := loss(beta + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if after >= now - 1e-9:
            break
        beta, now = beta + step, after
    return beta


def learn(documents, labels):
    """(lexicon, coefficients) from labelled rows: ``labels`` has doc_id and label 0 or 1."""
    known = labels.where("label in (0, 1) and doc_id is not null")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(known.where("label = 1"), FIT_ROWS).unionByName(bounded_sample(known.where("label = 0"), FIT_ROWS))
    rows = stored(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic-fit")
    # the score is fitted on rows that the lexicon has not seen, because chance terms fit only their own rows
    other = F.pmod(F.xxhash64(F.lit("score"), "doc_id"), F.lit(4)) == 0
    lexicon = learn_lexicon(rows.where(~other))
    found = with_features(rows.where(other), ["label"], lexicon).toPandas()
    y = found["label"].to_numpy(float)
    x = np.array(found["found"].tolist(), float).reshape(-1, FEATURES)
    if len(set(y)) < 2:
        return lexicon, np.array([1.0] + [0.0] * (FEATURES - 1) + [-2.0])
    # rows of either label stand for all of theirs
    weight = np.where(y == 1, sizes.get(1, 0) / max(1, (y == 1).sum()), sizes.get(0, 0) / max(1, (y == 0).sum()))
    return lexicon, fit_logistic(x, y, weight)


def score_column(coefficients, found="found"):
    total = F.lit(float(coefficients[-1]))
    for k in range(FEATURES):
        total = total + F.lit(float(coefficients[k])) * F.get(F.col(found), k)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score_documents(documents, labels):
    """doc_id, held_out, score and predicted for every row.

    Labels of ids whose crc32 leaves 2 modulo 4 are never read. A null text is empty; a text without finds
    has the score of the intercept. A null id is not held out, and is not learned from. Without labelled
    rows of both kinds the seed terms alone decide. Texts and words of any length are read whole. Repeated
    rows are scored each, alike; of terms as near as each other the heavier one counts. Only doc_id and text
    are read, so other columns may have any name. No rows give no rows.
    """
    known = labels.where(~held_out(2, 4)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    lexicon, coefficients = learn(documents, known)
    found = with_features(documents, ["doc_id"], lexicon)
    scored = found.select("doc_id", held_out(2, 4).alias("held_out"), score_column(coefficients).alias("score"))
    return scored.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))
