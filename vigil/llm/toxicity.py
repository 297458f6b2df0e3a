"""Toxicity scores: a lexicon trie met by Levenshtein automata, and context windows around every hit.

Learning. Labelled rows (never the held-out fifth) give, for each word and each word beginning, how many toxic and
other documents have it. The lexicon is the words, and the beginnings with many different endings, that toxic documents
have and others hardly do. At most FIT_ROWS labelled rows are looked at (those of the smallest hash of doc_id), which
bounds the work of learning and what reaches the driver; the lexicon has at most LEXICON entries.

Matching. The lexicon is a trie. A word runs through it together with its Levenshtein automaton (its states are
letters read and edits made), so terms with one letter wrong, missing, extra, or written as a look-alike digit or
sign are found without listing variants. Each distinct word is matched once per worker.

Scoring. A hit counts by its term's weight of evidence. The window of CONTEXT words on either side tells abuse from
quotation: quotation marks around the hit, or words of reporting, make it a quoted hit; other hits nearby make it
stronger. Sums of these are the features of a logistic regression fitted to the same labelled rows. Scores of all
documents are independent of each other, so nothing is shuffled, and only texts are looked at.

Null and empty texts have no hits and get the score of a document without hits. Repeated rows repeat their score. Without any
labelled row (or without both labels) the lexicon is empty and every score is the share of toxic rows, or 0. Labels that
contradict each other count as toxic. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import inverted, materialise, trim

FIT_ROWS = 12_000
LEXICON = 2_000
CONTEXT = 8
#: Distinct words that a worker remembers before it starts afresh.
SEEN_WORDS = 400_000
#: Words of reporting, and marks of quotation.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes cited term word reported alleged sagte schrieb wort zitat dijo palabra cita dit mot citation".split())
QUOTES = "\"“”„«»‘’"
#: Digits and signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
_LETTERS = "[^\\p{L}]+"
FEATURES = 5
SCHEMA = "doc_id long, held_out boolean, label int, features array<double>"


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


class Lexicon:
    """Terms with weights; stems match any word that begins so."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.weights = [w for _, _, w in terms]
        self.trie: dict = {}
        self.heads, self.tails = set(), set()
        for i, (term, stem, _) in enumerate(terms):
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((i, stem, self.edits(term)))
            self.heads.add(term[:2])
            self.tails.add(term[2:4])

    @staticmethod
    def edits(term: str) -> int:
        return int(len(term) >= 5)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best match of a word: fewest edits, then the greatest weight."""
        heads, tails = self.heads, self.tails
        if not (word[:2] in heads or word[1:3] in tails or word[2:4] in tails or word[3:5] in tails or word[:1] + word[2:3] in heads):
            return None
        n, best = len(word), None
        states = [(self.trie, 0, 0)]  # of the automaton: trie node, letters read, edits made
        while states:
            node, j, edits = states.pop()
            for i, stem, most in node.get("", ()):
                d = edits if stem else edits + n - j
                if d <= most and (best is None or (d, -self.weights[i]) < (best[1], -self.weights[best[0]])):
                    best = (i, d)
            if j < n and (below := node.get(word[j])):
                states.append((below, j + 1, edits))
            if not edits:
                if j < n:
                    states.append((node, j + 1, 1))
                for c, below in node.items():
                    if c:
                        states.append((below, j, 1))
                        if j < n and c != word[j]:
                            states.append((below, j + 1, 1))
                        if j + 1 < n and c == word[j + 1] and (swapped := below.get(word[j])):
                            states.append((swapped, j + 2, 1))
        return best


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.seen: set[str] = set()
        self.hot: dict[str, tuple[int, int]] = {}

    def _learn(self, token: str) -> None:
        if token.isalpha():
            if found := self.lexicon.match(token):
                self.hot[token] = found
            return
        bare = token.strip(".,;:!?()[]{}<>|*#&%$-_/\\'" + QUOTES)
        for form in dict.fromkeys((bare, bare.translate(LOOKALIKES), *(token.replace("-", " ").replace("/", " ").split() if "-" in bare or "/" in bare else ()))):
            if len(form) >= 4 and (found := self.lexicon.match(form)):
                edits = found[1] if form == bare else max(1, found[1])
                if token not in self.hot or edits < self.hot[token][1]:
                    self.hot[token] = (found[0], edits)

    def features(self, text: str | None) -> list[float]:
        """Evidence of exact hits, of misspelled ones, of quoted ones; the densest window; hits per word."""
        words = (text or "").lower().split()
        distinct = set(words)
        new = distinct - self.seen
        if new:
            if len(self.seen) + len(new) > SEEN_WORDS:
                self.seen, self.hot, new = set(), {}, distinct
            for w in new:
                self._learn(w)
            self.seen |= new
        if distinct.isdisjoint(self.hot):
            return [0.0] * FEATURES
        at = [i for i, w in enumerate(words) if w in self.hot]
        exact = misspelled = quoted = densest = 0.0
        for k, i in enumerate(at):
            term, edits = self.hot[words[i]]
            weight = self.lexicon.weights[term]
            around = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
            marks = sum(w[0] in QUOTES or w[-1] in QUOTES for w in words[max(0, i - 3) : i + 4])
            near = sum(abs(j - i) <= CONTEXT for j in at[max(0, k - CONTEXT) : k + CONTEXT + 1])
            if (marks >= 2 or not REPORTING.isdisjoint(around)) and near < 3:
                quoted += weight
            elif edits:
                misspelled += weight
            else:
                exact += weight
            densest = max(densest, near)
        return [math.log1p(exact), math.log1p(misspelled), math.log1p(quoted), densest, len(at) / len(words)]


def learn_lexicon(labelled: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, whether any ending may follow, weight) from rows with text and label."""
    words = labelled.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), _LETTERS))).alias("word")).where("length(word) BETWEEN 3 AND 30")
    stats = words.groupBy("word").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    n = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not n.get(1) or not n.get(0):
        return []
    odds = lambda bad, good: F.log(((bad + 0.5) / (n[1] + 1)) / ((good + 0.5) / (n[0] + 1)))
    least = max(4, n[1] // 60)
    top = stats.withColumn("w", odds(F.col("bad"), F.col("good"))).where(f"bad >= {least} AND w > 2.5").orderBy(F.desc("bad"), "word").limit(LEXICON).collect()
    starts = (
        stats.where("length(word) >= 4")
        .select("bad", "good", F.explode(F.expr("transform(sequence(4, least(8, length(word))), k -> substr(word, 1, k))")).alias("stem"))
        .groupBy("stem")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count_if(F.expr("bad > 0 AND good = 0")).alias("endings"))
        .withColumn("w", odds(F.least(F.col("bad"), F.lit(n[1])), F.col("good")))
        .where(f"bad >= {2 * least} AND endings >= 6 AND w > 2.5 AND good * 50 <= bad")
        .orderBy(F.desc("bad"), "stem")
        .limit(LEXICON)
        .collect()
    )
    return choose_terms([(r.word, r.bad, r.w) for r in top], [(r.stem, r.bad, r.w) for r in starts])


def choose_terms(words: list[tuple[str, int, float]], starts: list[tuple[str, int, float]]) -> list[tuple[str, bool, float]]:
    """The longest beginnings that still cover what shorter ones do, and the words that begin otherwise."""
    bad = {s: b for s, b, _ in starts}
    kept: dict[str, float] = {}
    for s, b, w in sorted(starts, key=lambda x: (len(x[0]), x[0])):
        longer = [t for t in bad if len(t) == len(s) + 1 and t.startswith(s) and bad[t] >= 0.97 * b]
        if not longer and not any(s.startswith(t) for t in kept):
            kept[s] = w
    out = [(s, True, w) for s, w in kept.items()]
    out += [(t, False, w) for t, _, w in words if not any(t.startswith(s) for s in kept)]
    return sorted(sorted(out, key=lambda x: (-x[2], x[0]))[:LEXICON])  # by weight, should there be more


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of the features and, last, the bias, by Newton steps."""
    if not len(y):
        return np.array([0.0] * x.shape[1] + [-40.0])
    if y.min() == y.max():
        return np.array([0.0] * x.shape[1] + [40.0 if y[0] else -40.0])
    a = np.column_stack([x, np.ones(len(y))])
    w, penalty = np.zeros(a.shape[1]), np.array([ridge] * x.shape[1] + [ridge / 10]) * len(y) / 100
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip((a * w).sum(axis=1), -35, 35)))
        slope = (a * (y - p)[:, None]).sum(axis=0) - penalty * w
        curve = np.einsum("ni,nj->ij", a * (p * (1 - p))[:, None], a) + np.diag(penalty + 1e-9)
        step = (inverted(curve) * slope).sum(axis=1)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _with_features(docs: DataFrame, terms: list[tuple[str, bool, float]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(Lexicon(shared.value))
        for b in batches:
            f = pa.array([m.features(t.as_py()) for t in b.column(3)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], f], ["doc_id", "held_out", "label", "features"])
        del m
        trim()

    return docs.select("doc_id", "held_out", "label", "text").mapInArrow(run, SCHEMA)


class ToxicityModel:
    def __init__(self, terms: list[tuple[str, bool, float]], weights: np.ndarray):
        self.terms, self.weights = terms, weights

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out, score, predicted of each document."""
        rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.lit(None).cast("int").alias("label"), F.col("text").cast("string"))
        z = F.lit(float(self.weights[-1]))
        for i, w in enumerate(self.weights[:-1]):
            z = z + F.lit(float(w)) * F.col("features")[i]
        scored = _with_features(rows, self.terms).withColumn("score", 1 / (1 + F.exp(-z)))
        return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

    def drop_toxic(self, docs: DataFrame) -> DataFrame:
        """docs, all columns, without the rows that score 0.5 or more; only texts go to Python, and only scores come back."""
        shared = docs.sparkSession.sparkContext.broadcast((self.terms, self.weights))

        @F.arrow_udf("double")
        def evidence(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            terms, w = shared.value
            m = Matcher(Lexicon(terms))
            for t in texts:
                x = np.array([m.features(v.as_py()) for v in t]).reshape(-1, FEATURES)
                yield pa.array((x * w[:-1]).sum(axis=1) + w[-1])
            del m
            trim()

        return docs.where(evidence(F.col("text").cast("string")) < 0)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from the labelled rows outside the held-out fifth."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    rows = materialise(rows.select("doc_id", F.lit(False).alias("held_out"), "label", "text").dropDuplicates(["label", "text"]))  # copies are no further evidence
    terms = learn_lexicon(rows)
    got = _with_features(rows, terms).select("label", "features").limit(2 * fit_rows).collect()
    x = np.array([r.features for r in got], dtype=float).reshape(len(got), FEATURES)
    return ToxicityModel(terms, fit_logistic(x, np.array([r.label for r in got], dtype=float)))
