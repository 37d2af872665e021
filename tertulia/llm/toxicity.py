"""Toxicity from a learned lexicon: a Levenshtein automaton run over the
lexicon trie finds listed and misspelled terms, the words around a hit tell
quotation from abuse, and a logistic model turns the hits into a score.

The model is fitted on at most ``MAX_TRAIN`` labelled rows (a documented
bound; rows are chosen by a hash of the id).  One half of them gives the
lexicon: whole words and word stems (written ``stem*``) whose document counts
among toxic and other rows differ enough, ``MAX_LEXICON`` at most.  The other
half gives the weights of the logistic model.  Labels, language, source and id
are no inputs of a score; every text is scored whole.

Scale: fitting reads the documents once, joined with the bounded sample by a
broadcast; scoring is one pass without a shuffle.

Defined results: null and empty text has no hits and gets the score of the
intercept; an id with several labels counts as toxic if one of them says so;
null labels and null ids train nothing; without toxic or without other rows to
train on the lexicon is empty and the score is the share of toxic rows (0 if
there are none).  Repeated rows each get their row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 20_000
MAX_LEXICON = 4_000
MIN_TOXIC_DOCS = 4
MIN_LOG_ODDS = 2.5
STEM_CHARS = range(3, 9)
FAMILY_SHARE = 0.8
FUZZY_CHARS = 5
FUZZY_WEIGHT = 0.5
WINDOW = 8
FEATURES = ("abuse", "quoted", "terms", "strongest", "density")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]")
MARKS = frozenset("\"“”«»„")
#: Words that report what others say, in the languages of the corpus.
REPORTING = frozenset("said says wrote writes called calls quote quoted quoting word words term so-called "
                      "dit disait mot sagte sagt wort dijo dice palabra".split())


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0,) * len(FEATURES)
    intercept: float = -20.0


class Lexicon:
    """A trie of terms and stems, walked by a Levenshtein automaton."""

    def __init__(self, terms: dict[str, float]):
        self.trie: dict = {}
        self.heads, self.tails = set(), set()
        for term, weight in terms.items():
            word, stem = (term[:-1], True) if term.endswith("*") else (term, False)
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node["*" if stem else "$"] = weight
            if not stem and len(word) >= FUZZY_CHARS:
                half = len(word) // 2
                self.heads.add(word[:half])
                self.tails.add(word[half:])
        self.sizes = sorted({len(x) for x in self.heads | self.tails})
        self.known: dict[str, float] = {}

    def exact(self, word: str) -> float:
        node, best = self.trie, 0.0
        for c in word:
            best = max(best, node.get("*", 0.0))
            node = node.get(c)
            if node is None:
                return best
        return max(best, node.get("*", 0.0), node.get("$", 0.0))

    def fuzzy(self, word: str) -> float:
        """Best weight of a term at one edit: the automaton's states are
        (trie node, place in the word) with no edit used, each of which may
        use its edit here and must match the rest as it stands."""
        n, node, best = len(word), self.trie, 0.0

        def rest(at: dict | None, i: int, depth: int) -> float:
            while at is not None and i < n:
                at, i, depth = at.get(word[i]), i + 1, depth + 1
            return at.get("$", 0.0) if at is not None and depth >= FUZZY_CHARS else 0.0

        for i in range(n + 1):
            if i < n:
                best = max(best, rest(node, i + 1, i))
            for c, child in node.items():
                if c not in "*$":
                    best = max(best, rest(child, i, i + 1))
                    if i < n and c != word[i]:
                        best = max(best, rest(child, i + 1, i + 1))
            node = node.get(word[i]) if i < n else None
            if node is None:
                break
        return best

    def weight(self, word: str) -> float:
        if (w := self.known.get(word)) is None:
            w = self.exact(word)
            if not w and len(word) >= FUZZY_CHARS - 1 and any(
                    word[:k] in self.heads or word[-k:] in self.tails for k in self.sizes):
                w = FUZZY_WEIGHT * self.fuzzy(word)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = w
        return w


def features(text: str | None, lexicon: Lexicon) -> tuple[float, ...]:
    words = TOKEN.findall(text.lower()) if text else []
    hits = {w: x for w in set(words) if (x := lexicon.weight(w))}
    if not hits:
        return (0.0,) * len(FEATURES)
    abuse = quoted = 0.0
    for i, w in enumerate(words):
        if x := hits.get(w):
            before, after = words[max(0, i - WINDOW):i], words[i + 1:i + 1 + WINDOW]
            if not MARKS.isdisjoint(before) and not MARKS.isdisjoint(after) or not REPORTING.isdisjoint(before):
                quoted += x
            else:
                abuse += x
    return (math.log1p(abuse), math.log1p(quoted), math.log1p(len(hits)), max(hits.values()),
            100 * (abuse + quoted) / (len(words) + 50))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 modulo 5 (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(text, y, half): labelled rows that are not held out, ``max_train`` or so at most."""
    y = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")))
    n = y.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    if n > max_train:
        y = y.filter(place < int(1_000_000 * max_train / n))
    y = y.select("doc_id", "y", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("half"))
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("text", "y", "half")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        terms = list(set(counts[0]) | set(counts[1]))
        out = pa.record_batch([pa.array(terms, pa.string()), *(
            pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "n0", "n1"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
            words = {w for w in TOKEN.findall((text or "").lower()) if w not in MARKS}
            stems = {w[:k] + "*" for w in words for k in STEM_CHARS if k < len(w)}
            counts[y > 0].update(words)
            counts[y > 0].update(stems)
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield flush()
    yield flush()


def learn_lexicon(train: DataFrame, max_terms: int = MAX_LEXICON) -> dict[str, float]:
    n = {r["y"]: r["n"] for r in train.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    c = (train.select("text", "y").mapInArrow(_count_terms, "term string, n0 long, n1 long")
         .groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    best = (c.filter(F.col("n1") >= MIN_TOXIC_DOCS).select("term", "n1", odds.alias("w"))
            .filter(F.col("w") >= MIN_LOG_ODDS)
            .orderBy((F.col("n1") * F.col("w")).desc(), "term").limit(max_terms)).collect()
    # A stem stands for a family of words; one that a single word makes up goes.
    top: Counter = Counter()
    for r in best:
        if not r["term"].endswith("*"):
            for k in STEM_CHARS:
                stem = r["term"][:k] + "*"
                top[stem] = max(top[stem], r["n1"])
    return {r["term"]: r["w"] for r in best
            if not r["term"].endswith("*") or r["n1"] * FAMILY_SHARE > top[r["term"]]}


def _feature_column(text: Column, lexicon: dict[str, float]) -> Column:
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lex = Lexicon(lexicon)
        for texts in batches:
            yield pa.array([features(t, lex) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return run(text)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton steps of ridge logistic regression; the last weight is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(a.shape[1]), ridge * np.eye(a.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learn lexicon and weights from rows (doc_id, text) and (doc_id, toxic)."""
    train = training_rows(docs, labels, max_train)
    lexicon = learn_lexicon(train.filter("half"))
    rows = (train.filter(~F.col("half")).select("y", _feature_column(F.col("text"), lexicon).alias("x"))
            .groupBy("y", "x").agg(F.count("*").alias("n")).collect())
    y = np.repeat([float(r["y"] > 0) for r in rows], [r["n"] for r in rows])
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(lexicon, intercept=math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    x = np.repeat(np.array([r["x"] for r in rows]), [r["n"] for r in rows], axis=0)
    weights, intercept = fit_logistic(x, y)
    return Model(lexicon, tuple(float(w) for w in weights), intercept)


def score_column(text: Column, model: Model) -> Column:
    x = _feature_column(text, model.lexicon)

    def link(f: Column) -> Column:
        z = F.lit(model.intercept)
        for i, w in enumerate(model.weights):
            z = z + F.get(f, F.lit(i)) * w
        return 1.0 / (1.0 + F.exp(-z))

    return F.transform(F.array(x), link)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and ``score`` (an input column of that name is replaced)."""
    return docs.withColumn("score", score_column(F.col("text"), model))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    return docs.filter(score_column(F.col("text"), fit(docs, labels)) < threshold)
