"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are put in lower case and folded first: look-alike letters of other scripts and digits or signs
that stand for letters become those letters, one character for one. The lexicon holds words, weighted by
their log odds in labelled documents; exception phrases are two-word phrases around a lexicon word that
labelled clean documents use, and hits inside them don't count. The sum of the weights of all hits,
also as a share of the text's length, goes through a logistic curve fitted on labelled rows.

The lexicon, the exceptions and the curve are learned from at most ``FIT_ROWS`` labelled rows that aren't
held out, those with the smallest hashes; all words and phrases that stand out in them are kept. Defined results:
null and empty texts have no hits and score as such; without labels of both kinds every score is 0; repeated rows
are each scored; a document without an id isn't held out; labels of documents that don't exist, or null labels, are left out; of
several labels the largest counts; texts of any length are matched whole, in time that grows with the length
but for a sort of the hits; other columns aren't touched.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FIT_ROWS = 20_000
MIN_DOCS = 3
#: Letters and signs that look like or stand for Latin letters.
LOOKALIKES = {
    "a": "4@аα", "b": "8вβ", "c": "сϲ", "e": "3еεё", "g": "9", "h": "нһ", "i": "1!іι", "j": "ј", "k": "кκ", "m": "м", "n": "ո", "o": "0оο",
    "p": "рρ", "s": "5$ѕ", "t": "7тτ", "u": "υ", "v": "ν", "x": "хχ", "y": "уγ", "w": "ѡω", "z": "2ζ",
}
FOLD = {ord(x): letter for letter, signs in LOOKALIKES.items() for x in signs} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """The text in lower case with look-alikes and digits folded; signs fold only beside a letter."""
    if not text:
        return ""
    # A run of signs (as in "word!!" or "word$$$") is punctuation; a single one between letters is a letter.
    return re.sub(r"[!$@]+(?![a-z0-9])|(?<![^\W\d_])[!$@]+", " ", text.lower()).translate(FOLD)


def words(text: str | None) -> list[str]:
    return WORD.findall(fold(text))


def outside(hits: list[tuple], safe: list[tuple]) -> list[tuple]:
    """The hits (first, past, ...) that lie within no safe span, in order of their places: both lists are gone through once."""
    if not safe:
        return hits
    hits, safe = sorted(hits, key=lambda h: h[:2]), sorted(safe, key=lambda s: s[:2])
    out, reach, i = [], -1, 0
    for h in hits:
        while i < len(safe) and safe[i][0] <= h[0]:
            reach = max(reach, safe[i][1])
            i += 1
        if h[1] > reach:
            out.append(h)
    return out


class Matcher:
    """Finds lexicon words (whole words) outside exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: list[str]):
        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.automaton.add_word(term, (term, weight))
        for phrase in exceptions:
            self.automaton.add_word(phrase, (phrase, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def spans(self, text: str | None) -> tuple[list[tuple[int, int, str, float]], int]:
        """Hits (first, past, term, weight) and the number of words."""
        folded = fold(text)
        # Words stand apart by one space, so that phrases of several words match too.
        own = WORD.findall(folded)
        line = " " + " ".join(own) + " "
        hits, safe = [], []
        if len(self.automaton):
            for last, (term, weight) in self.automaton.iter(line):
                first = last - len(term) + 1
                if line[first - 1] == " " and line[last + 1] == " ":
                    (safe if weight is None else hits).append((first, last + 1, term, weight))
        return outside(hits, safe), len(own)


def measures(matcher: Matcher, text: str | None) -> tuple[float, float, int]:
    hits, n = matcher.spans(text)
    total = sum(h[3] for h in hits)
    return total, total / max(n, 1) ** 0.5, len(hits)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y) of labelled documents that aren't held out, stored. A document with several labels counts by the largest.

    At most ``bound`` labelled ids are drawn, those with the smallest hashes; so what is broadcast has that bound,
    and no text is shuffled.
    """
    marks = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    drawn = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return stored(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "y"), "training")


def counts(rows: DataFrame, terms: set[str] | None = None) -> DataFrame:
    """(term, toxic, clean): documents of each kind with a word, or, given ``terms``, with a two-word phrase that holds one."""

    def run(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush():
            keys = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "toxic": pa.array([seen[1][k] for k in keys], pa.int64()), "clean": pa.array([seen[0][k] for k in keys], pa.int64())})
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(text)
                if terms is not None:
                    own = [f"{a} {b}" for a, b in zip(own, own[1:]) if a in terms or b in terms]
                seen[int(y > 0)].update(set(own))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield flush()
        yield flush()

    return rows.select("text", "y").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton steps for a logistic curve with an intercept; the two labels weigh the same as they occur."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon, exceptions, weights):
        self.lexicon, self.exceptions, self.weights = lexicon, exceptions, weights
        self._matcher = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "exceptions": self.exceptions, "weights": self.weights, "_matcher": None}

    def scores(self, texts) -> np.ndarray:
        self._matcher = self._matcher or Matcher(self.lexicon, self.exceptions)
        if self.weights is None:
            return np.zeros(len(texts))
        x = shaped([measures(self._matcher, t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def shaped(rows) -> np.ndarray:
    x = np.array(rows, float).reshape(-1, 3)
    return np.log1p(x)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    rows = training_rows(docs, labels, label, FIT_ROWS)
    n = {bool(r.y): r.n for r in rows.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    if not (n.get(True) and n.get(False)):
        return Model({}, [], None)
    total = n[True] + n[False]
    odds = F.log((F.col("toxic") + 0.5) / (n[True] + 1)) - F.log((F.col("clean") + 0.5) / (n[False] + 1))
    # Words by chance: their surplus over the labels' share, in standard deviations.
    share = n[True] / total
    seen = F.col("toxic") + F.col("clean")
    surplus = (F.col("toxic") - seen * share) / F.sqrt(seen * share * (1 - share))
    terms = counts(rows).where((F.col("toxic") >= MIN_DOCS) & (odds > 2.5) & (surplus > 5)).select("term", odds.alias("w")).orderBy("term").collect()
    lexicon = {r.term: float(r.w) for r in terms}
    clean = counts(rows, set(lexicon)).where((F.col("clean") >= MIN_DOCS) & (odds < 0)).orderBy("term").collect() if lexicon else []
    exceptions = [r.term for r in clean]

    def measure(batches):
        own = Matcher(lexicon, exceptions)
        for batch in batches:
            m = [measures(own, t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([float(v[k]) for v in m]) for k in range(3)] + [batch.column(1).cast(pa.float64())], ["a", "b", "c", "y"])

    got = np.array(rows.select("text", F.col("y").cast("double")).mapInArrow(measure, "a double, b double, c double, y double").toPandas())
    return Model(lexicon, exceptions, logistic(shaped(got[:, :3]), (got[:, 3] > 0).astype(float)))


def score_column(model: Model, text: Column) -> Column:
    # The model travels with the function; it holds words and phrases that MIN_DOCS of at most FIT_ROWS texts have.

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()))

    return toxicity(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    score = score_column(fit(docs, labels), F.col("text"))
    scored = docs.select("doc_id", score.alias("score"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    return docs.where(score_column(fit(docs, labels), F.col("text")) < threshold)
