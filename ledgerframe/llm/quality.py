"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade > k) = 1 / (1 + exp(threshold_k - w . x)): all grades share one weight vector over hashed text
features, and thresholds ascend. The model gives each document its expected grade and the probability of a
grade above a cut, by which documents are selected. Features are hashed words, word shapes (case and
the signs around a word) and how much a text repeats itself.

Weights are fitted on at most ``FIT_ROWS`` rated rows that aren't held out, those with the smallest hashes.
Defined results: a null text is taken as an empty one, which has the prior's score; null ratings are left
out; if several ratings name a document, their largest counts; without two different grades every
document's expected grade is that grade (0 if none) and its tail probability 0; repeated rows are each scored; texts of any length
are read whole; documents that tie have equal scores, so a selection takes all of them or none; other columns
aren't touched; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .toxicity import training_rows, held_out

FIT_ROWS = 6_000
BITS = 16
EPOCHS = 12


class Hashed(dict):
    """Slots of a word and its shape, with a bound on what is remembered."""

    def __missing__(self, word: bytes):
        if len(self) > 200_000:
            self.clear()
        core = word.strip(b".,;:!?*#$%&|()[]{}\"'-_/")
        at = word.find(core) if core else 0
        sign = word[at + len(core) :][-3:] if core else word[:3]
        # Most words end in no sign or one of prose; longer runs and odd signs are what shapes tell apart.
        case = b"U" if len(core) > 1 and core.isupper() else b"T" if core[:1].isupper() else b"d" if core.isdigit() else b"l"
        mask = (1 << BITS) - 1
        self[word] = out = (xxhash.xxh64_intdigest(b"w" + core.lower(), 1) & mask, xxhash.xxh64_intdigest(b"s" + case + sign, 1) & mask)
        return out


def features(text: bytes | None, hashed: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): words count by the root of their share, shapes and repeats by their share."""
    own = (text or b"").split()
    n = len(own)
    if not n:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    pairs = np.array([hashed[w] for w in own])
    w, wc = np.unique(pairs[:, 0], return_counts=True)
    s, sc = np.unique(pairs[:, 1], return_counts=True)
    lines = (text or b"").split(b"\n")
    distinct = len(set(own)) / n ** 0.75
    extra = np.array([distinct, 1 - len(set(lines)) / len(lines), n / (n + 100)], np.float32)
    slots = np.concatenate([w, s, [(1 << BITS) + i for i in range(3)]]).astype(np.int32)
    return slots, np.concatenate([np.sqrt(wc / n) * 0.5, 3 * sc / n, 2 * extra]).astype(np.float32)


class Model:
    """Weights, ascending thresholds and the grades between them."""

    def __init__(self, weights, thresholds, grades):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def above(self, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        z = float(self.weights[slots] @ values) - self.thresholds
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, float]], ridge: float = 1e-5) -> Model:
    """Adam on the cumulative likelihood; thresholds are a first one plus exponentials of steps, so they ascend."""
    grades = np.unique([y for *_, y in rows]) if rows else np.zeros(1)
    k = len(grades) - 1
    size = (1 << BITS) + 3
    if k < 1:
        return Model(np.zeros(size, np.float32), np.empty(0), grades)
    y = np.searchsorted(grades, [r[2] for r in rows])
    share = np.clip([(y > i).mean() for i in range(k)], 1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(cuts), 1e-2))
    w, t0 = np.zeros(size), cuts[0]
    mean, var, turn = np.zeros(size + k), np.zeros(size + k), 0
    rng = np.random.default_rng(0)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), 64):
            own = order[b : b + 64]
            slots = np.concatenate([rows[i][0] for i in own])
            values = np.concatenate([rows[i][1] for i in own]).astype(float)
            row = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
            score = np.bincount(row, w[slots] * values, len(own))
            theta = t0 + np.concatenate([[0], np.cumsum(np.exp(steps))])
            cum = 1 / (1 + np.exp(-np.clip(score[:, None] - theta, -30, 30)))  # P(grade > k)
            edge = np.concatenate([np.ones((len(own), 1)), cum, np.zeros((len(own), 1))], axis=1)
            at = np.arange(len(own))
            p = np.maximum(edge[at, y[own]] - edge[at, y[own] + 1], 1e-9)
            slope = np.zeros_like(edge)
            slope[:, 1:-1] = cum * (1 - cum)
            # Gradients of -log p by each upper and lower edge's logit.
            up, low = -slope[at, y[own]] / p, slope[at, y[own] + 1] / p
            g_score = (up + low) / len(own)
            g_theta = np.zeros(k + 2)
            np.add.at(g_theta, y[own], -up / len(own))
            np.add.at(g_theta, y[own] + 1, -low / len(own))
            g_theta = g_theta[1:-1]
            g = np.concatenate([np.bincount(slots, g_score[row] * values, size) + ridge * w, [g_theta.sum()], [g_theta[i + 1 :].sum() * np.exp(steps[i]) for i in range(k - 1)]])
            turn += 1
            mean = 0.9 * mean + 0.1 * g
            var = 0.99 * var + 0.01 * g * g
            move = 0.02 * (mean / (1 - 0.9**turn)) / (np.sqrt(var / (1 - 0.99**turn)) + 1e-8)
            w -= move[:size]
            t0 -= move[size]
            steps = steps - move[size + 1 :]
    return Model(w.astype(np.float32), t0 + np.concatenate([[0], np.cumsum(np.exp(steps))]), grades)


def fit(docs: DataFrame, labels: DataFrame, rating: str = "quality") -> Model:
    rows = training_rows(docs, labels, rating, FIT_ROWS)

    def extract(batches):
        hashed = Hashed()
        for batch in batches:
            got = [features(t, hashed) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s.astype("<i4").tobytes() for s, _ in got], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in got], pa.binary()), batch.column(1)], ["slots", "counts", "y"])

    got = rows.select("text", F.col("y").cast("double").alias("y")).mapInArrow(extract, "slots binary, counts binary, y double")
    return fit_rows([(np.frombuffer(r.slots, "<i4"), np.frombuffer(r.counts, "<f4"), r.y) for r in got.toLocalIterator()])


def score_columns(model: Model, text: Column, cut: float | None = None) -> Column:
    """struct<expected, tail>: the expected grade and the probability of a grade above ``cut`` (default: of the highest)."""
    k = len(model.thresholds)
    tail = k - 1 if cut is None else int(np.searchsorted(model.grades, cut, "right")) - 1

    @F.arrow_udf("expected double, tail double")
    def ordinal(texts: pa.Array) -> pa.Array:
        m, hashed = model, Hashed()  # the model, of 2**BITS weights, travels with the function
        p = np.array([m.above(*features(t, hashed)) for t in texts.cast(pa.binary()).to_pylist()]).reshape(len(texts), k)
        expected = m.grades[0] + p @ np.diff(m.grades)
        above = np.zeros(len(texts)) if not k or tail >= k else np.ones(len(texts)) if tail < 0 else p[:, tail]
        return pa.StructArray.from_arrays([pa.array(expected, pa.float64()), pa.array(above, pa.float64())], ["expected", "tail"])

    return ordinal(text)


def report(docs: DataFrame, labels: DataFrame, rating: str = "quality", select_at: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, expected_grade, tail_probability and whether it is selected."""
    rows = docs.select("doc_id", score_columns(fit(docs, labels, rating), F.col("text")).alias("s"))
    return rows.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("s.expected").alias("expected_grade"), F.col("s.tail").alias("tail_probability"), (F.col("s.tail") >= select_at).alias("selected")
    )
