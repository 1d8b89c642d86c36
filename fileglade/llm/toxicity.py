"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

One weight vector serves all thresholds: P(grade <= k) = sigmoid(threshold_k - weights . words).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileglade.llm.common import worker_path

#: Labelled documents that the model is fitted on at most: those of least hashed doc_id, for each
#: grade a third.
SAMPLE = 6_000
#: Words must occur in so many of them to have a weight; so many words have one at most.
MIN_DOCS, MAX_WORDS = 3, 50_000
L1, STEPS = 0.002, 400
#: A document is toxic from this expected severity on.
TOXIC = 1.0
GRADES = ("clean", "toxic", "toxic, often")

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> Counter:
    """Lower-case words of a whole text and how often each occurs."""
    return Counter(_WORD.findall(text.lower()))


@dataclass
class OrdinalModel:
    """Weights by word, and ascending thresholds between the grades."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, text: str) -> float:
        get = self.weights.get
        found = _WORD.findall(text.lower())
        return sum(w for w in map(get, set(found)) if w)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """Of each grade, for each score."""
        below = 1 / (1 + np.exp(-(self.thresholds[None, :] - np.asarray(scores)[:, None])))
        padded = np.pad(below, ((0, 0), (1, 1)), constant_values=(0.0, 1.0))
        return np.diff(padded, axis=1)


def fit(features: list[list[str]], grades: np.ndarray, l1: float = L1, steps: int = STEPS) -> OrdinalModel:
    """Proximal gradient descent on the mean log-likelihood; the L1 term zeroes chance words.

    Grades that no sample has leave their thresholds together with the next. Classes count alike.
    """
    grades = np.asarray(grades)
    n, top = len(grades), len(GRADES) - 1
    seen = Counter(w for f in features for w in f)
    vocabulary = sorted((w for w, c in seen.items() if c >= MIN_DOCS), key=lambda w: (-seen[w], w))[:MAX_WORDS]
    number = {w: i for i, w in enumerate(vocabulary)}
    own = [np.array([number[w] for w in f if w in number], np.int32) for f in features]
    row = np.repeat(np.arange(n), [len(x) for x in own])
    col = np.concatenate([np.zeros(0, np.int32), *own])
    if not n or len(set(grades.tolist())) < 2:
        return OrdinalModel({}, np.full(top, 20.0))
    share = np.bincount(grades, minlength=top + 1)
    importance = (1 / np.maximum(share, 1))[grades]
    importance /= importance.sum()
    # Words count less the more documents have them, so that the steps suit all alike.
    scale = 1 / np.sqrt(np.maximum(np.bincount(col, minlength=len(vocabulary)) / n, 0.01))
    value = 0.1 * scale[col]
    weights, cuts = np.zeros(len(vocabulary)), np.array([0.0, *np.zeros(top - 1)])
    gaps = np.zeros(top - 1)  # logarithms of the distances between thresholds
    step_w, momentum, speed = 4.0, 0.9, np.zeros(len(vocabulary))
    for _ in range(steps):
        score = np.bincount(row, value * weights[col], minlength=n)
        cuts = cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
        with np.errstate(over="ignore"):
            upper = 1 / (1 + np.exp(-(bounds[grades + 1] - score)))
            lower = 1 / (1 + np.exp(-(bounds[grades] - score)))
        p = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_score = importance * (up - low)  # derivative of the loss
        gradient = np.bincount(col, value * by_score[row], minlength=len(vocabulary))
        speed = momentum * speed - step_w * gradient
        weights = weights + speed
        shrink = step_w * l1
        weights = np.sign(weights) * np.maximum(np.abs(weights) - shrink, 0)
        by_cut = np.zeros(top)
        for k in range(top):
            by_cut[k] = (importance * (-up * (grades == k) + low * (grades == k + 1))).sum()
        cuts = cuts.copy()
        cuts[0] -= 1.0 * by_cut.sum()
        if top > 1:
            tails = np.cumsum(by_cut[::-1])[::-1][1:]
            gaps = np.clip(gaps - 1.0 * tails * np.exp(gaps), -5, 3)
    cuts = cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    kept = {w: float(0.1 * scale[i] * weights[i]) for w, i in number.items() if weights[i]}
    return OrdinalModel(kept, cuts)


def grade_of(toxic: bool, counts: Counter, marked: set[str]) -> int:
    """0 for a clean document; a toxic one is of grade 2 if marked words are over 1 % of it."""
    if not toxic:
        return 0
    return 1 + (100 * sum(counts[w] for w in marked) > sum(counts.values()))


def marked_words(bags: list[Counter], toxic: np.ndarray) -> set[str]:
    """Words of MIN_DOCS toxic documents that clean ones have less than a 20th as often."""
    bad, good = Counter(), Counter()
    for bag, t in zip(bags, toxic, strict=True):
        (bad if t else good).update(bag.keys())
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    return {w for w, c in bad.items() if c >= MIN_DOCS and 20 * good[w] / n_good < c / n_bad}


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> pd.DataFrame:
    """At most ``rows`` labelled documents (text, toxic), a third of them toxic if there are so
    many; chosen by a hash of doc_id, so alike in every run."""
    marked = labels.filter("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [
        marked.filter(F.col("toxic") == is_toxic).orderBy(*order).limit(limit)
        for is_toxic, limit in ((True, rows // 3), (False, rows - rows // 3))
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # ``rows`` rows at most
    found = docs.select("doc_id", "text").join(chosen, "doc_id").orderBy(*order).limit(rows)
    return found.select("text", "toxic").toPandas()


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> OrdinalModel:
    """Fits on a bounded sample of labelled documents, which the driver holds."""
    found = sample(docs, labels, rows)
    shared: dict[str, str] = {}  # one copy of each word for all bags
    bags = [
        Counter({shared.setdefault(w, w): c for w, c in words(t or "").items()}) for t in found["text"]
    ]
    toxic = found["toxic"].to_numpy(dtype=bool)
    marked = marked_words(bags, toxic) if len(bags) else set()
    grades = np.array([grade_of(t, b, marked) for t, b in zip(toxic, bags, strict=True)], np.int64)
    return fit([sorted(b) for b in bags], grades)


def severities(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, ``severity`` (the expected grade, 0 to 2), ``grade`` (the likeliest) and ``toxic``
    (an expected severity of ``TOXIC`` or more).

    Every whole text is scored in one pass without a shuffle. A null or empty text has no words, so
    it gets the severity of the thresholds alone. Repeated rows and null doc_ids are kept.
    """
    worker_path(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = [model.score(t) if isinstance(t, str) else 0.0 for t in frame["text"]]
            p = model.probabilities(np.array(scores, float))
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].astype("Int64"),
                "severity": p @ np.arange(p.shape[1]),
                "grade": p.argmax(axis=1) if len(p) else np.zeros(0, int),
                "toxic": p @ np.arange(p.shape[1]) >= TOXIC,
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, severity double, grade long, toxic boolean")
