"""Toxicity as ordered grades by cumulative-link regression.

P(grade > k) = sigmoid(w.x - t_k) with one sparse weight vector for all
thresholds t_0 < t_1. Features are counts of case-folded words and of word
beginnings of a few lengths, kept by 64-bit hash, and L1 leaves only few with a
weight. Labels know two grades; toxic
training texts are split at their median first-round score into grades 1 and 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import PLAIN, Words, held_out, sliced
from .training import Ftrl, counted, labelled_sample, sigmoid

MAX_TRAIN = 8192
EPOCHS = 8
ALPHA, L1 = 1.0, 8.0
MAX_COUNT, LEAST_SEEN = 3, 3
RATE, LEAST_GAP = 0.1, 0.2
BEGINNINGS = (4, 5, 6, 7, 8, 10)
_FILTER_BITS = 20


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word and word beginning, text number of each)."""
    words = Words(texts, PLAIN)
    owner = words.text_of()
    hashes, owners = [words.hash], [owner]
    for n in BEGINNINGS:
        h, at = words.beginnings(n)
        hashes.append(h)
        owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners)


class Model:
    """Thresholds and the words with a weight."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights, self.cuts = keys[order], weights[order], cuts
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) by text and threshold."""
        hashes, owners = features(texts)
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        total = np.zeros(len(texts))
        if len(maybe) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            right = self.keys[at] == hashes[maybe]
            owner = owners[maybe[right]]
            pair, n = np.unique(owner * len(self.keys) + at[right], return_counts=True)
            total = np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)] * np.minimum(n, MAX_COUNT), len(texts))
        return sigmoid(total[:, None] - self.cuts)


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, size: int, cuts: int) -> tuple[np.ndarray, np.ndarray]:
    model = Ftrl(size, alpha=ALPHA, l1=L1, l2=0.01)
    t = np.arange(cuts, dtype=float) * 2.0
    rng = np.random.default_rng(3)
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, x = rows[k]
            w = model.weights(at)
            # With P(y) = P(> y-1) - P(> y) of logistic form, the slope of log P(y) along the score is 1 - P(> y-1) - P(> y).
            p = np.concatenate([[1.0], sigmoid(w @ x - t), [0.0]])
            y = grades[k]
            model.update(at, w, -(1 - p[y] - p[y + 1]) * x)
            step = RATE / (1 + epoch) * np.minimum(1.0, p[y : y + 2] * (1 - p[y : y + 2]) / max(p[y] - p[y + 1], 1e-6))
            if y > 0:
                t[y - 1] -= step[0]
            if y < cuts:
                t[y] += step[1]
            t[1:] = np.maximum(t[1:], t[:-1] + LEAST_GAP)
    return model.weights(), t


def _train(counts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([a for a, _ in counts]), return_inverse=True)
    seen = np.bincount(at, np.concatenate([c for _, c in counts]), len(keys))
    common = seen >= LEAST_SEEN
    number = np.cumsum(common) - 1
    rows = []
    for part, (_, c) in zip(np.split(at, np.cumsum([len(a) for a, _ in counts])[:-1]), counts, strict=True):
        some = common[part]
        rows.append((number[part[some]], np.minimum(c[some], MAX_COUNT).astype(float)))
    keys = keys[common]
    w, _ = _fit(rows, toxic, len(keys), 1)
    score = np.array([w[i] @ x for i, x in rows])
    middle = np.median(score[toxic > 0]) if (toxic > 0).any() else 0.0
    w, cuts = _fit(rows, toxic + ((toxic > 0) & (score > middle)), len(keys), 2)
    some = np.flatnonzero(w)
    return keys[some], w[some], cuts


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted on a bounded labelled sample (``rows``) of feature counts, in one task; without labelled rows, one that scores everything 0.5."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "label"])
        counts = [(np.frombuffer(a, np.uint64), np.frombuffer(n, np.int64)) for a, n in zip(group["at"], group["n"], strict=True)]
        parts = _train(counts, (group["label"].to_numpy() > 0).astype(int))
        return pd.DataFrame([[p.tobytes() for p in parts]], columns=["keys", "weights", "cuts"])

    sample = counted(labelled_sample(docs, labels, label, rows, id_col, text_col), features, id_col)
    fitted = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "keys binary, weights binary, cuts binary").first()
    if fitted is None:
        return Model(np.empty(0, np.uint64), np.empty(0), np.zeros(2))
    return Model(np.frombuffer(fitted["keys"], np.uint64), np.frombuffer(fitted["weights"]), np.frombuffer(fitted["cuts"]))


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, p_toxic, expected_severity, grade, toxic) for every row, from its whole text.

    expected_severity is the sum of P(grade > k), from 0 to 2; grade the likeliest
    one; toxic whether grade 1 or more has half the mass or more. Null and empty
    texts score by the thresholds alone. Repeated rows and null ids are kept.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = np.zeros((len(batch), len(held.value.cuts)))
            for start, texts in sliced(batch["text"], fold=True):
                p[start : start + len(texts)] = held.value.above(texts)
            mass = -np.diff(np.concatenate([np.ones((len(batch), 1)), p, np.zeros((len(batch), 1))], axis=1), axis=1)
            yield pd.DataFrame({id_col: batch["id"], "held_out": batch["held_out"], "p_toxic": p[:, 0], "expected_severity": p.sum(axis=1), "grade": mass.argmax(axis=1).astype(np.int32), "toxic": p[:, 0] >= 0.5})

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(df[id_col].alias("id"), held_out(id_col).alias("held_out"), df[text_col].alias("text"))
    return narrow.mapInPandas(score, f"`{id_col}` {kind}, held_out boolean, p_toxic double, expected_severity double, grade int, toxic boolean")
