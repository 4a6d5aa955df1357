"""Bounded samples of labelled rows, and the follow-the-regularised-leader update."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import held_out, sliced


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled documents outside the held-out fold, those with the smallest hashed ids.

    A document labelled more than once counts once, with its larger label, and so
    does one with several rows; null labels are left out. Only the bounded list of
    ids is broadcast.
    """
    chosen = (
        labels.where(~held_out(id_col) & F.col(label).isNotNull())
        .groupBy(id_col)
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(rows)
    )
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), id_col).dropDuplicates([id_col])


def counted(sample: DataFrame, features, id_col: str = "doc_id") -> DataFrame:
    """(key, label, at, n): for each text its distinct features and their counts as bytes, made where the texts are, so that no text travels.

    ``features``: from texts to (feature of every occurrence, number of its text).
    ``key`` orders the rows the same way each time.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, texts in sliced(batch["text"], fold=True):
                found, owner = features(texts)
                order = np.argsort(owner, kind="stable")
                rows = []
                for part in np.split(found[order], np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1]):
                    at, n = np.unique(part, return_counts=True)
                    rows.append((at.tobytes(), n.astype(np.int64).tobytes()))
                here = batch.iloc[start : start + len(texts)]
                yield pd.DataFrame({"key": here["key"].to_numpy(), "label": here["label"].to_numpy(), "at": [a for a, _ in rows], "n": [n for _, n in rows]})

    return sample.select(F.xxhash64(F.col(id_col), F.lit(2)).alias("key"), "label", "text").mapInPandas(count, "key bigint, label int, at binary, n binary")


class Ftrl:
    """Follow the regularised leader with proximal L1 and L2 terms and per-coordinate rates."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """One step along gradient ``g`` of the coordinates ``at``, whose weights are ``w``."""
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
