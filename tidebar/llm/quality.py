"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Tokens are runs of letters and digits and runs of punctuation, so that symbols
stuck to words are seen. One- and two-grams fall into a fixed number of buckets;
a token that repeats the one before it falls into a bucket of its own. A text's
feature vector has the share of each bucket among its n-grams, and its score is
one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import MARKED, Words, held_out, sliced
from .training import Ftrl, counted, labelled_sample, sigmoid

BITS = 18
SCALE = 20.0
MAX_TRAIN = 8192
EPOCHS = 4
THRESHOLD = 0.3
REPEAT = 0


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, text number of each)."""
    words = Words(texts, MARKED)
    shift = np.uint64(64 - BITS)
    owner = words.text_of()
    one = (words.hash >> shift).astype(np.int64)
    two, first = words.grams(2)
    two = (two >> shift).astype(np.int64)
    if len(words.hash) > 1:
        same = (words.hash[1:] == words.hash[:-1])[owner[1:] == owner[:-1]]
        two[same] = REPEAT
    return np.concatenate([one, two]), np.concatenate([owner, np.repeat(np.arange(len(texts)), np.diff(first))])


def _train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    model = Ftrl(1 << BITS, alpha=1.0, l1=0.02, l2=0.05)
    bias = Ftrl(1, alpha=0.5, l1=0.0, l2=0.0)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, x = rows[k]
            w = model.weights(at)
            off = sigmoid(w @ x + bias.weights()[0]) - labels[k]
            model.update(at, w, off * x)
            bias.update(np.array([0]), bias.weights(), np.array([off]))
    return np.concatenate([bias.weights(), model.weights()]).astype(np.float32)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Bias and bucket weights, fitted on a bounded labelled sample (``rows``) of bucket counts.

    Without labelled rows all weights are 0.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "label"])
        counts = [(np.frombuffer(a, np.int64), np.frombuffer(n, np.int64)) for a, n in zip(group["at"], group["n"], strict=True)]
        shares = [(at, SCALE * n / max(1, n.sum())) for at, n in counts]
        return pd.DataFrame({"weights": [_train(shares, group["label"].to_numpy(float)).tobytes()]})

    sample = counted(labelled_sample(docs, labels, label, rows, id_col, text_col), buckets, id_col)
    fitted = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "weights binary").first()
    return np.frombuffer(fitted["weights"], np.float32) if fitted else np.zeros((1 << BITS) + 1, np.float32)


def score_texts(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    at, owner = buckets(texts)
    total = np.bincount(owner, weights[1:][at], len(texts))
    return sigmoid(weights[0] + SCALE * total / np.maximum(1, np.bincount(owner, minlength=len(texts))))


def score_quality(df: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row; null and empty texts get the bias's score.

    Repeated rows are kept, with equal scores; a null id is kept with held_out
    null; other columns are ignored.
    """
    held = df.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = np.zeros(len(batch))
            for start, texts in sliced(batch["text"], fold=True):
                s[start : start + len(texts)] = score_texts(texts, held.value)
            yield pd.DataFrame({id_col: batch["id"], "held_out": batch["held_out"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(df[id_col].alias("id"), held_out(id_col).alias("held_out"), df[text_col].alias("text"))
    return narrow.mapInPandas(score, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
