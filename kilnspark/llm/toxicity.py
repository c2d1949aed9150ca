"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, word pairs and pairs with one word between, hashed to 2**22 coordinates.
FTRL-proximal keeps a learning rate for each coordinate and an L1 threshold below which a weight is exactly zero,
so the model is a short list of coordinates and weights, broadcast to the scorers.

The fit sees at most TRAIN_ROWS labelled documents (by a hash of the id, held-out fold excluded) and their whole texts, fewer if their
coordinates exceed TRAIN_BYTES (a text that doesn't fit into what is left is skipped, those after it are not); executors turn texts into coordinates, the driver takes the proximal steps. An id with several rows
counts once. Scoring covers all rows.

Defined cases: a null text is empty; an empty text has the score of the bias; null ids are scored and count as held out; rows that
repeat are scored each; with no training rows of both kinds every score is the share of label 1 (0 without rows); an
empty table gives an empty result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnspark.llm.common import bounded_rows, coded, decoded, held_out, pick, text_or_empty, training_labels

TRAIN_ROWS = 8000
#: Bytes of the training rows' coordinates, at most; a row is in whole, or skipped if it doesn't fit into what is left.
TRAIN_BYTES = 96 << 20
EPOCHS = 12
BITS = 22
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.01
WORD = re.compile(r"\w+")
#: Words that a worker keeps the hashes of.
KNOWN = 100_000


class Features:
    """Distinct coordinates of a text; coordinate 0 is the bias and is in every text."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        if len(self.known) >= KNOWN:
            self.known.clear()
        got = self.known[word] = xxhash.xxh64_intdigest(word)
        return got

    def all(self, text: str) -> np.ndarray:
        known, fresh = self.known, self._hash
        h = np.fromiter((known.get(w) or fresh(w) for w in WORD.findall(text.lower())), dtype=np.uint64)
        with np.errstate(over="ignore"):
            kinds = [h * np.uint64(0x9E3779B97F4A7C15)]
            for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
                kinds.append((h[:-gap] * np.uint64(odd) + h[gap:]) * np.uint64(0x9E3779B97F4A7C15))
        return (np.concatenate(kinds) >> np.uint64(64 - BITS)).astype(np.int64)

    def distinct(self, text: str) -> np.ndarray:
        return np.unique(np.append(self.all(text), 0)).astype(np.int32)


@dataclass
class Weights:
    """Non-zero coordinates in order, their weights, and the bias."""

    at: np.ndarray
    w: np.ndarray
    bias: float

    def score(self, coordinates: np.ndarray, dense: np.ndarray) -> float:
        hit = coordinates[dense[coordinates] != 0]
        total = self.bias + float(dense[np.unique(hit)].sum()) if len(hit) else self.bias
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.w
        return out


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """Proximal steps over the rows, in the order given, `epochs` times. The bias is not thresholded."""
    n_one = int(labels.sum())
    if n_one == 0 or n_one == len(labels):
        share = n_one / len(labels) if len(labels) else 0.0
        return Weights(np.array([], np.int64), np.array([], np.float32), float(np.clip(np.log((share + 1e-15) / (1 - share + 1e-15)), -35, 35)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    z[0] = -np.log(n_one / (len(labels) - n_one)) * (BETA / ALPHA + L2)

    def weights(zi: np.ndarray, ni: np.ndarray, l1: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            zi, ni = z[x], n[x]
            l1 = np.where(x == 0, 0.0, L1)
            w = weights(zi, ni, l1)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            grown = np.sqrt(ni + g * g)
            z[x] = zi + g - (grown - np.sqrt(ni)) / ALPHA * w
            n[x] = ni + g * g
    w = weights(z, n, np.where(np.arange(1 << BITS) == 0, 0.0, L1))
    bias, w[0] = float(w[0]), 0.0
    at = np.flatnonzero(w)
    return Weights(at, w[at].astype(np.float32), bias)


def train(documents: DataFrame, labels: DataFrame, target: str = "toxic", most: int = TRAIN_ROWS) -> Weights:
    chosen = F.broadcast(training_labels(labels, target, most))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": [features.distinct(t).tobytes() for t in batch["text"]]})

    rows = documents.join(chosen, "doc_id").select("doc_id", "label", text_or_empty().alias("text")).mapInPandas(run, "doc_id long, label int, x binary")
    got = bounded_rows(rows, target, TRAIN_BYTES)
    return fit_ftrl([np.frombuffer(r["x"], np.int32) for r in got], np.array([r["label"] for r in got], float))


def score(documents: DataFrame, model: Weights) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast((model.at, model.w, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, weights = Features(), Weights(*shared.value)
        dense = weights.dense()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [weights.score(features.all(t), dense) for t in batch["text"]]})

    rows = documents.select(coded(F.col("doc_id")).alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double").select(decoded(F.col("doc_id")).alias("doc_id"), "score")


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """op2: score and decision for every document."""
    docs = pick(documents, doc_id="long", text="string")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scorer(model) -> callable:
    """A column function text -> score, for filters that keep all columns."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, dense = Features(), model.dense()
        for texts in batches:
            yield pd.Series([model.score(features.all(t or ""), dense) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")
