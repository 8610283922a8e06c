"""A quality classifier: naive Bayes support vectors.

Features are n-gram indicators: words, and one to three shapes of words in a row (letters, capitals, digits and
punctuation; a word that repeats the one before has a shape of its own), hashed into a fixed space. Indicators are
scaled by the log-count ratio of the classes, and a linear hinge-loss model is fitted by dual coordinate descent. A
logistic curve, fitted on documents kept out of the descent, turns margins into probabilities.

At most SAMPLE_ROWS labelled documents are used for fitting; scoring reads all texts whole.

Defined results: null, empty and blank texts get the score of a text without features; without labels of both classes
every score is the share of label 1 (0.5 without any); repeated rows get equal scores; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.llm.common import Known, fold_of, labelled_sample

SAMPLE_ROWS = 4000
SPACE = 1 << 17
EPOCHS = 12
COST = 1.0
SMOOTHING = 1.0
CACHE_WORDS = 400_000
_CLASSES = ((re.compile(r"[^\W\d_a-z]*[A-ZÀ-ÖØ-Þ][^\W\d_a-z]*"), "A"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1\1"))


def shape(word: str) -> str:
    """Runs of capitals become A, of other letters a, of digits 0; other characters stay, runs of one cut to two."""
    for pattern, to in _CLASSES:
        word = pattern.sub(to, word) if to != "a" else re.sub(r"[^\W\d_A]+", "a", word)
    return word


class Features:
    """The distinct feature numbers of a text. What is known of words is kept, at most CACHE_WORDS of them."""

    def __init__(self) -> None:
        self.number = Known(self.add, CACHE_WORDS)
        self.words = np.zeros(1 << 14, np.int64)
        self.shapes = np.zeros(1 << 14, np.int64)

    def add(self, word: bytes) -> int:
        n = len(self.number)
        if n == len(self.words):
            self.words, self.shapes = np.resize(self.words, 2 * n), np.resize(self.shapes, 2 * n)
        text = word.decode()
        self.words[n] = zlib.crc32(b"w" + text.lower().encode()) % SPACE
        self.shapes[n] = zlib.crc32(b"s" + shape(text).encode())
        return n

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        index = np.array(list(map(self.number.fresh().__getitem__, words)), np.int64)
        s = self.shapes[index]
        s[1:][index[1:] == index[:-1]] = 1  # the word before, again
        two = (s[:-1] * 0x9E3779B1 + s[1:] * 31) % 0x7FFFFFFF
        three = (two[:-1] * 0x85EBCA6B + s[2:] * 37) % 0x7FFFFFFF
        return np.unique(np.concatenate([self.words[index], s % SPACE, (two ^ 0x5555) % SPACE, (three ^ 0x3333) % SPACE]))


@lru_cache(maxsize=1)
def worker_features() -> Features:
    """One cache for all tasks of a Python worker."""
    return Features()


def features_of(docs: DataFrame) -> DataFrame:
    """doc_id, y and the feature numbers, for documents with y."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = worker_features()
        for batch in batches:
            found = [features(t.as_py()).astype(np.int32).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "y", "features"])

    return docs.select("doc_id", "y", "text").mapInArrow(read, "doc_id long, y int, features binary")


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.bincount(np.concatenate([r for r, k in zip(rows, y, strict=True) if k == label]), minlength=SPACE) + SMOOTHING for label in (1, 0)]
    p, q = (c / c.sum() for c in counts)
    return np.log(p / q)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> np.ndarray:
    """Weights of a linear hinge-loss model with L2 penalty, by dual coordinate descent; rows of unit length.

    Each class has half of the cost in all, so the rarer class counts as much as the other.
    """
    signs = np.where(y == 1, 1.0, -1.0)
    upper = cost * np.where(y == 1, len(y) / (2 * max((y == 1).sum(), 1)), len(y) / (2 * max((y == 0).sum(), 1)))
    weights, alpha, order = np.zeros(SPACE), np.zeros(len(y)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            at, x = rows[i], values[i]
            gradient = signs[i] * weights[at].dot(x) - 1
            new = min(max(alpha[i] - gradient, 0.0), upper[i])
            if new != alpha[i]:
                weights[at] += (new - alpha[i]) * signs[i] * x
                alpha[i] = new
    return weights


def logistic_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of 1 / (1 + exp(-(a * margin + b))), by Newton's method with a small penalty and smoothed targets."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margins, np.ones(len(y))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-6 * theta)
        theta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


class Model:
    """Weights times ratios, squared ratios, and the logistic curve; its size is fixed by SPACE."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, a: float, b: float):
        self.scaled, self.square = (weights * ratios).astype(np.float32), (ratios**2).astype(np.float32)
        self.a, self.b = a, b

    def margin(self, features: np.ndarray) -> float:
        norm = float(self.square[features].sum(dtype=np.float64)) ** 0.5
        return float(self.scaled[features].sum(dtype=np.float64)) / norm if norm else 0.0

    def __call__(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(features) + self.b, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Every fourth row is kept out of the descent, for the curve."""
    if len(set(y.tolist())) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Model(np.zeros(SPACE), np.zeros(SPACE), 0.0, float(np.log(share / (1 - share))))
    kept_out = np.arange(len(y)) % 4 == 3
    if any(len(set(y[m].tolist())) < 2 for m in (kept_out, ~kept_out)):
        kept_out = np.zeros(len(y), bool)
    inner = np.flatnonzero(~kept_out)
    ratios = log_ratios([rows[i] for i in inner], y[inner])
    scaled = [ratios[rows[i]] for i in inner]
    scaled = [x / (np.linalg.norm(x) or 1.0) for x in scaled]
    weights = descend([rows[i] for i in inner], scaled, y[inner])
    model = Model(weights, ratios, 1.0, 0.0)
    outer = np.flatnonzero(kept_out) if kept_out.any() else inner
    model.a, model.b = logistic_fit(np.array([model.margin(rows[i]) for i in outer]), y[outer])
    return model


def train(docs: DataFrame, labels: DataFrame, label: str, trained_on, rows: int = SAMPLE_ROWS) -> Model:
    found = features_of(labelled_sample(docs, labels, label, trained_on, rows)).orderBy("doc_id").collect()  # rows at most
    return fit([np.frombuffer(r["features"], np.int32) for r in found], np.array([r["y"] for r in found], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of SPACE floats

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = worker_features(), held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model(features(t.as_py())) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the fold held_out are not looked at."""
    model = train(docs, labels, "quality", fold_of(F.col("doc_id"), folds) != held_out)
    return score(docs, model).select("doc_id", (fold_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
