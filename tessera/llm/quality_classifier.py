"""A quality classifier: a linear support vector machine on n-gram indicators scaled by Naive Bayes log-count ratios.

Indicators are hashed n-grams of three kinds: words, runs of character classes
(so that "Word," reads as "A a ,"), and how long and how
often words repeat the one before. Each is scaled by the log of the ratio of its smoothed shares among
the good and the bad texts; the scaled vector has length one. The hinge loss
is minimized by dual coordinate descent, the classes weighing alike. A logistic
curve fitted to margins of folds left out turns margins into scores.

The model is fitted to at most max_rows labelled rows, those with the smallest
hashes; scores are computed for every row and over whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import id_hash_mod, release_memory
from tessera.types import free_name

#: Sizes of the hashed spaces of word n-grams and of class n-grams; longest class n-gram; longest run of equal words told apart.
WORD_SPACE, CLASS_SPACE, CLASS_N, RUN = 1 << 17, 1 << 14, 5, 6
#: Shares of words that repeat the one before, told apart.
SHARES = (0.02, 0.05, 0.1, 0.2, 0.4)
SPACE = WORD_SPACE + CLASS_SPACE + RUN + 1 + len(SHARES)
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[9:14] = 32
_MULTIPLY = np.uint32(2654435761)


class Model(NamedTuple):
    weights: np.ndarray  # float32, one a feature: ratio times weight
    bias: float
    slope: float
    shift: float

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


class Features:
    """Indices of the indicators that a text has; keeps its scratch space."""

    def __init__(self) -> None:
        self.words, self.classes = np.zeros(WORD_SPACE, bool), np.zeros(CLASS_SPACE, bool)

    @staticmethod
    def _flagged(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        flags[at] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        return found

    def __call__(self, text: str) -> np.ndarray:
        raw = text.encode()
        tokens = raw.lower().split()
        found = []
        if tokens:
            h = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
            pairs = (h[:-1] * np.uint32(31) + h[1:]) * _MULTIPLY >> np.uint32(15)
            found.append(self._flagged(self.words, np.concatenate([h * _MULTIPLY >> np.uint32(15), pairs])))
            same = np.concatenate([[False], h[1:] == h[:-1], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            runs = (edges[1::2] - edges[::2]).max(initial=0)
            found.append(WORD_SPACE + CLASS_SPACE + np.arange(min(runs, RUN) + 1))
            share = same.sum() / len(tokens)
            found.append(WORD_SPACE + CLASS_SPACE + RUN + 1 + np.arange(sum(share >= x for x in SHARES)))
        if raw:
            c = _CLASS[np.frombuffer(raw, np.uint8)]
            c = c[np.concatenate([[True], c[1:] != c[:-1]])]
            grams, h = [], c * np.uint32(1)
            for n in range(1, CLASS_N + 1):
                grams.append((h + np.uint32(n)) * _MULTIPLY >> np.uint32(18))
                h = h[:-1] * np.uint32(257) + c[n:]
            found.append(WORD_SPACE + self._flagged(self.classes, np.concatenate(grams)))
        return np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimize the hinge loss with L2 penalty, by dual coordinate descent over the rows in random order.

    rows: indices of each row's indicators; x is scale at these, divided by its length, and 1 for the bias.
    """
    rng, w, b = np.random.default_rng(seed), np.zeros(len(scale)), 0.0
    values = [(v / n if (n := float(np.sqrt(v @ v))) else v) for v in (scale[r] for r in rows)]
    square = np.array([1.0 + float(v @ v) for v in values])
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[rows[i]] += step * values[i]
                b += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def _ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the ratio of each indicator's share among the good texts to that among the bad ones."""
    good, bad = np.full(SPACE, smooth), np.full(SPACE, smooth)
    for r, k in zip(rows, y, strict=True):
        (good if k > 0 else bad)[r] += 1
    n_good, n_bad = int((y > 0).sum()) + 2 * smooth, int((y <= 0).sum()) + 2 * smooth
    seen = good + bad > 2 * smooth
    return np.where(seen, np.log(good / n_good) - np.log(bad / n_bad), 0.0)


def _margins(rows: list[np.ndarray], scale: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    out = []
    for r in rows:
        v = scale[r]
        n = float(np.sqrt(v @ v))
        out.append(float(w[r] @ v) / n + b if n else b)
    return np.array(out)


def _fit(rows: list[np.ndarray], y: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray, float]:
    scale = _ratios(rows, y)
    share = np.where(y > 0, (y > 0).mean(), (y <= 0).mean())
    w, b = descend(rows, scale, y, cost * 0.5 / share)
    return scale, w, b


def train(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, folds: int = 4) -> tuple[np.ndarray, Model]:
    """The ratios, and the model. labels: 1 good, 0 bad. Without both kinds the model gives the share of good rows (one half without rows)."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        share = float((labels > 0).mean()) if len(labels) else 0.5
        share = min(max(share, 0.01), 0.99)
        return np.zeros(SPACE), Model(np.zeros(SPACE, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    margin = np.zeros(len(y))
    for k in range(folds):
        held = np.arange(len(y)) % folds == k
        if len(set(y[~held].tolist())) == 2:
            margin[held] = _margins([rows[i] for i in np.flatnonzero(held)], *_fit([rows[i] for i in np.flatnonzero(~held)], y[~held], cost))
    # Platt's curve, its targets off 0 and 1; some Newton steps
    n_good, n_bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    at, x = np.array([1.0, 0.0]), np.stack([margin, np.ones(len(y))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        at = at - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    scale, w, b = _fit(rows, y, cost)
    return scale, Model((scale * w).astype(np.float32), b, max(float(at[0]), 1e-3), float(at[1]))


def held_out(doc_id: Column) -> Column:
    return id_hash_mod(doc_id, 5) == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> tuple[np.ndarray, Model]:
    """Train on at most max_rows documents that have a label and are not held out: those with the smallest hashes.

    labels: doc_id and quality; null ids and labels do not count, of several labels the lowest does.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    there = known.join(base.select("doc_id"), "doc_id", "left_semi")
    picked = there.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array([features(x.as_py() or "").tobytes() for x in b.column(2)], pa.binary())], ["doc_id", "quality", "features"])

    # at most max_rows ids and labels are broadcast
    sample = base.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, features binary")
    # repeated rows of one id count once: the driver gets max_rows rows at most
    got = sorted(sample.groupBy("doc_id", "quality").agg(F.min("features").alias("features")).collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    return train([np.frombuffer(r[2], np.int32) for r in got], np.array([r[1] for r in got], float))


def score(docs: DataFrame, fitted: tuple[np.ndarray, Model], keep: tuple[str, ...] = ("doc_id",), to: str = "score") -> DataFrame:
    """The columns keep of every row of docs, and the score. A null text counts as empty; a text without indicators gets the score of the bias."""
    scale, model = fitted
    # what the tasks get has a fixed size: two floats a feature
    squared, weights = (scale * scale).astype(np.float32), model.weights
    kept = docs.select(F.col("text").cast("string").alias(f"{free_name(docs)}text"), *[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in (whole.slice(k, 1000) for whole in batches for k in range(0, whole.num_rows, 1000)):
            margin = []
            for x in b.column(0):
                at = features(x.as_py() or "")
                n = float(np.sqrt(squared[at].sum(dtype=np.float64)))
                margin.append(float(weights[at].sum(dtype=np.float64)) / n + model.bias if n else model.bias)
            yield pa.record_batch([*b.columns[1:], pa.array(model.score(np.array(margin, float)), pa.float64())], [*b.schema.names[1:], to])
        release_memory()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[1:], T.StructField(to, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    docs: doc_id and text; labels: doc_id and quality; other columns are
    ignored. Null ids are held out or not as the empty text; repeated rows give
    repeated rows. A null text counts as empty, whose score is that of the bias;
    very long texts are read whole and cost time in proportion. Of several
    labels of a doc_id the lowest counts; labels without a document, and an
    empty table of labels, leave the scores to what labels there are (one half
    without any). An empty table of documents gives no rows.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, max_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 4000) -> DataFrame:
    """The rows of docs, with their columns, whatever their names, that classify predicts 1 for."""
    name = f"{free_name(docs)}score"
    scored = score(docs, fit(docs, labels, max_rows), tuple(docs.columns), name)
    return scored.filter(F.col(name) >= threshold).drop(name)
