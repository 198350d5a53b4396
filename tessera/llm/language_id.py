"""Language identification with error-correcting output codes.

Each language has a codeword of plus and minus ones. For every bit a binary
classifier (logistic regression on shares of letter n-grams) predicts the
plus or minus; decoding gives the language whose codeword has the least
logistic loss, so that sure bits weigh more. Two languages that come near
each other flag the row as ambiguous.

The classifiers are fitted to at most max_rows labelled rows with letters, of
each language those with the smallest hashes: languages have the same share,
what one does not fill goes to the others, and each has a row at least.
Predictions are made for every row and over whole texts.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import id_hash_mod, materialize, release_memory

#: Size of the hashed space of n-grams, lengths of n-grams in bytes of UTF-8.
SPACE, LENGTHS = 1 << 12, (1, 2, 3, 4)
#: The class of a text that has no letter, or if no language was learned.
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[128:] = True
_MULTIPLY = np.uint32(2654435761)


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages by bits, plus and minus ones
    weights: np.ndarray  # n-grams by bits
    bias: np.ndarray


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords. Up to seven: all ways to part n in two; more: random ones, the best of some draws by least distance."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        return np.array([[1.0, *x] for x in itertools.product((1.0, -1.0), repeat=n - 1) if -1.0 in x]).T
    rng, bits = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(n)))
    draws = [rng.choice((-1.0, 1.0), (n, bits)) for _ in range(50)]
    return max(draws, key=lambda c: ((bits - c @ c.T) + 2 * bits * np.eye(n)).min())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vector(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of letters; A-Z lower-cased, what is between words is one blank."""
    raw = np.frombuffer(b" " + text.encode().lower() + b" ", np.uint8)
    raw = np.where(_LETTER[raw], raw, np.uint8(32))
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)
    counts, h = np.zeros(SPACE), raw * np.uint32(1)
    for n in range(1, max(LENGTHS) + 1):
        if n in LENGTHS and len(h):
            counts += np.bincount((h + np.uint32(n)) * _MULTIPLY >> np.uint32(20), minlength=SPACE)
        h = h[:-1] * np.uint32(263) + raw[n:]
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def train(x: np.ndarray, languages: list[str], rate: float = 4.0, steps: int = 120, penalty: float = 1e-4) -> Model:
    """Logistic regression for each bit by gradient descent with momentum, languages weighing alike."""
    names = sorted(set(languages))
    code = codewords(len(names))
    at = np.array([names.index(k) for k in languages], int)
    weights, bias = np.zeros((SPACE, code.shape[1])), np.zeros(code.shape[1])
    if code.shape[1]:
        y, share = code[at], 1 / np.bincount(at)[at] / len(names)
        x64, move_w, move_b = x.astype(np.float32), np.zeros_like(weights), np.zeros_like(bias)
        for _ in range(steps):
            pull = -y / (1 + np.exp(np.clip(y * (x64 @ weights.astype(np.float32) + bias), -30, 30))) * share[:, None]
            move_w = 0.9 * move_w - rate * (x64.T @ pull.astype(np.float32) + penalty * weights)
            move_b = 0.9 * move_b - rate * pull.sum(0)
            weights, bias = weights + move_w, bias + move_b
    return Model(names, code, weights.astype(np.float32), bias)


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the best languages and their scores: losses turned into shares."""
    if model.code.shape[1] == 0:
        return np.zeros(len(x), int), np.ones(len(x))
    margin = (x @ model.weights + model.bias).astype(float)
    loss = np.logaddexp(0, -margin[:, None, :] * model.code[None]).sum(2)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    return best, share[np.arange(len(x)), best]


def held_out(doc_id: Column) -> Column:
    return id_hash_mod(doc_id, 3) == 1


def shares(rows: dict[str, int], max_rows: int) -> dict[str, int]:
    """How many of each language's rows are learned from: alike as far as there are so many, one at least."""
    out, left = {}, max_rows
    for k, (lang, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(rows) - k)))
        left -= out[lang]
    return out


def pick(known: DataFrame, max_rows: int) -> DataFrame:
    """doc_id and lang of the rows to learn from, at most max_rows or one a language."""

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 2]).filter(pa.array(map(has_letter, b.column(1).to_pylist()), pa.bool_()))

    # the level says how small a hash is: 8 steps for each halving
    h = F.xxhash64("doc_id")
    level = F.floor(-8 * F.log2(h / F.lit(2.0**64) + 0.5 + F.lit(2.0**-64))).cast("int")
    ids = known.select("doc_id", "text", "lang").mapInArrow(lettered, "doc_id long, lang string").distinct()
    ids = materialize(ids.select("doc_id", "lang", level.alias("level")), "language-ids", 0)
    # some hundred rows a language
    steps = ids.groupBy("lang", "level").agg(F.count("*").alias("n")).collect()
    rows: dict[str, int] = {}
    for r in steps:
        rows[r["lang"]] = rows.get(r["lang"], 0) + r["n"]
    share, least, reached = shares(rows, max_rows), {}, dict.fromkeys(rows, 0)
    for r in sorted(steps, key=lambda r: -r["level"]):
        if reached[r["lang"]] < share[r["lang"]]:
            reached[r["lang"]] += r["n"]
            least[r["lang"]] = r["level"]
    limits = ids.sparkSession.createDataFrame([(k, share[k], least[k]) for k in sorted(rows)], "lang string, share int, least int")
    # hardly more rows than are picked come to the window
    near = ids.join(F.broadcast(limits), "lang").filter("level >= least")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return near.withColumn("place", place).filter("place <= share").select(F.col("doc_id").alias("p_doc_id"), F.col("lang").alias("p_lang"))


def fit(docs: DataFrame, max_rows: int = 2500) -> Model:
    """Train on the rows that pick takes of those that have a text with letters and a language and are not held out."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = base.filter("text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    picked = pick(known, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, vector(t).tobytes()) for i, t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if has_letter(t)]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.binary()))], ["doc_id", "lang", "vector"])
        release_memory()

    # the picked ids are broadcast; each row has a vector of fixed size; one row an id and language
    sample = known.join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("lang") == F.col("p_lang")), "left_semi").mapInArrow(run, "doc_id long, lang string, vector binary")
    got = sorted(sample.groupBy("doc_id", "lang").agg(F.min("vector").alias("vector")).collect(), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[1]))
    x = np.stack([np.frombuffer(r[2], np.float32) for r in got]) if got else np.zeros((0, SPACE), np.float32)
    return train(x, [r[1] for r in got])


def predict(docs: DataFrame, model: Model, sure: float = 0.7) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row of docs; a null text and one without letters get `und` and score 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = b.column(1).to_pylist()
                ok = np.array([bool(t) and bool(model.languages) and has_letter(t) for t in texts], bool)
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if ok.any():
                    best, share = decode(model, np.stack([vector(t) for t, k in zip(texts, ok, strict=True) if k]))
                    scores[ok] = share
                    for i, k in zip(np.flatnonzero(ok), best, strict=True):
                        names[i] = model.languages[k]
                yield pa.record_batch([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(ok & (scores < sure), pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, max_rows: int = 2500) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row of docs.

    docs: doc_id, text and lang; other columns are ignored, and lang is only
    read where the classifiers are fitted. Repeated rows give repeated rows;
    null ids are held out or not as the empty text. One learned language is
    always predicted, with score 1. Very long texts are read whole; an empty
    table gives no rows. Of languages with equal loss the first by code points
    is predicted, and the row is ambiguous.
    """
    out = predict(docs, fit(docs, max_rows))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
