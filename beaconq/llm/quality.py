"""Quality classifier from supervised subword embeddings.

Method: every word, every character trigram of a word and every two adjacent words
(all that repeat a word as one) are hashed to a row of an embedding table; a document
is the mean of its rows; a softmax layer gives its class. Table and layer are learned together by stochastic
gradient descent in numpy on a bounded sample of labelled documents.

The softmax of a mean is linear in the words, so each distinct word's share is
worked out once and scoring is a sum over words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fold, labelled, table, within_bytes
from .words import Memo

#: Hash rows of words and trigrams, and after them those of word bigrams.
BUCKETS, BIGRAM_BITS = 1 << 15, 16
ROWS = BUCKETS + (1 << BIGRAM_BITS) + 1
#: The row of all bigrams whose second word repeats the first.
ECHO = ROWS - 1
DIMENSIONS = 12
EPOCHS = 8
RATE = 0.5
#: Bound of the training sample: so many labelled rows of each class, give or take few percent (``hash_share``).
ROWS_PER_CLASS = 2000
WORDS_KEPT = 400_000
MIX, STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def word_rows(word: str) -> list[int]:
    """Hash rows of one word: itself and its character trigrams, with ends marked."""
    marked = f"<{word}>"
    grams = [marked[i : i + 3] for i in range(len(marked) - 2)]
    return [word_hash(g) % BUCKETS for g in ["=" + marked, *grams]]


def bigram_rows(hashes: np.ndarray) -> np.ndarray:
    """Hash rows of each two adjacent words, from the words' hashes. A word that comes
    twice is hashed by that alone: repetition is learned once, not for every word."""
    pairs = (hashes[:-1] * MIX ^ hashes[1:]) * STIR
    rows = BUCKETS + (pairs >> np.uint64(64 - BIGRAM_BITS)).astype(np.int64)
    return np.where(hashes[:-1] == hashes[1:], ECHO, rows)


def text_rows(text: str) -> Counter:
    """How often each hash row occurs in a text."""
    words = text.split()
    rows: Counter = Counter()
    for w, n in Counter(words).items():
        for r in word_rows(w):
            rows[r] += n
    hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
    rows.update(bigram_rows(hashes).tolist())
    return rows


@dataclass
class Model:
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def shares(self) -> np.ndarray:
        """What each hash row adds to the difference of the two classes' outputs."""
        return self.embedding @ (self.weights[1] - self.weights[0])


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Fit on (label, hash rows, counts). Without examples of both classes the
    outcome is even for all texts."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1, 1, (ROWS, DIMENSIONS)) / DIMENSIONS, np.zeros((2, DIMENSIONS)), np.zeros(2))
    if len({label for label, _, _ in examples}) < 2:
        return model
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            label, rows, counts = examples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            share = counts / counts.sum(dtype=np.float64) if len(rows) else counts
            mean = share @ model.embedding[rows] if len(rows) else np.zeros(DIMENSIONS)
            out = model.weights @ mean + model.bias
            p = np.exp(out - out.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ model.weights
            model.weights -= rate * np.outer(error, mean)
            model.bias -= 0.1 * rate * error
            if len(rows):
                model.embedding[rows] -= rate * np.outer(share / share.max(), back) * min(1.0, share.max() * 20)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Train on a bounded sample. Only hash rows and counts come to the driver, at
    most one for each row of the table, however long the texts are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [text_rows(t or "") for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "label": batch["label"],
                    "rows": [np.fromiter(c.keys(), np.int32, len(c)).tobytes() for c in found],
                    "counts": [np.fromiter(c.values(), np.float32, len(c)).tobytes() for c in found],
                }
            )

    picked = labelled(docs, labels, "quality", (rows_per_class, rows_per_class))
    sample = picked.mapInPandas(count, "doc_id long, label int, rows binary, counts binary")
    got = within_bytes(sample, F.length("rows") + F.length("counts")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return train([(r["label"], np.frombuffer(r["rows"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in got])


def score_quality(docs: DataFrame, model: Model, keep: str = "doc_id long") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    A null text is scored as the empty text, from the bias alone. Null and repeated
    ids keep one row each. An empty table gives no rows. No other column is read.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.shares(), float(model.bias[1] - model.bias[0])))
    scored = F.pandas_udf(_scorer(sent), "double")
    return docs.select(
        F.col("doc_id").cast("long"),
        (fold("doc_id", 3) == 1).alias("held_out"),
        scored(F.col("text").cast("string")).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def _scorer(sent):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shares, bias = sent.value
        table_ = shares.tolist()

        def share(word: str) -> tuple[float, int, int]:
            rows = word_rows(word)
            return sum([table_[r] for r in rows]), len(rows), word_hash(word)

        known = Memo(share, WORDS_KEPT)
        for batch in batches:
            out = np.empty(len(batch))
            for k, text in enumerate(batch):
                total, n = 0.0, 0
                if words := (text or "").split():
                    sums, sizes, hashes = zip(*map(known.__getitem__, words))
                    pairs = shares[bigram_rows(np.array(hashes, np.uint64))]
                    total, n = sum(sums) + float(pairs.sum()), sum(sizes) + len(pairs)
                out[k] = bias + (total / n if n else 0.0)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    from collections.abc import Iterator as It

    score.__annotations__ = {"batches": It[pd.Series], "return": It[pd.Series]}
    return score


def keep_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast((model.shares(), float(model.bias[1] - model.bias[0])))
    scored = F.pandas_udf(_scorer(sent), "double")
    return docs.filter(scored(F.col("text").cast("string")) >= 0.5)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_quality(docs, fit(docs, labels))
