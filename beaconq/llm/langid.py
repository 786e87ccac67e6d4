"""Language identification by error-correcting output codes.

Method: each language has a binary codeword; for each bit a linear classifier over
hashed character n-grams predicts it, for a document by the mean vote of its words
(a word's vote is bounded, so that a foreign passage counts by its length). Decoding sums, for each language, a logistic
loss of every bit's margin weighted by how reliable the bit was in training, and
takes the codeword of least loss. A document whose two best codewords are close is
flagged as ambiguous.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import HASHES, fold, map_batches, table, within_bytes

BUCKETS = 1 << 15
EPOCHS = 4
RATE = 2.0
#: Bound of the training sample: so many rows of a language, taken by hash and therefore
#: some few percent more or less; fewer where there are so many languages that all
#: of them together would have over ``MOST_ROWS``. No language is left out.
ROWS_PER_LANGUAGE, MOST_ROWS = 400, 200_000
#: Codewords have this many bits for each doubling of the languages, and this many besides.
BITS_PER_DOUBLING, BITS_BESIDES = 3, 4
#: Two best codewords nearer than this (difference of their probabilities) are ambiguous.
MARGIN = 0.2
WORDS_KEPT, GRAMS_KEPT = 300_000, 1 << 18
#: New words whose votes are worked out at once.
WORDS_AT_ONCE = 4096
#: Steepness of a word's vote, and how much a unanimous vote weighs in decoding.
STEEPNESS, UNANIMOUS = 0.5, 8.0
UNKNOWN = "und"
#: Word characters that are numbers and no letters, such as superscripts, fractions and Roman numerals.
NUMERALS = frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nl", "No"))
LETTERS = re.compile(r"[^\W\d_]+")


class Grams(dict):
    """Hash rows of n-grams as they are met, in a table of bounded size."""

    def __missing__(self, gram: str) -> int:
        if len(self) >= GRAMS_KEPT:
            self.clear()
        row = self[gram] = zlib.crc32(gram.encode("utf-8", "replace")) % BUCKETS
        return row


GRAMS = Grams()


def word_rows(word: str) -> list[int]:
    """Hash rows of a word's n-grams of one to three characters, ends marked."""
    marked = f"<{word}>"
    size = len(marked)
    grams = [*marked, *[marked[i : i + 2] for i in range(size - 1)], *[marked[i : i + 3] for i in range(size - 2)]]
    return list(map(GRAMS.__getitem__, grams))


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    if not text.isascii() and not NUMERALS.isdisjoint(text):
        text = text.translate(dict.fromkeys(map(ord, NUMERALS), " "))
    return LETTERS.findall(text.lower())


def text_rows(text: str) -> Counter:
    rows: Counter = Counter()
    for w, n in Counter(words_of(text)).items():
        for r in word_rows(w):
            rows[r] += n
    return rows


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """A code of +1 and -1, a row for each language: of random candidates, each with
    both values in every bit, the one with the largest least distance of two rows."""
    bits = BITS_BESIDES + BITS_PER_DOUBLING * max(1, int(np.ceil(np.log2(max(languages, 2)))))
    rng = np.random.default_rng(seed)
    best, score = None, (-1, 0.0)
    for _ in range(200):
        code = rng.choice([-1, 1], (languages, bits))
        if languages > 1:
            same = np.abs(code.sum(axis=0)) == languages
            code[0, same] *= -1
            apart = (bits - code @ code.T) / 2 + np.eye(languages) * bits
            rated = (apart.min(), apart.mean())
        else:
            rated = (0, 0.0)
        if best is None or rated > score:
            best, score = code, rated
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and probabilities for rows of bit margins."""
        loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.code[None], -30, 30))) * self.trust
        total = -loss.sum(axis=2)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        return total.argmax(axis=1), p / p.sum(axis=1, keepdims=True)


def train(examples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 3) -> Model | None:
    """Fit on (language, hash rows, counts); None without examples. A bit's trust is
    its mean likelihood ratio on examples that its pass of training had not yet seen."""
    languages = sorted({e[0] for e in examples})
    if not languages:
        return None
    code, rng = codewords(len(languages)), np.random.default_rng(seed)
    index = {lang: k for k, lang in enumerate(languages)}
    bits = code.shape[1]
    weights, bias, wrong = np.zeros((BUCKETS, bits)), np.zeros(bits), np.zeros(bits)
    for epoch in range(EPOCHS):
        wrong[:] = 0
        for k in rng.permutation(len(examples)):
            lang, rows, counts = examples[k]
            share, target = counts / np.sqrt((counts**2).sum()), code[index[lang]]
            margin = share @ weights[rows] + bias
            wrong += margin * target <= 0
            pull = target / (1 + np.exp(np.clip(margin * target, -30, 30)))
            weights[rows] += RATE / (1 + epoch) * np.outer(share, pull)
            bias += 0.1 * RATE / (1 + epoch) * pull
    error = (wrong + 1) / (len(examples) + 2)
    trust = np.maximum(np.log((1 - error) / error), 0.1)
    return Model(languages, code, weights.astype(np.float32), bias, trust / trust.mean())


class Voter:
    """Mean votes of a text's words on each bit. Votes of words seen are kept in a
    table of bounded size."""

    def __init__(self, model: Model) -> None:
        self.model, self.index = model, {}
        self.votes = np.empty((1024, model.code.shape[1]), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Votes of new words, each given once."""
        for at in range(0, len(words), WORDS_AT_ONCE):
            some, first = words[at : at + WORDS_AT_ONCE], len(self.index)
            found = list(map(word_rows, some))
            while first + len(some) > len(self.votes):
                self.votes = np.concatenate([self.votes, np.empty_like(self.votes)])
            sizes = np.array(list(map(len, found)))
            flat = np.fromiter(chain.from_iterable(found), np.int32, sizes.sum())
            sums = np.add.reduceat(self.model.weights.take(flat, axis=0), np.cumsum(sizes) - sizes, axis=0)
            self.votes[first : first + len(some)] = np.tanh(STEEPNESS * sums / np.sqrt(sizes).astype(np.float32)[:, None])
            self.index.update(zip(some, range(first, first + len(some))))

    def margins(self, words: list[str]) -> np.ndarray:
        if len(self.index) > WORDS_KEPT:
            self.index.clear()
        ids = list(map(self.index.get, words))
        if None in ids:
            self._learn(list(dict.fromkeys(w for w, k in zip(words, ids) if k is None)))
            ids = list(map(self.index.get, words))
        return UNANIMOUS * self.votes.take(ids, axis=0).mean(axis=0, dtype=np.float64)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Train on a bounded sample of rows outside the held-out fold with a language and
    a text with letters; of rows with the same id and language, the least text. Hash
    rows and counts alone come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [text_rows(t) for t in batch["text"].to_pylist()]
            yield {
                "doc_id": batch["doc_id"],
                "lang": batch["lang"],
                "rows": [np.fromiter(c.keys(), np.int32, len(c)).tobytes() for c in found],
                "counts": [np.fromiter(c.values(), np.float32, len(c)).tobytes() for c in found],
            }

    known = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", 4) != 2) & F.col("doc_id").isNotNull()
    )
    # Each language's share of the hash range, from its number of rows, so that ids of one language never meet in one task.
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    rows_per_language = max(1, min(rows_per_language, MOST_ROWS // max(1, len(sizes))))
    cuts = [(r["lang"], min(HASHES, HASHES * rows_per_language // r["n"])) for r in sizes]
    cut = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long"))
    picked = known.join(cut, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < F.col("cut"))
    rows = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = map_batches(rows, count, "doc_id long, lang string, rows binary, counts binary").filter("length(rows) > 0")
    got = within_bytes(sample, F.length("rows") + F.length("counts")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"]))
    return train([(r["lang"], np.frombuffer(r["rows"], np.int32), np.frombuffer(r["counts"], np.float32).astype(np.float64)) for r in got])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``ambiguous`` for each row.

    A null text, or one without a letter, is ``und`` with score 0; so is every row if
    there was nothing to learn from. Null and repeated ids keep one row each. Of equal
    codeword losses the language first by name is taken. Whole texts are read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = sent.value

        voter = Voter(model) if model else None
        for batch in batches:
            n = batch.num_rows
            pred, score, unsure = [UNKNOWN] * n, np.zeros(n), [True] * n
            at, margins = [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                words = words_of(text) if model and text else []
                if words:
                    at.append(k)
                    margins.append(voter.margins(words))
            if at:
                best, p = model.decode(np.array(margins))
                order = np.sort(p, axis=1)
                for k, b, row, o in zip(at, best, p, order):
                    pred[k], score[k] = model.languages[b], row[b]
                    unsure[k] = bool(len(o) > 1 and o[-1] - o[-2] < MARGIN)
            yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": pred, "score": score, "ambiguous": unsure}

    rows = docs.select(F.col("doc_id").cast("long"), (fold("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
