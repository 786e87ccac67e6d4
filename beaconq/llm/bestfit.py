"""Best-fit packing of documents into few sequences under several limits at once.

Method: vector best fit. A sequence has three capacities: tokens, documents, and the
cost of attention (the sum of the squares of its documents' lengths). A piece goes to
the sequence that is best by its rule among those in which it fits under every limit:
``norm`` takes the sequence whose weighted residual is the shortest after placing,
``dot`` the one whose residual has the largest weighted product with the demand. Pieces
are placed longest first.

Sequences with equal residuals are one class with a count, so the work on the driver
depends on the number of distinct lengths, never on the number of documents; the
placements are joined back to the pieces by rank, as in ``packing``.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import materialize, table
from .packing import Placement, give_places, histogram_of, token_pieces

SEQUENCE = 2048
END_ID = 0
#: Of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.01, 0.01)
PACKED = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


class Classes:
    """Sequences by equal residuals: rows of (tokens, documents, cost) left, with the
    number of sequences and the first of their numbers."""

    def __init__(self, capacity: tuple[int, int, int]) -> None:
        self.capacity = capacity
        self.left = np.zeros((64, 3), np.int64)
        self.count, self.first = np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.n = self.used = 0

    def add(self, left: np.ndarray, count: int, first: int) -> None:
        if left[0] <= 0 or left[1] <= 0 or left[2] <= 0:
            return
        if self.n == len(self.count):
            alive = np.flatnonzero(self.count[: self.n])
            size = max(64, 2 * len(alive))
            for name in ("left", "count", "first"):
                old = getattr(self, name)
                new = np.zeros((size, *old.shape[1:]), np.int64)
                new[: len(alive)] = old[alive]
                setattr(self, name, new)
            self.n = len(alive)
        self.left[self.n], self.count[self.n], self.first[self.n] = left, count, first
        self.n += 1

    def best(self, demand: np.ndarray, rule: str, weights: np.ndarray) -> int:
        """The class to place in, of equal ones that of the smallest number; -1 if none fits."""
        left = self.left[: self.n]
        fits = np.flatnonzero((self.count[: self.n] > 0) & (left >= demand).all(axis=1))
        if not len(fits):
            return -1
        scale = np.array(self.capacity, np.float64)
        if rule == "norm":
            score = ((left[fits] - demand) / scale) ** 2 @ weights
        else:
            score = -(left[fits] / scale) @ (weights * demand / scale)
        best = fits[score == score.min()]
        return int(best[np.argmin(self.first[best])])


def vector_best_fit(
    histogram: dict[int, int], tokens: int = SEQUENCE, documents: int | None = None, attention: int | None = None,
    rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS,
) -> list[Placement]:
    """Place all lengths, longest first, as piece by piece placement would do.

    Under ``norm`` a sequence that got a piece is the best for the next of that length
    while it fits, so it is filled before the next one; under ``dot`` it is passed over
    for another of its class. None as a limit is one that tokens alone imply.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"no rule {rule!r}")
    capacity = np.array([tokens, tokens if documents is None else documents, tokens * tokens if attention is None else attention], np.int64)
    classes, placed, weight = Classes(tuple(int(c) for c in capacity)), [], np.array(weights, np.float64)
    for length in sorted(histogram, reverse=True):
        demand = np.array([length, 1, length * length], np.int64)
        if (demand > capacity).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        left, rank = histogram[length], 0
        while left:
            k = classes.best(demand, rule, weight)
            room = capacity.copy() if k < 0 else classes.left[k].copy()
            each = 1 if k >= 0 and rule == "dot" else min(left, int((room // demand).min()))
            packs = left // each if k < 0 else min(int(classes.count[k]), left // each)
            if k < 0:
                first = classes.used
                classes.used += packs
            else:
                first = int(classes.first[k])
                classes.first[k] += packs
                classes.count[k] -= packs
            placed.append(Placement(length, rank, first, packs, each, int(tokens - room[0])))
            classes.add(room - each * demand, packs, first)
            left -= packs * each
            rank += packs * each
    return placed


def pack_best_fit(
    docs: DataFrame, tokenizer: str, tokens: int = SEQUENCE, documents: int | None = None, attention: int | None = None,
    rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, end_id: int = END_ID,
) -> DataFrame:
    """One row for each piece of each document and its place in a sequence.

    Only documents longer than an empty sequence holds (by tokens, or by the attention
    cost of one piece) are cut, into pieces of that size; the last may be shorter. A
    null text counts as empty and so is the closing id alone; a null ``doc_id`` stays
    null. Repeated rows are packed each for itself. Columns other than ``doc_id`` and
    ``text`` are not read. An empty table gives no rows. Pieces of equal length are
    ranked by (doc_id, start); which of two equal rows comes first is open, as they
    cannot be told apart.
    """
    size = tokens if attention is None else min(tokens, isqrt(attention))
    pieces = materialize(token_pieces(docs, tokenizer, size, end_id), "pieces")
    placements = vector_best_fit(histogram_of(pieces), tokens, documents, attention, rule, weights)
    return give_places(pieces, placements).withColumn("piece", F.expr(f"int(start div {size})")).select(*PACKED)


def op13_bestfit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
