"""Packing of documents into fixed-length token sequences.

Method: shortest-pack-first over the length histogram. Lengths are placed longest
first; every placement changes counts of packing patterns, not single documents,
so the work on the driver depends on the number of distinct lengths (at most the
sequence length), never on the number of documents. The patterns are then joined
back to the documents by each document's rank among those of its length.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import map_batches, materialize, table
from .words import LETTERS, NUMBERS, ODD, Memo, byte_signs

SEQUENCE = 4096
END_ID = 2
CACHE_ENTRIES = 800_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
#: With ``nth``, the piece's number in its task, that tells equal rows apart.
CUT = PIECES + ", nth long"

#: The tokenizer's pre-tokens, over lower-case text of plain characters.
PIECE = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}{NUMBERS}]+")
ID_BITS = 20


class WordEncoder:
    """Ids of whole texts, equal to those of the tokenizers library, with each
    distinct pre-token merged once.

    The library takes some 50 microseconds for every word, seen before or not, so
    texts of plain characters are cut into pre-tokens here and each new pre-token is
    merged by the vocabulary's ranks. Texts whose treatment depends on the library's
    version of Unicode, or that hold a special token's string, go to the library.
    The memo of pre-tokens is bounded.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {vocab[a] << ID_BITS | vocab[b]: rank << ID_BITS | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        sign = byte_signs()
        self.inner = [vocab[sign[b]] for b in range(256)]
        self.last = [vocab[sign[b] + end] for b in range(256)]
        self.known = Memo(self._merge, CACHE_ENTRIES)

    def _library(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merge(self, piece: str) -> bytes:
        if len(piece) > 200:
            return self._library(piece)
        raw = piece.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        get, none = self.merges.get, 1 << 62
        ranks = [get(a << ID_BITS | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            new = least & (1 << ID_BITS) - 1
            ids[i : i + 2] = [new]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << ID_BITS | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << ID_BITS | new, none)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids, each as four bytes, little-endian."""
        if ODD.search(text) or any(s in text for s in self.special):
            return self._library(text)
        return b"".join(map(self.known.__getitem__, PIECE.findall(text.lower())))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, cap: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Tokenize each document once and cut it at every ``cap`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        enc, end, nth = encoder(tokenizer), struct.pack("<I", end_id), 0
        for batch in batches:
            rows, of = [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                ids = enc.encode(text or "") + end
                n = len(ids) // 4
                for at in range(0, n, cap):
                    part = ids[4 * at : 4 * (at + cap)]
                    rows.append((at, len(part) // 4, zlib.crc32(part), n, nth))
                    of.append(k)
                    nth += 1
            columns = zip(*rows) if rows else [[]] * 5
            yield {"doc_id": batch["doc_id"].take(pa.array(of, pa.int64())), **dict(zip(["start", "length", "ids_crc32", "doc_tokens", "nth"], map(list, columns)))}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, CUT)


@dataclass
class Placement:
    """``packs`` sequences from ``first`` on get ``each`` pieces of ``length`` from
    ``offset`` on; the pieces are those of ranks from ``rank`` on."""

    length: int
    rank: int
    first: int
    packs: int
    each: int
    offset: int


def shortest_pack_first(histogram: dict[int, int], cap: int = SEQUENCE) -> list[Placement]:
    """Place all lengths, longest first, each into the least filled packs that exist.

    Packs of equal history are one heap entry (fill, first sequence, count). A
    length that does not fit the least filled pack opens new packs and is stacked
    there, as one-by-one placement would do.
    """
    packs: list[tuple[int, int, int]] = []
    placed: list[Placement] = []
    used = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def put(first: int, count: int, each: int, fill: int) -> None:
            nonlocal left, rank
            placed.append(Placement(length, rank, first, count, each, fill))
            left -= count * each
            rank += count * each
            if fill + each * length < cap:
                heapq.heappush(packs, (fill + each * length, first, count))

        while left > 0:
            if packs and packs[0][0] + length <= cap:
                fill, first, count = heapq.heappop(packs)
                if count > left:
                    heapq.heappush(packs, (fill, first + left, count - left))
                    put(first, left, 1, fill)
                else:
                    level = packs[0][0] if packs else cap
                    each = min((cap - fill) // length, max(1, -(-(level - fill) // length)), left // count)
                    put(first, count, each, fill)
            else:
                each = cap // length
                full, rest = divmod(left, each)
                if full:
                    put(used, full, each, 0)
                    used += full
                if rest:
                    put(used, 1, rest, 0)
                    used += 1
    return placed


def rank_within(df: DataFrame, key: str, order: list[str], per_bucket: int = 50_000) -> DataFrame:
    """Add ``rank`` from 0 within each key, with no task holding a whole hot key.

    Rows are dealt to hash buckets; a bucket's first rank is the sum of the key's
    counts in earlier buckets, and only rows of one (key, bucket) are sorted together.
    """
    buckets = max(8, df.count() // per_bucket)
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(W.partitionBy(key, "_bucket").orderBy(*order))
    return dealt.join(base, [key, "_bucket"]).withColumn("rank", F.col("_base") + inside - 1).drop("_bucket", "_base")


def pack_documents(docs: DataFrame, tokenizer: str, cap: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document and its place in a sequence.

    A null text counts as empty and so is the closing id alone; a null ``doc_id``
    stays null. Repeated rows are packed each for itself. Columns other than
    ``doc_id`` and ``text`` are not read. An empty table gives no rows. Pieces of
    equal length are ranked by (doc_id, start); which of two equal rows comes first
    is open, as they cannot be told apart. Sequences hold at most ``cap`` ids.
    """
    pieces = materialize(token_pieces(docs, tokenizer, cap, end_id), "pieces")
    return give_places(pieces, shortest_pack_first(histogram_of(pieces), cap))


def histogram_of(pieces: DataFrame) -> dict[int, int]:
    """The number of pieces of each length: as many rows as there are lengths."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}


def give_places(pieces: DataFrame, placements: list[Placement]) -> DataFrame:
    """Join the placements back to the pieces, by each piece's rank among those of its length."""
    by_length: dict[int, list[Placement]] = {}
    for p in placements:
        by_length.setdefault(p.length, []).append(p)
    plan = {
        n: (np.array([p.rank for p in ps]), np.array([[p.first, p.each, p.offset] for p in ps]))
        for n, ps in by_length.items()
    }
    sent = pieces.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                starts, rows = sent.value[int(n)]
                hit = np.searchsorted(starts, ranks[at], side="right") - 1
                inside = ranks[at] - starts[hit]
                first, each, base = rows[hit].T
                sequence[at] = first + inside // each
                offset[at] = base + inside % each * n
            same = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield {**{c: batch[c] for c in same}, "sequence_id": sequence, "offset": offset}

    return map_batches(rank_within(pieces, "length", ["doc_id", "start", "nth"]).drop("nth"), place, PACKED)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
