"""Retrieval over a stored corpus: occurrences of asked terms, BM25, cosine.

Every task keeps no more than the first k rows of each query, so what is shuffled depends
on queries and tasks, not on how many documents share a term with a query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from beaconq.functions import text as T
from beaconq.session import bound_batches, shared_path

K1, B = 1.2, 0.75
#: Queries are asked in blocks of about so many terms, which are sent to all tasks.
BLOCK_TERMS = 200_000
#: Documents whose scores for all queries of a block are held at once, and rows that a task keeps before it drops those out of reach.
CHUNK, BUFFER = 256, 400_000


@dataclass
class Asked:
    """A block of queries: ids, distinct terms, and which queries have which term."""

    ids: np.ndarray
    terms: list[str]
    sizes: np.ndarray
    starts: np.ndarray
    holders: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, list[str]]]) -> Asked:
        held: dict[str, list[int]] = {}
        for k, (_, terms) in enumerate(rows):
            for t in terms:
                held.setdefault(t, []).append(k)
        counts = [len(h) for h in held.values()]
        return Asked(
            np.array([i for i, _ in rows], np.int64), list(held), np.array([len(t) for _, t in rows], np.int64),
            np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.array([k for h in held.values() for k in h], np.int64),
        )

    def part(self, low: int, high: int) -> Asked:
        """The same terms for some of the queries, numbered from zero."""
        kept = (self.holders >= low) & (self.holders < high)
        starts = np.concatenate([[0], np.cumsum(kept)])[self.starts].astype(np.int64)
        return Asked(self.ids[low:high], self.terms, self.sizes[low:high], starts, self.holders[kept] - low)

    def spread(self, rows: np.ndarray, terms: np.ndarray, values: list[np.ndarray], n: int) -> list[np.ndarray]:
        """For occurrences (row, term, values) the sums of values by row and query: arrays (n, queries)."""
        times = self.starts[terms + 1] - self.starts[terms]
        ends = np.cumsum(times)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times) + np.repeat(self.starts[terms], times)
        cells = np.repeat(rows, times) * len(self.ids) + self.holders[at]
        size = n * len(self.ids)
        return [np.bincount(cells, np.repeat(v, times), size).reshape(n, -1) for v in values]


def blocks(queries: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Asked]:
    """Queries (request_id, query) in blocks of about ``most`` terms; they pass the driver one by one."""
    rows, size = [], 0
    for r in queries.select(F.col("request_id").cast("long"), T.tokens(F.col("query")).alias("terms")).toLocalIterator():
        if rows and size + len(r["terms"]) > most:
            yield Asked.of(rows)
            rows, size = [], 0
        rows.append((r["request_id"], r["terms"]))
        size += len(r["terms"])
    if rows:
        yield Asked.of(rows)


def occurrences(docs: DataFrame, asked: Asked, carried: list[str]) -> DataFrame:
    """(doc_id, carried, dl, terms, counts) for each document (doc_id, text): its number of
    words, which of the asked terms it has, by number, and how often. One pass, no shuffle,
    and the words of ``CHUNK`` documents at a time as numbers."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(asked.terms)
    names = ["doc_id", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in (b.slice(at, CHUNK) for b in batches for at in range(0, b.num_rows, CHUNK)):
            words = batch["words"]
            sizes = np.diff(words.offsets.to_numpy())
            found = pc.index_in(words.flatten(), known).fill_null(-1).to_numpy()
            rows = np.repeat(np.arange(len(sizes)), sizes)[found >= 0]
            cells, counts = np.unique(rows * (len(known) + 1) + found[found >= 0], return_counts=True)
            ends = np.searchsorted(cells, np.arange(len(sizes) + 1) * (len(known) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cells % (len(known) + 1), counts)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sizes.astype(np.int64)), *lists], names=[*names, "dl", "terms", "counts"])

    rows = docs.select(*names, T.words(F.col("text")).alias("words"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "words")
    return rows.mapInArrow(run, f"{kinds}, dl long, terms array<int>, counts array<int>")


def chunks(batch: pa.RecordBatch, asked: Asked) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, term, count) of the occurrences in ``CHUNK`` rows at a time."""
    terms, counts = (batch[c].flatten().to_numpy() for c in ("terms", "counts"))
    ends = batch["terms"].offsets.to_numpy() - batch["terms"].offsets[0].as_py()
    for at in range(0, batch.num_rows, CHUNK):
        n = min(CHUNK, batch.num_rows - at)
        sizes = np.diff(ends[at : at + n + 1])
        part = slice(ends[at], ends[at + n])
        yield at, n, np.repeat(np.arange(n), sizes), terms[part].astype(np.int64), counts[part].astype(np.float64)


class Leaders:
    """The first ``k`` rows of each group by ascending keys, kept in bounded memory."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.n = k, [], 0

    def add(self, group: np.ndarray, *keys: np.ndarray) -> None:
        self.parts.append((group, *keys))
        self.n += len(group)
        if self.n > BUFFER:
            self.first()

    def first(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return ()
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.lexsort([*columns[:0:-1], columns[0]])
        group = columns[0][order]
        begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
        nth = np.arange(len(group)) - np.repeat(begins, np.diff([*begins, len(group)]))
        kept = order[nth < self.k]
        self.parts = [tuple(c[kept] for c in columns)]
        self.n = len(kept)
        return self.parts[0]


def least_first(ids: pa.Array) -> np.ndarray:
    """Ids as numbers, null before all others."""
    return ids.fill_null(-(1 << 63)).to_numpy()


def listed_tops(found: DataFrame, asked: Asked, k: int) -> DataFrame:
    """From ``occurrences`` with n_chars and good (1 or null): the first ``k`` documents of
    each query in each task by three orders (request_id, list, k1, k2, doc_id): terms found,
    distinct terms found and shortest, and terms found of good documents."""
    sent = found.sparkSession.sparkContext.broadcast(asked)
    names = ["tf", "coverage", "quality"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, leaders = sent.value, [Leaders(k) for _ in names]
        for batch in batches:
            ids, size = least_first(batch["doc_id"]), batch["n_chars"].fill_null(-(1 << 63)).to_numpy()
            good = batch["good"].fill_null(0).to_numpy() == 1
            for at, n, rows, terms, counts in chunks(batch, asked):
                tf, covered = asked.spread(rows, terms, [counts, np.ones(len(counts))], n)
                r, q = np.nonzero(covered)
                doc, none = ids[at + r], np.zeros(len(r), np.int64)
                tf, covered = -tf[r, q].astype(np.int64), -covered[r, q].astype(np.int64)
                leaders[0].add(q, tf, none, doc)
                leaders[1].add(q, covered, size[at + r], doc)
                is_good = good[at + r]
                leaders[2].add(q[is_good], tf[is_good], none[is_good], doc[is_good])
        for name, kept in zip(names, leaders):
            if (rows := kept.first()) and len(rows[0]):
                q, k1, k2, doc = rows
                ids = pa.array(doc, mask=doc == -(1 << 63))
                yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array([name] * len(q)), pa.array(k1), pa.array(k2), ids], names=["request_id", "list", "k1", "k2", "doc_id"])

    rows = found.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("good").cast("int").alias("good"), "terms", "counts")
    return rows.mapInArrow(run, "request_id long, list string, k1 long, k2 long, doc_id long")


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows in the shared folder, for more than one use."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(request_id, doc_id, score, rank): the k best documents by BM25 over all documents."""
    return asked_of(bm25_block, docs, queries, k)


def asked_of(answer: Callable, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The queries' answers, block by block."""
    parts = [answer(written(occurrences(docs, asked, []), "occurrences"), asked, k) for asked in blocks(queries)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "request_id long, doc_id long, score double, rank int")
    return reduce(DataFrame.unionByName, parts)


def bm25_block(found: DataFrame, asked: Asked, k: int) -> DataFrame:
    """From written ``occurrences``: statistics over all documents, then each task's first
    ``k`` by score, of which the first of all are taken."""
    spark = found.sparkSession
    n, words = found.agg(F.count("*"), F.sum("dl")).first()
    df = np.zeros(len(asked.terms))
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        df[r["t"]] = r["n"]
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    sent = spark.sparkContext.broadcast((asked, idf, (words or 0) / n if n else 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (asked, idf, mean), leaders = sent.value, Leaders(k)
        for batch in batches:
            ids, dl = least_first(batch["doc_id"]), batch["dl"].to_numpy()
            for at, n, rows, terms, tf in chunks(batch, asked):
                part = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at + rows] / mean))
                scores, hits = asked.spread(rows, terms, [part, np.ones(len(tf))], n)
                r, q = np.nonzero(hits)
                leaders.add(q, -np.round(scores[r, q], 9), ids[at + r], scores[r, q])
        if rows := leaders.first():
            q, _, doc, score = rows
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(doc, mask=doc == -(1 << 63)), pa.array(score)], names=["request_id", "doc_id", "score"])

    return best(found.select("doc_id", "dl", "terms", "counts").mapInArrow(run, "request_id long, doc_id long, score double"), k)


def best(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each request. Scores are sums in no set order, so they are compared to nine digits."""
    by = W.partitionBy("request_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def vector_blocks(asked: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of queries (request_id, vector) in blocks of ``most`` by length of
    vector; they pass the driver one by one. Null vectors, and those of no length, are left out."""
    held: dict[int, list] = {}
    for r in asked.filter("request_id IS NOT NULL AND vector IS NOT NULL").toLocalIterator():
        v = np.array([np.nan if x is None else x for x in r["vector"]], np.float64)
        if np.isfinite(v).all() and v.any():
            rows = held.setdefault(len(v), [])
            rows.append((r["request_id"], v / math.sqrt(v @ v)))
            if len(rows) >= most:
                yield packed(held.pop(len(v)))
    yield from map(packed, held.values())


def packed(rows: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows])


def cosine(vectors: DataFrame, asked: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """(request_id, doc_id, score, rank) by cosine; ``asked`` (request_id, vector) is the
    stated set of queries, met with all vectors (doc_id, vector) in blocks of ``block``.

    A task multiplies its vectors with a block's and keeps ``k`` rows for each query, so no
    more than that is shuffled for each query and task. Only vectors of equal length meet;
    null ones, and those without a length, take no part.
    """
    sc, parts = vectors.sparkSession.sparkContext, []
    for ids, units in vector_blocks(asked, block):
        sent = sc.broadcast((ids, units))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            (ids, units), leaders = sent.value, Leaders(k)
            for batch in batches:
                docs = least_first(batch["doc_id"])
                x = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                length = np.sqrt((x * x).sum(axis=1))
                fine = np.flatnonzero(np.isfinite(length) & (length > 0))
                for at in range(0, len(fine), CHUNK):
                    rows = fine[at : at + CHUNK]
                    scores = ((x[rows] / length[rows, None]) @ units.T).T
                    ordered = np.round(scores, 9)
                    least = np.partition(ordered, -k, axis=1)[:, -k :][:, :1] if len(rows) > k else -np.inf
                    q, r = np.nonzero(ordered >= least)
                    leaders.add(q, -ordered[q, r], docs[rows][r], scores[q, r])
            if kept := leaders.first():
                q, _, doc, score = kept
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(doc, mask=doc == -(1 << 63)), pa.array(score)], names=["request_id", "doc_id", "score"])

        same = vectors.filter((F.size("vector") == units.shape[1]) & ~F.exists("vector", F.isnull))
        rows = same.select(F.col("doc_id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "request_id long, doc_id long, score double")
        parts.append(best(rows, k))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "request_id long, doc_id long, score double, rank int")
    return reduce(DataFrame.unionByName, parts)
