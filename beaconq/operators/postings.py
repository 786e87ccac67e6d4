"""An inverted index in a bucketed table, and BM25 over it that leaves out what cannot win.

Documents are put in order (by language and length, say) and cut to chunks of a few thousand
and ranges of a few, so that those of a range are alike. A row of the table is a term's
postings in a chunk, packed: places and counts, and for each range the largest share of a
score that any of its documents has. Rows are made where the documents of a chunk lie, so
no posting is shuffled for them. The table is bucketed and sorted by term; the row of the
empty term, which no text has, lists a chunk's documents.

A search brings the rows of asked terms together by chunk, once for all queries. In a chunk
a query is answered in two rounds: the sums of largest shares bound what a range can give;
the ranges of the highest bounds are scored first, and their k-th score is what any other
range's bound has to reach to be scored. Each chunk gives its k best. Results are exact.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconq.functions import text as T
from beaconq.operators.retrieve import B, K1, Asked, Leaders, best, blocks, least_first, written
from beaconq.session import shared_path

RANGE = 4
#: Documents of a chunk (places are kept in 16 bits) and about how many postings it may have.
CHUNK, MOST_POSTINGS = 4096, 2_000_000
#: Documents whose words are held as Python's at once.
COUNTED = 256
#: Ranges that are scored first, for each result that is wanted.
SEEDS = 2
#: Scores are compared to nine digits; bounds are let be short by more than that.
SLACK = 1e-8
#: Scores that are held at once for a chunk: its documents times so many queries.
CELLS = 100_000
POSTING = np.dtype([("at", "<u2"), ("tf", "<u4")])
DOCUMENT = np.dtype([("id", "<i8"), ("dl", "<u4")])


def counted(docs: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, order, dl, terms, counts): each document's distinct words and how often they occur."""
    names = ["doc_id", *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, COUNTED) for b in batches for at in range(0, b.num_rows, COUNTED)):
            words = batch["words"].to_pylist()
            found = [Counter(w) for w in words]
            columns = [pa.array([len(w) for w in words], pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *columns], names=[*names, "dl", "terms", "counts"])

    rows = docs.select(*names, T.words(F.col("text")).alias("words"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "words")
    return rows.mapInArrow(run, f"{kinds}, dl long, terms array<string>, counts array<int>")


def share(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    """A posting's share of a score, but for the weight of its term."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array, from each end to the next, as binary values."""
    offsets = (ends * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def packed_rows(docs: pa.RecordBatch, size: int, mean: float) -> Iterator[pa.RecordBatch]:
    """A chunk's rows of the index, from its counted documents in their order."""
    names = ["term", "chunk", "held", "postings", "most"]
    dl, terms = docs["dl"].to_numpy(), docs["terms"].flatten().dictionary_encode()
    chunk, words = docs["place"][0].as_py(), len(terms.dictionary)
    listed = np.empty(len(dl), DOCUMENT)
    listed["id"], listed["dl"] = least_first(docs["doc_id"]), dl
    yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([chunk]), pa.array([0], pa.int32()), packed(listed, np.array([0, len(dl)])), pa.array([b""])], names=names)
    if words:
        codes = terms.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        posted = np.empty(len(codes), POSTING)
        posted["at"] = np.repeat(np.arange(len(dl)), np.diff(docs["terms"].offsets.to_numpy()))[order]
        posted["tf"] = docs["counts"].flatten().to_numpy()[order]
        ends, begins = np.searchsorted(codes, np.arange(words + 1)), block_begins(codes, posted["at"], size)
        most = np.maximum.reduceat(share(posted["tf"].astype(np.float64), dl[posted["at"]], mean), begins)
        most = np.nextafter(most.astype(np.float32), np.float32(np.inf))
        held = pa.array(np.diff(ends).astype(np.int32))
        yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(np.full(words, chunk)), held, packed(posted, ends), packed(most, np.searchsorted(codes[begins], np.arange(words + 1)))], names=names)


def block_begins(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Where blocks begin among postings by term and place."""
    ranges = at // size
    return np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (ranges[1:] != ranges[:-1])]))


def repeated(begins: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Numbers from each begin on, as many as are told."""
    ends = np.cumsum(times)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times) + np.repeat(begins, times)


def chunk_best(rows: pa.Table, asked: Asked, idf: np.ndarray, mean: float, size: int, k: int) -> tuple[list[np.ndarray], int, int]:
    """Of a chunk's rows of asked terms (number, postings, most): each query's ``k`` best as
    (query, id, score), and how many postings of how many that match were scored for them."""
    numbers, raw = rows["number"].to_pylist(), rows["postings"].to_pylist()
    here = numbers.index(-1)
    listed = np.frombuffer(raw.pop(here), DOCUMENT)
    most = np.frombuffer(b"".join(m for n, m in zip(numbers, rows["most"].to_pylist()) if n >= 0), np.float32)
    numbers.pop(here)
    found, scored, matching = [], 0, 0
    if numbers:
        posted = np.frombuffer(b"".join(raw), POSTING)
        terms = np.repeat(np.array(numbers), [len(r) // POSTING.itemsize for r in raw])
        at = posted["at"].astype(np.int64)
        begins = block_begins(terms, at, size)
        lengths = np.diff(np.append(begins, len(at)))
        part = idf[terms] * share(posted["tf"].astype(np.float64), listed["dl"][at], mean)
        term, place, bound = terms[begins], at[begins] // size, idf[terms[begins]] * most
        ranges, step = int(place.max()) + 1, max(1, CELLS // len(listed))
        for low in range(0, len(asked.ids), step):
            queries = min(step, len(asked.ids) - low)
            some = asked.part(low, low + queries)
            times = some.starts[term + 1] - some.starts[term]
            block, query = np.repeat(np.arange(len(term)), times), some.holders[repeated(some.starts[term], times)]
            bounds = np.bincount(place[block] * queries + query, bound[block], ranges * queries).reshape(ranges, queries)
            wanted = np.zeros(bounds.shape, bool)
            if ranges > SEEDS * k:
                first = np.argpartition(-bounds, SEEDS * k - 1, axis=0)[: SEEDS * k]
                np.put_along_axis(wanted, first, True, axis=0)
            else:
                wanted[:] = True
            scores, hits = np.zeros(len(listed) * queries), np.zeros(len(listed) * queries)

            def score(wanted: np.ndarray) -> int:
                kept = wanted[place[block], query]
                times = lengths[block[kept]]
                each = repeated(begins[block[kept]], times)
                cells = at[each] * queries + np.repeat(query[kept], times)
                scores[:] += np.bincount(cells, part[each], len(scores))
                hits[:] += np.bincount(cells, minlength=len(scores))
                return len(each)

            scored += score(wanted)
            table = np.where(hits > 0, scores, -np.inf).reshape(len(listed), queries)
            least = np.partition(table, -k, axis=0)[-k] if len(table) >= k else np.full(queries, -np.inf)
            scored += score((bounds >= least - SLACK) & ~wanted)
            matching += int(lengths[block].sum())
            at_doc, q = np.nonzero(hits.reshape(-1, queries))
            leaders, got = Leaders(k), scores.reshape(-1, queries)[at_doc, q]
            leaders.add(q, -np.round(got, 9), listed["id"][at_doc], got)
            q, _, doc, got = leaders.first()
            found.append((asked.ids[low + q], doc, got))
    empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return [np.concatenate(c) for c in zip(empty, *found)], scored, matching


class Index:
    def __init__(self, docs: DataFrame, order: list[str], buckets: int = 16, size: int = RANGE, chunk: int = CHUNK) -> None:
        """Index (doc_id, text, order): ``order`` names the columns that alike documents share."""
        self.spark: SparkSession = docs.sparkSession
        tag = uuid.uuid4().hex
        self.name, self.path, self.docs_path, self.size = f"postings_{tag}", shared_path(self.spark, "postings"), shared_path(self.spark, "counted"), size
        counted(docs, order).write.parquet(self.docs_path)
        held = self.spark.read.parquet(self.docs_path)
        self.n, words = held.agg(F.count("*"), F.sum("dl")).first()
        self.mean = mean = (words or 0) / self.n if self.n and words else 1.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ends, at = batch["terms"].offsets.to_numpy(), 0
                while at < batch.num_rows:
                    n = max(1, min(chunk, int(np.searchsorted(ends, ends[at] + MOST_POSTINGS, "right")) - 1 - at))
                    yield from packed_rows(batch.slice(at, n), size, mean)
                    at += n

        placed = held.repartitionByRange(*[F.col(c) for c in order], "dl").sortWithinPartitions(*order, "dl", "doc_id")
        placed = placed.select(F.col("doc_id").cast("long").alias("doc_id"), "dl", "terms", "counts", F.monotonically_increasing_id().alias("place"))
        rows = placed.mapInArrow(run, "term string, chunk long, held int, postings binary, most binary")
        rows.write.bucketBy(buckets, "term").sortBy("term", "chunk").option("path", self.path).format("parquet").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(request_id, doc_id, score, rank): the k best of each query (request_id, query)."""
        self.found = [self.answered(asked, k) for asked in blocks(queries)]
        if not self.found:
            return self.spark.createDataFrame([], "request_id long, doc_id long, score double, rank int")
        rows = reduce(DataFrame.unionByName, self.found)
        return best(rows.filter("scored IS NULL").select("request_id", "doc_id", "score"), k)

    def answered(self, asked: Asked, k: int) -> DataFrame:
        """(request_id, doc_id, score) of the k best of each chunk for each query of a block,
        and for each chunk a row of (scored, matching): postings scored, and those that match."""
        terms = pa.table({"term": pa.array([*asked.terms, ""], pa.string()), "number": pa.array([*range(len(asked.terms)), -1], pa.int32())})
        held = self.rows().join(F.broadcast(self.spark.createDataFrame(terms)), "term")
        df = np.zeros(len(asked.terms))
        for r in held.filter("number >= 0").groupBy("number").agg(F.sum("held").alias("n")).collect():
            df[r["number"]] = r["n"]
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        sent, mean, size = self.spark.sparkContext.broadcast((asked, idf)), self.mean, self.size

        def run(rows: pa.Table) -> pa.Table:
            (ids, docs, scores), scored, matching = chunk_best(rows, *sent.value, mean, size, k)
            none, n = pa.nulls(1, pa.int64()), len(ids)
            columns = {"request_id": ids, "doc_id": pa.array(docs, mask=docs == -(1 << 63)), "score": scores, "scored": pa.nulls(n, pa.int64()), "matching": pa.nulls(n, pa.int64())}
            told = {"request_id": none, "doc_id": none, "score": pa.nulls(1, pa.float64()), "scored": [scored], "matching": [matching]}
            return pa.concat_tables([pa.table(columns), pa.table(told)])

        each = held.select("chunk", "number", "postings", "most").groupBy("chunk").applyInArrow(run, "request_id long, doc_id long, score double, scored long, matching long")
        return written(each, "found")

    def reading(self) -> tuple[int, int]:
        """After a search: postings of the blocks that were scored, and of all that match."""
        rows = reduce(DataFrame.unionByName, self.found).agg(F.sum("scored"), F.sum("matching")).first() if self.found else (0, 0)
        return rows[0] or 0, rows[1] or 0

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
