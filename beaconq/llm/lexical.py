"""Ranked lexical search over an impact-ordered index, score at a time.

Method: documents are dealt to shards of bounded size as they are read, and each shard's
postings are written as rows (shard, term, document places, counts). When a block of
queries is asked, a shard's lists of the block's terms meet in one group, where each list
is put in descending order of exact impact (the part of a posting's score that does not
depend on the query). A query takes the postings of its terms in descending order of what
they add, whole groups of equal value at a time. It stops only when the bounds of what is
left prove that no document of the shard but a few can be among its first k; the scores
of those few are then completed from the lists. The shards' results are merged by rank.

Scores are 64-bit integers throughout, so they do not depend on order or shards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import delete_path, map_batches, materialize, table

K = 20
#: A shard is closed at so many documents (their places take 16 bits) or postings.
SHARD_DOCS = 1 << 16
SHARD_POSTINGS = 2_000_000
#: Queries are asked in blocks of about so many terms, which are sent to all tasks.
BLOCK_TERMS = 100_000
#: Postings taken before the bounds are tried; doubled each time.
FIRST_STEP = 4096
#: Scores are completed once the first k are known to be among so many times k documents.
COMPLETED = 32
#: Buckets of shards in which results are merged first.
MERGE_BUCKETS = 64
INDEX = "shard long, term binary, places binary, counts binary, df long"

#: ASCII without digits and letters separates terms; A-Z are lower-cased; bytes of other characters stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def document_factors(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document; with Python's numbers where 64 bits would not hold the product."""
    if not total:
        return np.full(len(lengths), 75, np.int64)
    wide = lengths.astype(object) if len(lengths) and 25 * int(lengths.max()) * n >= 1 << 62 else lengths
    return (75 + 25 * wide * n // total).astype(np.int64)


def impacts(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 12 * factors)


class Index:
    """Postings and lengths of all documents, as two tables that share their shards."""

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> None:
        self.spark: SparkSession = docs.sparkSession
        rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col("text").cast("string").cast("binary").alias("text"))
        written = materialize(map_batches(rows, lambda batches: sharded(batches, shard_docs, shard_postings), f"{INDEX}, docs array<long>, lengths array<long>"), "postings")
        self.path = written.shared_path
        self.postings = written.filter("term IS NOT NULL").select("shard", "term", "places", "counts", "df")
        self.lengths = self.spark.read.schema(written.schema).parquet(self.path).filter("term IS NULL").select("shard", "docs", "lengths")

    def totals(self) -> tuple[int, int]:
        """Documents with a term, and all terms."""
        n = F.size(F.filter("lengths", lambda x: x > 0)).cast("long")
        added = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
        found = self.lengths.select(n.alias("n"), added.alias("l")).agg(F.sum("n"), F.sum("l")).first()
        return found[0] or 0, found[1] or 0

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def sharded(batches: Iterator[pa.RecordBatch], shard_docs: int, shard_postings: int) -> Iterator[dict]:
    """Rows of shards: one for each term, and one without a term that holds the documents."""
    task, nth = TaskContext.get(), 0
    part = task.partitionId() if task else 0

    class Shard:
        def __init__(self) -> None:
            self.docs, self.lengths, self.vocabulary = [], [], {}
            self.ids, self.counts, self.sizes, self.n = [], [], [], 0

    def rows(s: Shard, shard: int) -> dict:
        ids, counts = (np.fromiter((x for xs in got for x in xs), np.uint32, s.n) for got in (s.ids, s.counts))
        places = np.repeat(np.arange(len(s.docs), dtype=np.uint16), s.sizes)
        order = np.argsort(ids, kind="stable")
        places, counts = places[order].astype("<u2"), counts[order].astype("<u4")
        df = np.bincount(ids, minlength=len(s.vocabulary))
        ends = np.cumsum(df).tolist()
        starts = [0, *ends[:-1]]
        p, c, k = places.tobytes(), counts.tobytes(), len(s.vocabulary)
        return {
            "shard": [shard] * (k + 1),
            "term": [*s.vocabulary, None],
            "places": [*(p[2 * a : 2 * b] for a, b in zip(starts, ends)), None],
            "counts": [*(c[4 * a : 4 * b] for a, b in zip(starts, ends)), None],
            "df": [*df.tolist(), None],
            "docs": [None] * k + [s.docs],
            "lengths": [None] * k + [s.lengths],
        }

    s = Shard()
    for batch in batches:
        for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
            terms = terms_of(text)
            found = Counter(terms)
            known = s.vocabulary
            s.docs.append(doc)
            s.lengths.append(len(terms))
            s.sizes.append(len(found))
            s.ids.append([known.setdefault(t, len(known)) for t in found])
            s.counts.append(found.values())
            s.n += len(found)
            if len(s.docs) >= shard_docs or s.n >= shard_postings:
                yield rows(s, part << 32 | nth)
                s, nth = Shard(), nth + 1
    if s.docs:
        yield rows(s, part << 32 | nth)


class Lists:
    """The lists of one shard, by term: places by document, and by falling impact."""

    def __init__(self, factors: np.ndarray) -> None:
        self.factors, self.n = factors, len(factors)
        self.by_place: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.by_impact: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, term: bytes, places: np.ndarray, counts: np.ndarray) -> None:
        found = impacts(counts, self.factors[places])
        order = np.argsort(-found, kind="stable")
        self.by_place[term] = places, found
        self.by_impact[term] = places[order], found[order]

    def first(self, query: list[tuple[bytes, int]], k: int, step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of documents of which the first k by score are some, all that
        are equal to the k-th included, and the number of postings that were taken."""
        held = [(t, w) for t, w in query if w > 0 and t in self.by_impact]
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        gains = [w * self.by_impact[t][1] for t, w in held]
        values, places = np.concatenate(gains), np.concatenate([self.by_impact[t][0] for t, _ in held])
        order = np.argsort(-values, kind="stable")
        values, places = values[order], places[order]
        falling = -values
        scores, at = np.zeros(self.n, np.int64), 0
        while at < len(values):
            end = min(at + step, len(values))
            end = int(np.searchsorted(falling, falling[end - 1], side="right"))
            np.add.at(scores, places[at:end], values[at:end])
            at, step = end, 2 * step
            if at == len(values) or self.n <= k:
                continue
            least = np.partition(scores, -k)[-k]
            more = sum(int(g[p]) for g in gains if (p := np.searchsorted(-g, falling[at - 1], side="right")) < len(g))
            likely = np.flatnonzero(scores + more >= least)
            if len(likely) <= COMPLETED * k:
                return likely, self.completed(held, likely), at
        least = max(1, np.partition(scores, -k)[-k]) if self.n > k else 1
        likely = np.flatnonzero(scores >= least)
        return likely, scores[likely], at

    def completed(self, held: list[tuple[bytes, int]], at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for term, weight in held:
            places, found = self.by_place[term]
            k = np.minimum(np.searchsorted(places, at), len(places) - 1)
            out += np.where(places[k] == at, weight * found[k], 0)
        return out


def answer(index: Index, block: list[tuple[int, object, Counter]], totals: tuple[int, int], k: int) -> DataFrame:
    """(query, doc, score): each query's first k of each shard."""
    spark, (n, total) = index.spark, totals
    terms = sorted({t for _, _, found in block for t in found})
    asked = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    held = index.postings.join(F.broadcast(asked), "term", "left_semi")
    df = {bytes(r["term"]): r["df"] for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    queries = [(q, [(t, times * term_weight(n, df[t])) for t, times in found.items() if t in df]) for q, _, found in block]
    sent = spark.sparkContext.broadcast(queries)
    out = pa.schema([("query", pa.int64()), ("shard", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(key: tuple, postings: pa.Table, lengths: pa.Table) -> pa.Table:
        docs = lengths["docs"].combine_chunks().flatten()
        lists = Lists(document_factors(lengths["lengths"].combine_chunks().flatten().to_numpy(), n, total))
        for term, places, counts in zip(postings["term"].to_pylist(), postings["places"].to_pylist(), postings["counts"].to_pylist()):
            lists.add(term, np.frombuffer(places, "<u2").astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64))
        absent = docs.is_null().to_numpy(zero_copy_only=False)
        ids = docs.fill_null(0).to_numpy()
        qs, ds, ss = [], [], []
        for q, query in sent.value:
            places, scores, _ = lists.first(query, k)
            first = np.lexsort((ids[places], absent[places], -scores))[:k]
            qs += [q] * len(first)
            ds.append(places[first])
            ss.append(scores[first])
        at = np.concatenate(ds) if ds else np.zeros(0, np.int64)
        score = np.concatenate(ss) if ss else at
        shard = pa.array([key[0].as_py()] * len(qs), pa.int64())
        return pa.Table.from_arrays([pa.array(qs, pa.int64()), shard, docs.take(pa.array(at)), pa.array(score)], schema=out)

    left, right = held.select("shard", "term", "places", "counts").groupBy("shard"), index.lengths.groupBy("shard")
    return left.cogroup(right).applyInArrow(run, "query long, shard long, doc long, score long")


def merged(found: DataFrame, k: int) -> DataFrame:
    """Each query's first k: first within buckets of shards, then of all."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    bucket = F.pmod(F.xxhash64("shard"), F.lit(MERGE_BUCKETS))
    near = found.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(W.partitionBy("query", "bucket").orderBy(*order)))
    return near.filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)


def blocks(queries: DataFrame, id_column: str, most: int) -> Iterator[list[tuple[int, object, Counter]]]:
    """Queries in blocks of about ``most`` terms, numbered; they pass the driver one by one."""
    block, size = [], 0
    rows = queries.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    for k, row in enumerate(rows.toLocalIterator()):
        found = Counter(terms_of(bytes(row["text"]) if row["text"] is not None else None))
        if not found:
            continue
        if block and size + len(found) > most:
            yield block
            block, size = [], 0
        block.append((k, row["id"], found))
        size += len(found)
    if block:
        yield block


def search(index: Index, queries: DataFrame, k: int = K, id_column: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest scores above 0.

    Equal scores are in ascending order of doc_id, null last. A query without a term,
    such as a null text, has no rows; rows of queries that share an id are asked each
    for itself, also those without an id. A null document text has no terms; repeated
    documents are ranked each. Empty tables give no rows. Queries of any number are
    asked in blocks; a single one may be larger than a block.
    """
    spark, totals, parts = index.spark, index.totals(), []
    for block in blocks(queries, id_column, block_terms):
        names = spark.createDataFrame([(q, i) for q, i, _ in block], f"query long, {id_column} long")
        found = merged(answer(index, block, totals, k), k).join(F.broadcast(names), "query")
        parts.append(materialize(found.select(id_column, F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"), "ranked"))
    if not parts:
        return spark.createDataFrame([], f"{id_column} long, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op12_lexical(spark, sf_dir: str) -> DataFrame:
    index = Index(table(spark, sf_dir, "documents"))
    try:
        return search(index, table(spark, sf_dir, "benchmark"))
    finally:
        index.drop()


def sql() -> str:
    """The same for DuckDB: every posting of every query's terms, summed and ranked."""
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '{term}') AS t FROM documents),
    size AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d),
    postings AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term),
    weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, size GROUP BY term, n),
    q AS (SELECT item_id, unnest(regexp_extract_all({lower("coalesce(text, '')")}, '{term}')) AS term FROM benchmark),
    m AS (SELECT rid, doc_id, 75 + (25 * len(t)::BIGINT * n) // l AS m FROM d, size WHERE l > 0),
    scored AS (
      SELECT item_id, doc_id, rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL) JOIN postings USING (term) JOIN weights USING (term) JOIN m USING (rid)
      GROUP BY item_id, doc_id, rid
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
    QUALIFY rank <= 20
    """
