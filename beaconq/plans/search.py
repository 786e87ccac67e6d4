"""The search over many requests: provider lists to ranked answers."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from beaconq.functions import text as T
from beaconq.operators import merge, rank, retrieve

#: Providers emulated over the stored corpus: id, place in the catalogue, weight, order.
RANKERS = [("tf", 0, 1.0), ("coverage", 1, 1.25), ("quality", 2, 0.9)]
LIST_SIZE = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table of texts. A table in fewer splits than there are cores (a small
    one, of few row groups) is spread over them; any other is read as it lies."""
    rows, cores = read(spark, sf_dir, name).select(*columns), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, query): each benchmark item, whole, as a request."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("query"))


def coverages(queries: DataFrame, docs: DataFrame, block: int = 256) -> DataFrame:
    """(request_id, doc_id, coverage) for each query with every document, zero included.

    ``queries`` (request_id, query) is the stated set, asked in bounded blocks; ``docs``
    (doc_id, text) is met in one pass for each without a shuffle, ``block`` rows at a time. A
    word of a document stands for the terms that it equals or, from four characters on,
    continues.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.array_distinct(T.words(F.col("text"))).alias("words"))
    parts = [_covered(rows, asked, block) for asked in retrieve.blocks(queries)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "request_id long, doc_id long, coverage double")
    return functools.reduce(DataFrame.unionByName, parts)


def _covered(rows: DataFrame, asked: retrieve.Asked, block: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        number = {t: k for k, t in enumerate(asked.terms)}
        sizes = np.maximum(asked.sizes, 1).astype(np.float64)

        @functools.lru_cache(1 << 18)
        def terms(word: str) -> tuple[int, ...]:
            return tuple(number[t] for t in [*(word[:n] for n in range(4, len(word))), word] if t in number)

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                found = [sorted({t for w in words or () for t in terms(w)}) for words in part["words"].to_pylist()]
                at_row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                flat = np.array([t for f in found for t in f], np.int64)
                counts = asked.spread(at_row, flat, [np.ones(len(flat))], len(found))[0]
                ids = part["doc_id"].take(pa.array(np.repeat(np.arange(len(found)), len(sizes))))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(asked.ids, len(found))), ids, pa.array((counts / sizes).ravel())], names=["request_id", "doc_id", "coverage"])

    return rows.mapInArrow(run, "request_id long, doc_id long, coverage double")


def found_terms(spark: SparkSession, sf_dir: str, asked: retrieve.Asked) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    return retrieve.occurrences(docs, asked, ["n_chars"])


def provider_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three providers' lists for each benchmark query, 20 results each at most.

    Documents are read and cut to words once for each block of queries; only which of the
    asked terms they have is joined to the labels, and each task keeps the first 20. It is
    written in between: in one stage, a task would have three Python workers at once.
    """
    asked = list(retrieve.blocks(benchmark_queries(spark, sf_dir)))
    return functools.reduce(DataFrame.unionByName, [lists_of(spark, sf_dir, retrieve.written(found_terms(spark, sf_dir, a), "occurrences"), a) for a in asked])


def lists_of(spark: SparkSession, sf_dir: str, found: DataFrame, asked: retrieve.Asked) -> DataFrame:
    good = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(1).alias("good")).distinct()
    tops = retrieve.listed_tops(found.join(good, "doc_id", "left"), asked, LIST_SIZE)
    by = W.partitionBy("request_id", "list").orderBy("k1", "k2", "doc_id")
    rows = tops.withColumn("position", F.row_number().over(by)).filter(F.col("position") <= LIST_SIZE)
    place = F.create_map(*[x for n, o, w in RANKERS for x in (F.lit(n), F.struct(F.lit(o).alias("ordinal"), F.lit(w).alias("weight")))])
    return rows.select("request_id", "doc_id", F.col("list").alias("engine_id"), place[F.col("list")]["ordinal"].alias("ordinal"), place[F.col("list")]["weight"].alias("weight"), "position")


def provider_results(spark: SparkSession, sf_dir: str, lists: DataFrame | None = None) -> DataFrame:
    """Lists with the fields that providers return; each provider tags its URLs its own way."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    words = F.split("text", " ")
    rows = docs.join(provider_lists(spark, sf_dir) if lists is None else lists, "doc_id")
    return rows.select(
        "request_id", "engine_id", "ordinal", "weight", "position",
        F.concat(F.lit("https://"), "source", F.lit(".example.org/d/"), F.col("doc_id").cast("string"), F.lit("?utm_source="), "engine_id", F.lit("#e")).alias("url"),
        F.array_join(F.slice(words, 1, 8), " ").alias("title"), F.col("text").alias("content"),
        F.concat((F.lit(1990) + F.col("doc_id") % 35).cast("string"), F.lit("-06")).alias("published_at"),
        F.to_json(F.struct(F.col("doc_id"), F.col("engine_id").alias("list"))).alias("metadata"),
    )


def merged(spark: SparkSession, sf_dir: str, lists: DataFrame | None = None) -> DataFrame:
    return merge.dedup(merge.whole_engines(merge.normalized(merge.capped(provider_results(spark, sf_dir, lists)))))


def provider_and_index(spark: SparkSession, sf_dir: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The provider lists and the index's list, from occurrences that are found and written once."""
    lists, index = [], []
    for asked in retrieve.blocks(benchmark_queries(spark, sf_dir)):
        found = retrieve.written(found_terms(spark, sf_dir, asked), "occurrences")
        lists.append(lists_of(spark, sf_dir, found, asked))
        index.append(retrieve.bm25_block(found, asked, k))
    return functools.reduce(DataFrame.unionByName, lists), functools.reduce(DataFrame.unionByName, index)


def search(spark: SparkSession, sf_dir: str, strategy: str = "query-aware-v1", limit: int = 10) -> DataFrame:
    """Ranked answers for all benchmark queries in one job."""
    rows = rank.top(rank.scored(merged(spark, sf_dir), strategy, benchmark_queries(spark, sf_dir)), limit)
    return rows.select("request_id", "rank", "canonical_url", F.round("score", 6).alias("score"), F.size("engines").alias("n_engines"))
