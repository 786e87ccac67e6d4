"""Media columns in a store of content-defined chunks.

Method: a rolling gear hash cuts payloads where their content says so; chunks are
known by their SHA-256. An anti-join drops those that an earlier store holds, and an
aggregation, which lets every task drop its own repeats before the shuffle, those of
the run. A payload is kept as an ordered list of chunk digests. Reading joins the list
to the store, puts the chunks together in order, and verifies every chunk and the
payload by digest.

A payload is a run of unsigned 8-bit mono samples, padded to whole frames. Chunk
bytes are compressed (bzip2, the smallest for chunks of prose) before they are shuffled. Equal payloads are stored, read and
verified once.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import attach, delete_path, freed_shuffles, map_batches, materialize, shared_path, table

FRAME = 192
PAD = b"\x20"
LEAST, MOST = 2048, 32768
#: A cut where the top bits of the hash are zero: every 8192 bytes on average.
CUT_BITS = 13
WINDOW = 32
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
MAGIC = b"CDC1"
#: Text in a bucket of the store, at most, give or take the spread of digests.
BUCKET_BYTES = 256 << 20


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text before padding, and its payload of whole frames, one at least."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + PAD * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw))


def cut(payload: bytes) -> list[bytes]:
    """Chunks of ``LEAST`` to ``MOST`` bytes (the last may be shorter), in order.

    The hash at a byte covers the 32 bytes up to it: each gear value shifted by its
    age. Windows are doubled five times, so the work is in numpy.
    """
    n = len(payload)
    if n <= LEAST:
        return [payload]
    h = GEAR[np.frombuffer(payload, np.uint8)]
    width = 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    ends = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    chunks, start = [], 0
    while n - start > LEAST:
        k = np.searchsorted(ends, start + LEAST)
        end = min(int(ends[k]) if k < len(ends) else n, start + MOST, n)
        chunks.append(payload[start:end])
        start = end
    if start < n:
        chunks.append(payload[start:])
    return chunks


def listed(docs: DataFrame) -> DataFrame:
    """The ordered chunk list of each document, without chunk bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [payload_of(t) for t in batch["text"].to_pylist()]
            chunks = [cut(p) for _, p in found]
            yield {
                "doc_id": batch["doc_id"],
                "n_bytes": [n for n, _ in found],
                "payload": [hashlib.sha256(p).digest() for _, p in found],
                "digests": [[hashlib.sha256(c).digest() for c in cs] for cs in chunks],
            }

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id long, n_bytes long, payload binary, digests array<binary>")


class Store:
    """Chunks (digest, size, frame), each once, in buckets of their digest, so that
    reading them needs no second shuffle of the bytes."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.name, self.path = spark, f"chunks_{uuid.uuid4().hex}", shared_path(spark, "chunks")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def store_chunks(docs: DataFrame, n_bytes: int = 0, known: DataFrame | None = None) -> Store:
    """Write each distinct chunk once, but for those whose ``digest`` is in ``known``.
    ``n_bytes``, the size of all texts, sets the least number of buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = {}
            for text in batch["text"].drop_duplicates():
                for c in cut(payload_of(text)[1]):
                    new.setdefault(hashlib.sha256(c).digest(), c)
            yield pd.DataFrame({"digest": list(new), "size": [len(c) for c in new.values()], "frame": [bz2.compress(c) for c in new.values()]})

    spark = docs.sparkSession
    chunks = docs.select(F.col("text").cast("string")).mapInPandas(run, "digest binary, size int, frame binary")
    distinct = chunks.dropDuplicates(["digest"])
    if known is not None:
        distinct = distinct.join(known.select("digest"), "digest", "left_anti")
    store = Store(spark)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    with freed_shuffles(spark):
        distinct.write.bucketBy(buckets, "digest").option("path", store.path).format("parquet").saveAsTable(store.name)
    return store


def read_back(payloads: DataFrame, store: DataFrame) -> DataFrame:
    """Rebuild and verify each payload of (payload, digests, copies) from the chunks of
    ``store``; see ``FEATURES`` for what is worked out from the bytes. An altered chunk
    fails the job, and so does a lost one, by the payload's digest."""
    lists = payloads.select("payload", "copies", F.posexplode("digests").alias("seq", "digest"))
    uses = lists.groupBy("digest").agg(F.count("*").alias("uses"))
    # A chunk in over 1/1000 of all lists is one of fewer than 1000, of at most MOST bytes each.
    total = lists.count()
    hot = uses.filter(F.col("uses") > max(1000, total // 1000)).select("digest")
    hot_chunks = F.broadcast(materialize(hot.join(store.select("digest", "size", "frame"), "digest"), "hot-chunks"))
    rest = lists.join(F.broadcast(hot_chunks.select("digest")), "digest", "left_anti").join(store, "digest", "left")
    parts = rest.unionByName(lists.join(hot_chunks, "digest"))
    whole = parts.groupBy("payload", "copies").agg(F.sort_array(F.collect_list(F.struct("seq", "digest", "size", "frame"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, n, *rebuilt(key, parts)) for key, n, parts in zip(batch["payload"], batch["copies"], batch["parts"])]
            yield pd.DataFrame(rows, columns=["payload", "copies", *FEATURES])

    return whole.mapInPandas(run, "payload binary, copies long, " + ", ".join(f"{k} {v}" for k, v in FEATURES.items()))


FEATURES = {
    "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long",
    "media_bytes": "long", "media_sha256": "string", "feature": "string",
}


def rebuilt(key: bytes, parts) -> tuple:
    """What is read back from one stored payload. Its stored form is the chunk list
    (format, number of chunks, then size and digest of each) and the chunks' frames."""
    listing, frames, chunks = [MAGIC + struct.pack("<HBI", 8000, 8, len(parts))], [], []
    for p in parts:
        if p["frame"] is None:
            raise ValueError("a chunk is not in the store")
        chunk = bz2.decompress(p["frame"])
        if hashlib.sha256(chunk).digest() != bytes(p["digest"]):
            raise ValueError("a stored chunk does not match its digest")
        listing.append(struct.pack("<II", p["size"], len(p["frame"])) + p["digest"])
        frames.append(p["frame"])
        chunks.append(chunk)
    payload, media = b"".join(chunks), b"".join(listing + frames)
    if hashlib.sha256(payload).digest() != bytes(key):
        raise ValueError("a payload does not match its digest")
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(samples >= 0)))
    feature = f"frames={len(payload) // FRAME};sum={samples.sum()};energy={(samples * samples).sum()};crossings={crossings}"
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
        len(media), hashlib.sha256(media).hexdigest(), feature,
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as media, read it back, and give each row what was read.

    A null or empty text is one frame of padding. Null and repeated ids keep one row
    each. Equal texts share one stored payload. An empty table gives no rows; other
    columns are not read.
    """
    lists = materialize(listed(docs), "chunk-lists")
    store = store_chunks(docs, lists.agg(F.sum("n_bytes")).first()[0] or 0)
    payloads = lists.groupBy("payload").agg(F.first("digests").alias("digests"), F.count("*").alias("copies"))
    try:
        features = materialize(read_back(payloads, store.rows()), "media-features")
    finally:
        store.drop()
    return attach(lists.select("doc_id", "n_bytes", "payload"), features, "payload", "copies").select("doc_id", "n_bytes", *FEATURES)


def op3_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
