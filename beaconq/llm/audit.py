"""Audit of how filters interact: what each removes after every choice of others.

Method: a packed bitmap index. In each partition the rows of a part stand next to each
other, padded to whole 64-bit words, and every filter and label is a NumPy bitset over
them. For each subset of filters the bitset of what it keeps is that of a smaller subset
AND-NOT one more filter; its popcounts by part are summed over the partitions. The 32
sums of a part are all that orders, steps and Shapley shares need: what filter f removes
after the filters S is kept(S) - kept(S + f).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import attach, map_batches, materialize, table

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_CAPITALS = 5
SIGNS = b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that start no character.
FOLLOWING = bytes(range(0x80, 0xC0))
LABELS = ["good", "toxic"]
#: Parts whose sums a task keeps before it gives them out.
PARTS_KEPT = 20_000
SUBSETS = 1 << len(FILTERS)


def failed(raw: bytes) -> int:
    """Bits of the filters A to D that the text fails. ``bytes.split`` without an argument
    splits at the bytes 20 and 09-0D, so its words are the contract's."""
    words = raw.split()
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (
        (n < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1
        | (100 * capitals > MOST_CAPITALS * len(raw.translate(None, FOLLOWING))) << 2
        | (len(raw.translate(None, SIGNS)) < len(raw)) << 3
    )


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) for each row of ``docs``. Texts are read once; their
    128-bit digests stand for them from then on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [t or b"" for t in batch["text"].to_pylist()]
            yield {
                "doc_id": batch["doc_id"],
                "part": batch["part"],
                "fails": [failed(t) for t in texts],
                "digest": [hashlib.blake2b(t, digest_size=16).digest() for t in texts],
            }

    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("text")
    )
    facts = materialize(map_batches(rows, read, "doc_id long, part string, fails int, digest binary"), "facts")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    repeats = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    bit = 1 << FILTERS.index("E")
    known = attach(facts, first, "digest", "n").select("doc_id", "part", F.col("fails").bitwiseOR(repeats * bit).alias("fails"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality").cast("int") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic").cast("int") == 1), F.lit(False)).alias("toxic"),
    )
    marked = known.join(marks.filter("doc_id IS NOT NULL AND (good OR toxic)"), "doc_id", "left")
    return marked.select("part", "fails", *[F.coalesce(x, F.lit(False)).alias(x) for x in LABELS])


def bitset(flags: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros(64 * words, np.uint8)
    bits[at] = flags
    return np.packbits(bits, bitorder="little").view(np.uint64)


def popcounts(codes: np.ndarray, fails: np.ndarray, labels: list[np.ndarray]) -> np.ndarray:
    """Rows kept by each subset of filters, all and by label, for each part: an array
    (parts, subsets, 1 + labels). ``codes`` numbers the parts from 0, each with a row."""
    sizes = np.bincount(codes)
    words = (sizes + 63) // 64
    starts = np.concatenate([[0], np.cumsum(words)[:-1]])
    order = np.argsort(codes, kind="stable")
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.empty(len(codes), np.int64)
    at[order] = np.arange(len(codes)) - np.repeat(before, sizes) + 64 * np.repeat(starts, sizes)
    total = int(words.sum())
    present = bitset(np.ones(len(codes), np.uint8), at, total)
    filters = [bitset((fails >> f & 1).astype(np.uint8), at, total) for f in range(len(FILTERS))]
    marks = [present, *(bitset(x.astype(np.uint8), at, total) for x in labels)]
    kept = [present]
    for subset in range(1, SUBSETS):
        lowest = (subset & -subset).bit_length() - 1
        kept.append(kept[subset & subset - 1] & ~filters[lowest])
    count = lambda bits: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), starts)
    return np.array([[count(k & m) for m in marks] for k in kept]).transpose(2, 0, 1)


def kept_by_subset(rows: DataFrame) -> DataFrame:
    """(part, subset, kept, good, toxic): rows that pass all filters of the subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[str, np.ndarray] = {}

        def given() -> dict:
            parts = [p for p in sums for _ in range(SUBSETS)]
            counts = np.concatenate(list(sums.values())) if sums else np.zeros((0, 3), np.int64)
            return {"part": parts, "subset": list(range(SUBSETS)) * len(sums), **dict(zip(["kept", *LABELS], counts.T))}

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch["part"].dictionary_encode()
            flags = [batch[x].to_numpy(zero_copy_only=False) for x in LABELS]
            counts = popcounts(coded.indices.to_numpy(), batch["fails"].to_numpy(), flags)
            for part, found in zip(coded.dictionary.to_pylist(), counts):
                sums[part] = sums[part] + found if part in sums else found
            if len(sums) >= PARTS_KEPT:
                yield given()
                sums.clear()
        yield given()

    found = map_batches(rows, run, "part string, subset int, kept long, good long, toxic long")
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", *LABELS)])


def steps() -> list[dict]:
    """Every step of every order: its filter, the subset before it and that after it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            out.append({"o": "".join(FILTERS[i] for i in order), "s": k + 1, "f": f, "b": before, "a": before | 1 << f})
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with counts in the part.

    A null text is empty, a null ``source`` the part of empty name, with which an empty
    source is one. A row without a doc_id has no smaller id and never fails E, nor has
    it labels; rows of one id and one text do not fail it by each other. Of several
    labels of an id, 1 counts. Repeated rows count each. An empty table gives no rows;
    other columns are not read.
    """
    n = len(FILTERS)
    sums = kept_by_subset(judged(docs, labels)).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "kept", *LABELS))).alias("c"))
    held = lambda subset, what="kept": F.get("c", subset)[what]

    def share(f: int) -> Column:
        """Over all orders, each subset without f comes before it in |S|! (n - 1 - |S|)! of them."""
        without = [s for s in range(SUBSETS) if not s >> f & 1]
        times = lambda s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())
        return sum((times(s) * (held(F.lit(s)) - held(F.lit(s | 1 << f))) for s in without[1:]), times(0) * (held(F.lit(0)) - held(F.lit(1 << f))))

    all_steps = F.from_json(F.lit(json.dumps(steps())), "array<struct<o: string, s: int, f: int, b: int, a: int>>")
    each = sums.select("part", "c", F.array(*[share(f) for f in range(n)]).alias("shares"), F.explode(all_steps).alias("t"))
    before, after = F.col("t.b"), F.col("t.a")
    alone = F.expr("shiftleft(1, t.f)")
    lost = lambda what: held(before, what) - held(after, what)
    return each.select(
        "part",
        F.col("t.o").alias("filter_order"),
        F.col("t.s").alias("step"),
        held(after).alias("kept"),
        lost("kept").alias("removed"),
        (held(F.lit(0)) - held(alone) - lost("kept")).alias("redundant"),
        (held(F.lit(SUBSETS - 1) - alone) - held(F.lit(SUBSETS - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shares", F.col("t.f")).alias("shapley"),
    )


def sql() -> str:
    """The same for DuckDB, order by order and step by step."""
    return r"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), marks AS (
      SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
    ), judged AS (
      SELECT d.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
        + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS fails
      FROM d LEFT JOIN marks USING (doc_id)
    ), kinds AS (SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL),
    l(c, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders AS (
      SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
        AND len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
    ), steps AS (
      SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) r(step)
    ), counted AS (
      SELECT part, filter_order, step, bit,
        sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN fails & before = 0 AND fails & bit > 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN fails & before = 0 AND fails & bit > 0 AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
      FROM kinds, steps GROUP BY ALL
    )
    SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
    FROM counted
    """


def op11_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
