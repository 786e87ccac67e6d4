"""Near-duplicates by SimHash fingerprints.

Method: an inverted index from positional bytes to fingerprints with count filtering.
A fingerprint is eight bytes at eight positions. Three differing bits touch at most
three bytes, so two linked fingerprints share at least five positional bytes: pairs
that meet in the index are tallied, those under five shared bytes dropped, the rest
verified by their differing bits.

The list of one byte holds 1/256 of all rows, so the index is keyed by several
positions and their bytes together: by three at first. Of eight positions in two
halves, any five have three in one half, hence the four triples of each half suffice
(eight keys a row). Where such a list is longer than ``LONG_LIST``, its members are
listed anew by one position more, and again: two that share five positions, three of
them known, have one of any four of the other five in common, so four keys a row
suffice, and then the four that are left. So lists stay short however many rows there
are, until only fingerprints with five equal bytes are left in one.

Equal fingerprints are one row of the index. A list of five equal bytes that is still
longer than ``LONG_LIST`` (a large group of near copies) is not paired: its members
meet at centres instead. x and y differ in three bits or fewer exactly if some centre
is at most one bit from x and two from y; hence at a centre with a fingerprint within
one bit all within two bits belong together. That makes links in proportion to the
fingerprints.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField

from .common import attach, discard, map_batches, materialize, table
from .components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SHINGLE = 3
SEED = 42
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
#: Positions keyed together: all triples of each half.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
LONG_LIST = 512
#: Shingles whose bits are summed at once, which bounds memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str) -> int:
    """64 bits, each 1 if set in over half of the shingles' hashes; 0 without words."""
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [" ".join(words)]
    else:
        shingles = list(map(" ".join, zip(words, words[1:], words[2:])))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), BLOCK):
        part = shingles[at : at + BLOCK]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_ = ones * 2 > len(shingles)
    return int(np.packbits(set_, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """``doc_id``, its fingerprint as a signed long ``fp``, and ``row`` (a long that goes
    along, 0 if not given); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            fp = np.array([fingerprint(t or "") for t in batch["text"].to_pylist()], np.uint64)
            yield {"doc_id": batch["doc_id"], "fp": fp.view(np.int64), "row": batch["row"]}

    row = F.lit(0).cast("long") if row is None else row
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row.alias("row"))
    return map_batches(read, run, "doc_id long, fp long, row long")


def byte_at(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(255)


def byte_mask(positions: int) -> int:
    """The bits of the bytes whose positions are set in ``positions``, as a signed long."""
    mask = sum(255 << 8 * p for p in range(8) if positions >> p & 1)
    return mask - (1 << 64) if mask >> 63 else mask


def wider(positions: int) -> list[int]:
    """Sets of one position more, of which two fingerprints that share these positions
    and five in all share one."""
    others = [p for p in range(8) if not positions >> p & 1]
    return [positions | 1 << p for p in others[:4]]


#: Position sets of the index by level, each with what it becomes where its list is long.
LEVELS: list[dict[int, list[int]]] = [{sum(1 << p for p in t): [] for t in TRIPLES}]
while len(LEVELS) < LEAST_BYTES - 2:
    LEVELS[-1] = {m: wider(m) for m in LEVELS[-1]}
    LEVELS.append({w: [] for ws in LEVELS[-1].values() for w in ws})


def postings(prints: DataFrame, sets: Column) -> DataFrame:
    """(key, fp, positions): ``prints`` under each of the position sets; the key stands
    for the set and its bytes. Two keys that clash only make a list longer."""
    masks = F.create_map(*[F.lit(x) for level in LEVELS for m in level for x in (m, byte_mask(m))])
    each = prints.select("fp", F.explode(sets).alias("positions"))
    return each.select(F.xxhash64("positions", F.col("fp").bitwiseAND(masks[F.col("positions")])).alias("key"), "fp", "positions")


def links(prints: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints, enough of those within ``MOST_BITS`` bits
    to connect all that are linked; each pair given is such a link or a path of them.

    ``prints`` has one row for each fingerprint ``fp``.
    """
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((F.when(byte_at(differ, p) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))
    found, sets, crowded = [], F.array(*map(F.lit, LEVELS[0])), prints
    for level in LEVELS:
        listed = materialize(postings(crowded, sets).distinct(), "postings")
        sizes = listed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        met = attach(listed, sizes.withColumn("size", F.col("n")), "key", "size")
        short = met.filter(F.col("n") <= long_list)
        left, right = (short.select("key", F.col("fp").alias(x)) for x in "ab")
        pairs = left.join(right, "key").filter(F.col("a") < F.col("b")).filter(shared >= LEAST_BYTES)
        found.append(materialize(pairs.filter(F.bit_count(differ) <= MOST_BITS).select("a", "b").distinct(), "pairs"))
        crowded = materialize(met.filter(F.col("n") > long_list).select("fp", "positions"), "crowded")
        discard(listed)
        if crowded.isEmpty():
            break
        more = F.create_map(*[x for m, ws in level.items() for x in (F.lit(m), F.array(*[F.lit(w) for w in ws]).cast("array<int>"))])
        sets = more[F.col("positions")]
    else:
        found.append(materialize(stars(crowded.select("fp").distinct()), "pairs"))
    return reduce(DataFrame.unionByName, found).distinct()


def stars(crowded: DataFrame) -> DataFrame:
    """Links among fingerprints of which many are near each other: every one goes to
    the centres within two bits of it, and is linked to the least within one bit."""
    single = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    near = [0, *single]
    far = [x ^ y for x, y in combinations(single, 2)]

    def around(masks: list[int], close: bool) -> DataFrame:
        mask = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
        return crowded.select("fp", mask.alias("m")).select(
            F.col("fp").bitwiseXOR(F.col("m")).alias("centre"), "fp", F.lit(close).alias("close")
        )

    heads = around(near, True).groupBy("centre").agg(F.min("fp").alias("head"))
    members = around(near, True).unionByName(around(far, False)).join(heads, "centre")
    return members.filter("fp <> head").select(F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b")).distinct()


def grouped(rows: DataFrame, long_list: int) -> DataFrame:
    """The distinct fingerprints of ``rows``: fp, n (rows), root, component_id."""
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "prints")
    joined = components(links(prints.select("fp"), long_list)).withColumnRenamed("node", "fp")
    rooted = prints.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum(F.lit(1)).alias("size"))
    by_print = attach(rooted.select("root", "fp", "n"), first, "root", "size")
    return materialize(by_print.select("fp", "n", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` for each row of ``docs``.

    ``component_id`` is the least doc_id that is reached over links of three or fewer
    differing bits, null if all ids there are null. Null and empty texts, and texts of
    white space, have fingerprint zero and are linked like any other. Repeated rows
    each give a row. An empty table gives no rows; other columns are not read.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    classes = grouped(rows, long_list).select("fp", "n", "component_id")
    return attach(rows, classes, "fp", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def hashable(field: StructField) -> Column:
    """The column, or its JSON where it holds what cannot be hashed (maps, variants)."""
    held = field.dataType.simpleString()
    col = F.col(f"`{field.name}`")
    return F.to_json(col) if "map<" in held or "variant" in held else col


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with its columns as they are.

    The row kept is that of the least doc_id (of equal ids, the least by hash of the
    row; of equal rows any); a row without an id only where no row of its group has one.
    Columns of any names and types may go along. Texts are shuffled once, by the hash.
    """
    tag = uuid.uuid4().hex
    row_, id_ = f"row_{tag}", f"id_{tag}"
    row = F.xxhash64(*map(hashable, docs.schema))
    rows = materialize(fingerprints(docs, row), "fingerprints")
    classes = grouped(rows, LONG_LIST)
    with_root = attach(rows, classes.select("fp", "n", "root"), "fp", "n")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    best = with_root.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias(id_), F.col("o.row").alias(row_)).distinct()
    first = materialize(best, "first")
    discard(rows, classes)
    kept = docs.withColumn(row_, row).join(first, row_).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(id_)))
    return kept.dropDuplicates([row_, id_]).select(*[F.col(f"`{c}`") for c in docs.columns])
