"""Approximate nearest neighbours by inner product, from vantage-point trees.

Method: a vantage-point tree over a bounded sample divides space into regions; every
row is dealt to its region, and regions to shards of bounded size by hash. Each shard
has a vantage-point tree of all its rows. Largest inner product becomes least distance
by one more component that gives all vectors the same length. A subtree, or a region,
is skipped when the triangle inequality puts it beyond a query's k-th best so far; the
inequality is relaxed by ``factor``: a bound counts ``factor`` times, so 1 is exact and
more skips more.

A query is first answered in its own region, and the k-th best found there tells which
other regions it has to visit. Equal vectors are one entry with their least ids, so a
vector that a third of all rows share costs no more than another. Blocks of queries meet
groves of shards: a task takes a block through its grove shard by shard, so it gives no
more than k rows a query for all of them. Leaves are sifted by products in single
precision, with room for their rounding; scores and ranks are of double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import HASHES, attach, discard, map_batches, materialize, table

SHARD_ROWS = 8192
#: What a task has of shards and of queries at once, in bytes of doubles; shards at most GROVE.
GROVE, GROVE_BYTES, BLOCK_BYTES = 8, 32 << 20, 8 << 20
LEAF = 256
#: Queries whose products with a leaf are made together.
TILE = 1024
FACTOR = 1.15
NEIGHBOURS = 20
#: The sample that regions are made from: so many rows, or as many as have so many bytes,
#: and so many of them in a region at least. All rows are dealt and searched.
SAMPLE_ROWS, SAMPLE_BYTES, REGION_SAMPLE = 20_000, 32 << 20, 8


@dataclass
class Tree:
    """Nodes as arrays; a leaf has no vantage point and a range of ``order``."""

    vantage: list[int]
    radius: list[float]
    inner: list[int]
    outer: list[int]
    ranges: list[tuple[int, int]]
    order: np.ndarray


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that every row has length ``longest``."""
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def build(x: np.ndarray, leaf: int = LEAF, seed: int = 5) -> Tree:
    """Split at the median distance from a vantage point far from a random row."""
    rng, tree = np.random.default_rng(seed), Tree([], [], [], [], [], np.arange(len(x)))

    def grow(lo: int, hi: int) -> int:
        node = len(tree.vantage)
        for column in (tree.vantage, tree.inner, tree.outer):
            column.append(-1)
        tree.radius.append(0.0)
        tree.ranges.append((lo, hi))
        if hi - lo > leaf:
            idx = tree.order[lo:hi]
            start = x[idx[rng.integers(len(idx))]]
            vantage = idx[np.argmax(((x[idx] - start) ** 2).sum(axis=1))]
            d = np.sqrt(((x[idx] - x[vantage]) ** 2).sum(axis=1))
            by = np.argsort(d, kind="stable")
            tree.order[lo:hi] = idx[by]
            mid = (hi - lo) // 2
            tree.vantage[node], tree.radius[node] = int(vantage), float((d[by[mid - 1]] + d[by[mid]]) / 2)
            tree.inner[node] = grow(lo, lo + mid)
            tree.outer[node] = grow(lo + mid, hi)
        return node

    grow(0, len(x))
    return tree


def reach(q2: np.ndarray, longest2: float, worst: np.ndarray) -> np.ndarray:
    """Distance at which an inner product is ``worst``, with room for rounding."""
    return np.sqrt(np.maximum(q2 + longest2 - 2 * worst, 0)) * (1 + 1e-9) + 1e-9


class Best:
    """The k best rows of each query of a block so far, and all that may be as good.

    Products are made in single precision, of vectors scaled to length 1 at most. Two of
    them that differ by more than ``room`` are in the right order, so a row that is below
    a query's k-th by more is none of its best. ``floor``: a product, so scaled, that a
    query is known to have k of.
    """

    def __init__(self, x: np.ndarray, first: np.ndarray, longest: float, q: np.ndarray, k: int, known: np.ndarray):
        top = np.abs(q).max(axis=1, keepdims=True, initial=0)
        norm = top[:, 0] * np.sqrt(((q / top) ** 2).sum(axis=1))
        self.x, self.first, self.q, self.k = x, first, q, k
        self.scaled = (x.astype(np.float64) / (longest or 1.0)).astype(np.float32)
        self.unit, self.scale = (q / norm[:, None]).astype(np.float32), norm * (longest or 1.0)
        self.room = 2 * (x.shape[1] + 8) * 2.0**-24
        self.floor = known / self.scale
        self.query, self.row, self.near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.most = 0, len(q) * k + (1 << 16)

    def least(self, of: np.ndarray) -> np.ndarray:
        """Below these products no row is among the best of the queries."""
        return (self.floor[of] - self.room) * self.scale[of]

    def scan(self, queries: np.ndarray, rows: np.ndarray, raise_floor: bool = False) -> None:
        x = self.scaled[rows]
        for at in range(0, len(queries), TILE):
            mine = queries[at : at + TILE]
            near = self.unit[mine] @ x.T
            if raise_floor and len(x) >= self.k:
                kth = np.partition(near, len(x) - self.k, axis=1)[:, len(x) - self.k]
                self.floor[mine] = np.maximum(self.floor[mine], kth)
            hit = np.flatnonzero(near >= (self.floor[mine] - self.room).astype(np.float32)[:, None])
            if len(hit):
                self.new.append((mine[hit // len(x)], rows[hit % len(x)], near.ravel()[hit]))
                self.waiting += len(hit)
            if self.waiting > self.most:
                self._settle()

    def _settle(self) -> None:
        """Raise the floors, and drop what is below them."""
        parts = [(self.query, self.row, self.near), *self.new]
        query, row, near = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(query * 4.0 - near)
        query, row, near = query[order], row[order], near[order]
        counts = np.bincount(query, minlength=len(self.q))
        full = np.flatnonzero(counts >= self.k)
        kth = near[(np.cumsum(counts) - counts)[full] + self.k - 1]
        self.floor[full] = np.maximum(self.floor[full], kth)
        keep = near >= (self.floor[query] - self.room).astype(np.float32)
        self.query, self.row, self.near = query[keep], row[keep], near[keep]
        self.new, self.waiting = [], 0
        if len(self.row) > 2 * self.most:  # many of nearly the same product
            self._exact()

    def _exact(self) -> np.ndarray:
        """Leave the k best by exact products, ties to the least id, and return those."""
        score = np.empty(len(self.row))
        for at in range(0, len(score), 1 << 15):
            part = slice(at, at + (1 << 15))
            score[part] = (self.x[self.row[part]].astype(np.float64) * self.q[self.query[part]]).sum(axis=1)
        order = np.lexsort((self.first[self.row], -score, self.query))
        counts = np.bincount(self.query, minlength=len(self.q))
        start = np.cumsum(counts) - counts
        order = order[np.arange(len(order)) - start[self.query[order]] < self.k]
        self.query, self.row, self.near, score = self.query[order], self.row[order], self.near[order], score[order]
        counts = np.minimum(counts, self.k)
        full = np.flatnonzero(counts == self.k)
        kth = score[(np.cumsum(counts) - counts)[full] + self.k - 1]
        self.floor[full] = np.maximum(self.floor[full], kth / self.scale[full])
        return score

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, exact product), by query, best first."""
        self._settle()
        score = self._exact()
        return self.query, self.row, score


def search(tree: Tree, base: int, best: Best, queries: np.ndarray, longest: float, factor: float) -> None:
    """Take what a tree has for these queries into ``best``; its rows begin at ``base`` there."""
    if not len(queries):
        return
    q = best.q[queries]
    q2 = (q * q).sum(axis=1)
    # Distances by products are off by no more than this.
    slack = 2 * longest * np.sqrt((q.shape[1] + 8) * np.finfo(np.float64).eps)
    bound = {0: np.zeros(len(q))}
    leaves = []
    for node, vantage in enumerate(tree.vantage):  # a parent comes before its children
        own = bound.pop(node)
        if vantage < 0:
            leaves.append((base + tree.order[slice(*tree.ranges[node])], own))
            continue
        # Lifted, the vantage point has length ``longest`` and a query one more component of 0.
        products = q @ best.x[base + vantage].astype(np.float64)
        gap = np.sqrt(np.maximum(q2 + longest**2 - 2 * products, 0)) - tree.radius[node]
        bound[tree.inner[node]], bound[tree.outer[node]] = np.maximum(own, gap - slack), np.maximum(own, -gap - slack)
    at_home = np.argmin([b for _, b in leaves], axis=0)
    for k, (rows, _) in enumerate(leaves):
        best.scan(queries[at_home == k], rows, raise_floor=True)
    for k, (rows, b) in enumerate(leaves):
        beyond = factor * b > reach(q2, longest**2, best.least(queries))
        best.scan(queries[~beyond & (at_home != k)], rows)


@dataclass
class Regions:
    """The inner nodes of a tree over a sample, with the vantage points' coordinates;
    a side is a node, or a region as its number's complement."""

    points: np.ndarray
    radius: np.ndarray
    inner: list[int]
    outer: list[int]
    number: int
    longest: float
    grove: int

    @staticmethod
    def of(sample: np.ndarray, longest: float, leaf: int, grove: int) -> Regions:
        lift = lifted(sample, longest)
        tree = build(lift, leaf)
        nodes = [k for k, v in enumerate(tree.vantage) if v >= 0]
        leaves = [k for k, v in enumerate(tree.vantage) if v < 0]
        name = {k: i for i, k in enumerate(nodes)} | {k: ~i for i, k in enumerate(leaves)}
        side = lambda column: [name[column[k]] for k in nodes]
        points = lift[[tree.vantage[k] for k in nodes]] if nodes else np.zeros((0, lift.shape[1]))
        return Regions(points, np.array([tree.radius[k] for k in nodes]), side(tree.inner), side(tree.outer), len(leaves), longest, grove)

    def distances(self, x: np.ndarray, node: int) -> np.ndarray:
        return np.sqrt(((x - self.points[node]) ** 2).sum(axis=1))

    def home(self, x: np.ndarray) -> np.ndarray:
        """The region of each lifted row."""
        found = np.zeros(len(x), np.int64)
        stack = [(0 if len(self.points) else ~0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if node < 0:
                found[rows] = ~node
                continue
            inside = self.distances(x[rows], node) <= self.radius[node]
            stack += [(self.inner[node], rows[inside]), (self.outer[node], rows[~inside])]
        return found

    def visits(self, q: np.ndarray, within: np.ndarray, factor: float) -> np.ndarray:
        """Whether each lifted query (row) may have something in a region (column) at ``within`` or less."""
        found = np.zeros((len(q), self.number), bool)
        stack = [(0 if len(self.points) else ~0, np.arange(len(q)), np.zeros(len(q)))]
        while stack:
            node, rows, bound = stack.pop()
            near = factor * bound <= within[rows]
            rows, bound = rows[near], bound[near]
            if not len(rows):
                continue
            if node < 0:
                found[rows, ~node] = True
                continue
            gap = self.distances(q[rows], node) - self.radius[node]
            stack += [(self.inner[node], rows, np.maximum(bound, gap)), (self.outer[node], rows, np.maximum(bound, -gap))]
        return found


def _matrix(lists) -> np.ndarray:
    """Arrow lists of one length as rows."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not zero and has finite components only."""
    value = F.col("embedding")
    fine = ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(value, lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long"), "embedding").filter(
        F.col("vec_id").isNotNull() & value.isNotNull() & (F.size(value) > 0)
    ).filter(fine)


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each
    row that ``is_query`` (a column) holds for, its own id left out.

    Vectors that are null, empty, zero, or hold null or non-finite components take no
    part, nor do rows with a null id. Vectors meet those of their own length only. Of
    equal scores the smaller vec_id comes first. Repeated rows count once. An id with
    several vectors is one candidate, with its best score, and as a query asks with all
    of them. Fewer candidates than k give fewer rows; an empty table gives none.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    usable = _usable(vectors.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))).distinct()
    # The k + 1 least ids of a vector are all that can be among the k nearest of a query.
    nth = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    entries = usable.withColumn("_n", nth).filter(F.col("_n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entries.withColumn("size", F.size("embedding")), "vectors")
    length2 = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    spaces = {}
    for s in entries.groupBy("size").agg(F.count("*").alias("n"), F.max(length2).alias("m")).collect():
        spaces[s["size"]] = _regions(entries.filter(F.col("size") == s["size"]), s["size"], s["n"], float(s["m"]) ** 0.5)
    spaces = vectors.sparkSession.sparkContext.broadcast(spaces)

    def by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, Regions, np.ndarray]]:
        sizes = batch["size"].to_numpy()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            yield rows, spaces.value[size], _matrix(batch["embedding"].take(pa.array(rows))).astype(np.float64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            region, grove = np.zeros(len(batch), np.int64), np.ones(len(batch), np.int64)
            for rows, space, x in by_size(batch):
                region[rows], grove[rows] = space.home(lifted(x, space.longest)), space.grove
            yield {c: batch[c] for c in ("embedding", "ids", "size")} | {"region": region, "grove": region // grove, "bit": 1 << region % grove}

    dealt = materialize(map_batches(entries, deal, f"embedding array<{kind}>, ids array<long>, size int, region long, grove long, bit long"), "dealt")
    at = ["size", "region"]
    shards = _in_blocks(dealt, at, "shard", SHARD_ROWS).groupBy(*at, "grove", "bit", "shard")
    trees = materialize(shards.applyInArrow(_planter(spaces, kind), TREES), "trees")

    queries = materialize(usable.filter(is_query).select(F.col("vec_id").alias("query_id"), "embedding"), "queries")
    asked = queries.groupBy("embedding").agg(F.count("*").alias("askers"))
    # Written with its number, a vector keeps it.
    asked = asked.join(dealt.drop("ids"), "embedding").withColumn("query", F.monotonically_increasing_id())
    asked = materialize(asked, "asked")
    home = asked.select("query", "embedding", "size", F.lit(float("-inf")).alias("known"), "grove", F.col("bit").alias("bits"))
    best = materialize(_best(_ask(home, trees, spaces, k, factor), k), "home")

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for rows, space, q in by_size(batch):
                known = batch["known"].to_numpy()[rows]
                within = reach((q * q).sum(axis=1), space.longest**2, known)
                found = space.visits(np.concatenate([q, np.zeros((len(q), 1))], axis=1), within, factor)
                found[np.arange(len(q)), batch["region"].to_numpy()[rows]] = False
                for grove in range(-(-space.number // space.grove)):
                    part = found[:, grove * space.grove : (grove + 1) * space.grove]
                    some = np.flatnonzero(part.any(axis=1))
                    if len(some):
                        bits = part[some] @ (1 << np.arange(part.shape[1]))
                        mine = pa.array(rows[some])
                        yield {c: batch[c].take(mine) for c in ("query", "embedding", "size", "known")} | {"grove": np.full(len(some), grove), "bits": bits}

    # What a query has k + 1 of: itself, perhaps, and k others.
    enough = F.when(F.size("found") > k, F.element_at("found", k + 1)["score"]).otherwise(float("-inf"))
    away = asked.join(best.select("query", enough.alias("known")), "query")
    away = materialize(map_batches(away, travel, f"query long, embedding array<{kind}>, size int, known double, grove long, bits long"), "away")
    other = _ask(away, trees, spaces, k, factor)
    both = best.select("query", F.explode("found").alias("f")).select("query", "f.ids", "f.score").unionByName(other)
    answers = _best(both, k).join(asked.select("query", "embedding", "askers"), "query").drop("query")
    answers = materialize(answers, "answers")
    discard(trees, away, dealt, best)
    each = attach(queries, answers, "embedding", "askers").select("query_id", F.explode("found").alias("f"))
    rows = each.select("query_id", F.explode("f.ids").alias("vec_id"), F.col("f.score").alias("score")).filter("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _regions(entries: DataFrame, size: int, n: int, longest: float) -> Regions:
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * size)))
    share = entries if n <= most else entries.filter(F.pmod(F.xxhash64("embedding"), F.lit(HASHES)) < HASHES * most // n)
    sample = np.array([r["embedding"] for r in share.select("embedding").sort("embedding").collect()], np.float64).reshape(-1, size)
    grove = max(1, min(GROVE, GROVE_BYTES // (8 * size * SHARD_ROWS)))
    return Regions.of(sample, longest, max(REGION_SAMPLE, len(sample) * SHARD_ROWS // n), grove)


def _in_blocks(rows: DataFrame, keys: list[str], name: str, most: int) -> DataFrame:
    """Add a number by the hash of the embedding, so that about ``most`` rows of the keys
    have one in common. Regions are few, as the sample that makes them is bounded."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("_blocks"))
    return rows.join(F.broadcast(counts), keys).withColumn(name, F.pmod(F.xxhash64("embedding", F.lit(1)), "_blocks")).drop("_blocks")


DTYPES = {"float": np.float32, "double": np.float64}
TREES = "size int, region long, grove long, bit long, shard long, nodes binary, rows_in_order binary, x binary, ids binary, counts binary"
FOUND = "query long, ids array<long>, score double"


def _planter(spaces, kind: str):
    kinds = to_arrow_schema(StructType.fromDDL(TREES))

    def plant(rows: pa.Table) -> pa.Table:
        keys = {c: [rows[c][0].as_py()] for c in ("size", "region", "grove", "bit", "shard")}
        ids = rows["ids"].combine_chunks()
        rows = rows.take(pa.array(np.argsort(ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]], kind="stable")))
        x, ids = _matrix(rows["embedding"]), rows["ids"].combine_chunks()
        tree = build(lifted(x.astype(np.float64), spaces.value[keys["size"][0]].longest))
        nodes = np.array([tree.vantage, tree.radius, tree.inner, tree.outer, *zip(*tree.ranges)], np.float64)
        packed = {
            "nodes": nodes, "rows_in_order": tree.order.astype(np.int32), "x": x.astype(DTYPES[kind]),
            "ids": ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), "counts": ids.value_lengths().to_numpy().astype(np.int32),
        }
        return pa.Table.from_pydict(keys | {c: [v.tobytes()] for c, v in packed.items()}, schema=kinds)

    return plant


def _ask(asked: DataFrame, trees: DataFrame, spaces, k: int, factor: float) -> DataFrame:
    """(query, ids, score) of the best in each grove's shards for (query, embedding, size, known, grove, bits):
    a bit for each of the grove's regions that the query is to visit."""
    kinds, dtypes = to_arrow_schema(StructType.fromDDL(FOUND)), {np.dtype(d).itemsize: d for d in DTYPES.values()}

    def seek(shards: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(shards) or not len(asked):
            return kinds.empty_table()
        size = asked["size"][0].as_py()
        space, q = spaces.value[size], _matrix(asked["embedding"])
        x = [np.frombuffer(b.as_buffer(), dtypes[q.dtype.itemsize]).reshape(-1, size) for b in shards["x"]]
        counts, ids = (np.concatenate([np.frombuffer(b.as_buffer(), d) for b in shards[c]]) for c, d in (("counts", np.int32), ("ids", np.int64)))
        starts, bases = np.cumsum(counts, dtype=np.int64) - counts, np.cumsum([0, *map(len, x)])
        best = Best(np.concatenate(x), ids[starts], space.longest, q.astype(np.float64), k + 1, asked["known"].to_numpy())
        bits = asked["bits"].to_numpy()
        for i in np.lexsort((shards["region"].to_numpy(),)):
            nodes = np.frombuffer(shards["nodes"][i].as_buffer(), np.float64).reshape(6, -1)
            whole = nodes[[0, 2, 3, 4, 5]].astype(int).tolist()
            order = np.frombuffer(shards["rows_in_order"][i].as_buffer(), np.int32)
            tree = Tree(whole[0], nodes[1].tolist(), whole[1], whole[2], list(zip(whole[3], whole[4])), order)
            search(tree, bases[i], best, np.flatnonzero(bits & shards["bit"][i].as_py()), space.longest, factor)
        query, row, score = best.result()
        ends = np.cumsum(counts[row], dtype=np.int64)
        each = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[row] - (ends - counts[row]), counts[row])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids[each]))
        return pa.Table.from_arrays([pa.array(asked["query"].to_numpy()[query]), lists.cast(kinds.field("ids").type), pa.array(score)], schema=kinds)

    at = ["size", "grove"]
    blocks = asked.groupBy(*at).agg(F.ceil(F.count("*") * F.col("size") * 8 / BLOCK_BYTES).alias("_blocks"))
    meets = F.broadcast(blocks.join(F.broadcast(trees.groupBy(*at).agg(F.max("shard").alias("_last"))), at))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    left = trees.join(meets, at).withColumn("block", numbers(F.col("_blocks") - 1)).drop("_blocks", "_last")
    right = asked.join(meets, at).withColumn("block", F.pmod(F.xxhash64("query"), "_blocks")).withColumn("shard", numbers(F.col("_last")))
    keys = [*at, "shard", "block"]
    return left.groupBy(*keys).cogroup(right.drop("_blocks", "_last").groupBy(*keys)).applyInArrow(seek, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """(query, found): the k + 1 best entries of each query, best first, ties to the least id."""
    by_score = W.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    top = found.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= k + 1)
    listed = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "ids", "score"))).alias("found"))
    return listed.select("query", F.transform("found", lambda f: F.struct(f["ids"].alias("ids"), f["score"].alias("score"))).alias("found"))


def op2_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
