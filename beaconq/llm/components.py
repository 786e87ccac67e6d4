"""Connected components by star contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import attach, discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node reachable.

    Large-star and small-star steps alternate until the edges are stars. Each round
    is written to the shared folder, which cuts the lineage. Null ends are dropped;
    no edges give no rows.
    """
    state, before = materialize(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "stars"), None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            state.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        # The hub of a large star is a key with very many rows, hence ``attach``.
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = attach(both, least, "u", "n", total=2 * now[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hooked = attach(large, least, "u", "n", total=large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "stars")
        discard(state, large)
        state = after
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
