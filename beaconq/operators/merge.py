"""Merging of provider results: projection, engine-level rejection, dedup by URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from beaconq.functions import text as T
from beaconq.functions.urls import canonicalized

#: Columns of provider results besides the request: engine_id, ordinal (the engine's
#: place in the catalogue), weight, position, url, title, content, published_at, and, null
#: where they are not given, thumbnail, category and metadata (JSON text of an object).
FIRST = ("ordinal", "position")
OPTIONAL = ("thumbnail", "category", "metadata")
FIELDS = "map<string,variant>"


def normalized(results: DataFrame) -> DataFrame:
    """Add the canonical URL (null if there is none), trim title and content, and add the
    optional columns that are missing."""
    lacking = {c: F.lit(None).cast("string") for c in OPTIONAL if c not in results.columns}
    rows = results.withColumns({**lacking, "title": T.trimmed(F.col("title")), "content": T.trimmed(F.col("content"))})
    return canonicalized(rows)


def whole_engines(results: DataFrame) -> DataFrame:
    """Drop every result of an engine that has one without a canonical URL."""
    bad = F.bool_or(F.col("canonical_url").isNull()).over(W.partitionBy("request_id", "engine_id"))
    return results.withColumn("_bad", bad).filter("NOT _bad").drop("_bad")


def rejected_engines(results: DataFrame) -> DataFrame:
    """(request_id, engine_id, failure_kind) of the engines that ``whole_engines`` drops."""
    bad = results.filter(F.col("canonical_url").isNull()).select("request_id", "engine_id").distinct()
    return bad.withColumn("failure_kind", F.lit("ENGINE_PARSE_FAILED"))


def capped(results: DataFrame, most: int = 20) -> DataFrame:
    return results.filter(F.col("position") <= most)


def without_hosts(results: DataFrame, hosts: list[str]) -> DataFrame:
    """Drop results on the provider's own hosts and number the rest anew."""
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1))
    by = W.partitionBy("request_id", "engine_id").orderBy("position")
    return results.filter(~host.isin(hosts)).withColumn("position", F.row_number().over(by))


def first_wins(maps: Column) -> Column:
    """Union of a list of maps; of equal keys the value of the first map."""
    new = lambda seen, m: F.map_filter(m, lambda k, _: ~F.map_contains_key(seen, k))
    none = F.slice(maps, 1, 1)
    return F.aggregate(F.slice(maps, 2, F.size(maps)), F.get(none, F.lit(0)), lambda seen, m: F.map_concat(seen, new(seen, m)))


def last_wins(maps: Column) -> Column:
    """Union of a list of maps; of equal keys the value of the last map."""
    return first_wins(F.reverse(maps))


def fields(metadata: Column) -> Column:
    """JSON text of an object as a map; none for anything else."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(metadata), "$", FIELDS), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def dedup(results: DataFrame) -> DataFrame:
    """One row for each request and canonical URL.

    Results arrive in the order of the catalogue, then of position. Of titles and of
    contents the longest in bytes is taken, of equal ones the first; of dates and of
    thumbnails the first there is; URL and category of the first; of an engine's positions
    the least. Of metadata the first value of each key counts, and each engine's first
    metadata is kept besides. Every contribution is kept.
    """
    first = F.struct(*FIRST)
    back = F.struct(*[(-F.col(c)).alias(c) for c in FIRST])

    def longest(c: str):
        return F.max_by(c, F.struct(F.octet_length(F.coalesce(c, F.lit(""))).alias("n"), back.alias("b")))

    def earliest(c: str):
        return F.min_by(c, F.when(F.col(c).isNotNull(), first)).alias(c)

    rows = results.groupBy("request_id", "canonical_url").agg(
        F.min_by("url", first).alias("url"),
        longest("title").alias("title"),
        longest("content").alias("content"),
        earliest("published_at"),
        earliest("thumbnail"),
        F.min_by("category", first).alias("category"),
        F.array_sort(F.collect_set("engine_id")).alias("engines"),
        F.sort_array(F.collect_list(F.struct(*FIRST, "engine_id", "weight", "metadata"))).alias("_all"),
    )
    contribution = lambda c: F.struct(c["ordinal"].alias("ordinal"), c["engine_id"].alias("engine_id"), c["position"].alias("position"), c["weight"].alias("weight"))
    of = lambda e: F.filter("_all", lambda c: c["engine_id"] == e)
    return rows.withColumns(
        {
            "contributions": F.transform("_all", contribution),
            "positions": F.map_from_arrays("engines", F.transform("engines", lambda e: F.array_min(F.transform(of(e), lambda c: c["position"])))),
            "provider_metadata": F.map_from_arrays("engines", F.transform("engines", lambda e: F.coalesce(F.get(of(e), F.lit(0))["metadata"], F.lit("{}")))),
            "metadata": F.to_json(first_wins(F.transform("_all", lambda c: fields(c["metadata"])))),
        }
    ).drop("_all")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, columns, n): rows that one relation has oftener than the other, and by how
    many; none if they are equal, repeats counted. Nulls are equal to each other. Rows are
    counted before they are shuffled."""
    columns = left.columns
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    counts = signed.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return counts.select(F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), *columns, F.abs("_n").alias("n"))
