"""The three rankings, and the top of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from beaconq.functions import text as T
from beaconq.operators.merge import fields, last_wins

RRF_K = 60


def invalid(contributions: Column) -> Column:
    """Whether a position is 0 or a weight negative or not finite, which no score allows."""
    return F.exists(contributions, lambda c: (c["position"] < 1) | (c["weight"] < 0) | F.isnan(c["weight"]) | (c["weight"] == float("inf")))


def ranking_errors(merged: DataFrame) -> DataFrame:
    """(request_id, code) of the requests that cannot be ranked, as one result cannot."""
    return merged.filter(invalid(F.col("contributions"))).select("request_id", F.lit("INTERNAL_ERROR").alias("code")).distinct()


def rankable(merged: DataFrame) -> DataFrame:
    bad = F.bool_or(invalid(F.col("contributions"))).over(W.partitionBy("request_id"))
    return merged.withColumn("_bad", bad).filter("NOT _bad").drop("_bad")


def rrf(contributions: Column, n_engines: Column) -> Column:
    """Reciprocal ranks by weight, added in the order of the contributions, and a little
    for agreement of engines."""
    total = F.aggregate(contributions, F.lit(0.0), lambda s, c: s + c["weight"] / (RRF_K + c["position"]))
    return total + 0.10 * F.log(1.0 + n_engines)


def compatible(contributions: Column) -> Column:
    """Product of weights, times contributions; that by each position, added up."""
    product = F.aggregate(contributions, F.lit(1.0), lambda p, c: p * c["weight"]) * F.size(contributions)
    return F.aggregate(contributions, F.lit(0.0), lambda s, c: s + product / c["position"])


def lexical(query: Column, query_tokens: Column, title: Column, content: Column, url: Column) -> Column:
    """Phrase and token agreement of a result with the query; every text is normalised once."""
    texts = {"p": T.normalize(query), "t": T.normalize(title), "c": T.normalize(content), "u": T.normalize(url)}

    def agreed(n: Column) -> Column:
        return (
            F.when((n["p"] != "") & F.contains(n["t"], n["p"]), 2.0).otherwise(0.0)
            + F.when((n["p"] != "") & F.contains(n["c"], n["p"]), 0.75).otherwise(0.0)
            + 1.5 * T.coverage(n["q"], n["t"])
            + 0.60 * T.coverage(n["q"], n["c"])
            + 0.25 * T.coverage(n["q"], n["u"])
        )

    bound = F.struct(query_tokens.alias("q"), *[v.alias(k) for k, v in texts.items()])
    return F.element_at(F.transform(F.array(bound), agreed), 1)


def scored(merged: DataFrame, strategy: str, queries: DataFrame | None = None) -> DataFrame:
    """Add ``score``, and drop the requests of ``ranking_errors``. ``query-aware-v1`` needs
    ``queries`` (request_id, query)."""
    base = rrf(F.col("contributions"), F.size("engines"))
    merged = rankable(merged)
    if strategy == "rrf-v1":
        return merged.withColumn("score", base)
    if strategy == "compat-v1":
        return merged.withColumn("score", compatible(F.col("contributions")))
    asked = queries.select("request_id", "query", T.tokens(F.col("query")).alias("query_tokens"))
    rows = merged.join(asked, "request_id").withColumn("year", T.publication_year(F.col("published_at")))
    newest = F.max("year").over(W.partitionBy("request_id"))
    fresh = F.when(F.col("year").isNotNull(), T.freshness_bonus(F.col("year"), newest)).otherwise(0.0)
    match = lexical(F.col("query"), F.col("query_tokens"), F.col("title"), F.col("content"), F.col("canonical_url"))
    rows = rows.withColumn("fresh", fresh)
    return rows.withColumn("score", F.when(F.size("query_tokens") > 0, base + match + F.col("fresh")).otherwise(base)).drop(
        "query", "query_tokens", "year", "fresh"
    )


def top(rows: DataFrame, limit: int = 10) -> DataFrame:
    """The best of each request: score down, then canonical URL."""
    by = W.partitionBy("request_id").orderBy(F.desc("score"), "canonical_url")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def fused(provider: DataFrame, index: DataFrame, queries: DataFrame, ranking: str = "query-aware-v1", limit: int = 10) -> DataFrame:
    """Provider list and index list (request_id, canonical_url, rank, title, content,
    engines; positions, provider_metadata and metadata where they have them) as one: a row
    of either, reciprocal ranks added, provider's fields first, maps united with the
    index's values for equal keys. ``query-aware-v1`` adds the lexical score, and a little
    of the index's own score (``index_score``). Ties go to the provider's order."""
    keys = ["request_id", "canonical_url"]
    both = provider.alias("p").join(index.alias("i"), keys, "full_outer")
    none = F.array().cast("array<string>")
    maps = [c for c in ("positions", "provider_metadata") if c in provider.columns and c in index.columns]
    united = [last_wins(F.array_compact(F.array(f"p.{c}", f"i.{c}"))).alias(c) for c in maps]
    if "metadata" in provider.columns and "metadata" in index.columns:
        united.append(F.to_json(last_wins(F.array(fields(F.col("p.metadata")), fields(F.col("i.metadata"))))).alias("metadata"))
    own = F.coalesce(F.col("i.index_score"), F.lit(0.0)) if "index_score" in index.columns else F.lit(0.0)
    rows = both.select(
        *keys,
        *[F.coalesce(f"p.{c}", f"i.{c}").alias(c) for c in ("title", "content")],
        F.array_sort(F.array_union(F.coalesce("p.engines", none), F.coalesce("i.engines", none))).alias("engines"),
        *united,
        own.alias("index_score"),
        F.col("p.rank").alias("provider_rank"),
        (F.coalesce(1.0 / (RRF_K + F.col("p.rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("i.rank")), F.lit(0.0))).alias("score"),
    )
    if ranking == "query-aware-v1":
        asked = queries.select("request_id", "query", T.tokens(F.col("query")).alias("query_tokens"))
        match = lexical(F.col("query"), F.col("query_tokens"), F.col("title"), F.col("content"), F.col("canonical_url"))
        more = match + 0.1 * F.log(1.0 + F.greatest(F.size("engines"), F.lit(1))) + 0.05 * F.col("index_score")
        rows = rows.join(asked, "request_id").withColumn("score", F.col("score") + more)
    by = W.partitionBy("request_id").orderBy(F.desc("score"), F.asc_nulls_last("provider_rank"), "canonical_url")
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)
