"""Reports of engine runs: outcome of a request, and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from beaconq.functions.classify import outcome


def outcomes(reports: DataFrame) -> DataFrame:
    """For each request: successes, failures, partial, code, whether more may follow, and
    sums over its engines. Columns may_follow (an engine gave a cursor, or as many results
    as were asked for), redirect_count and upstream_requests are read where reports have them."""
    sums = [F.sum(c).alias(c) for c in ("response_bytes", "redirect_count", "upstream_requests") if c in reports.columns]
    more = [F.coalesce(F.bool_or(F.col("failure_kind").isNull() & F.col("may_follow")), F.lit(False)).alias("may_have_more")] if "may_follow" in reports.columns else []
    return reports.groupBy("request_id").agg(
        F.count_if(F.col("failure_kind").isNull()).alias("successes"),
        F.count_if(F.col("failure_kind").isNotNull()).alias("failures"),
        F.bool_or(F.col("failure_kind").isNotNull()).alias("partial"),
        F.when(F.count_if(F.col("failure_kind").isNull()) == 0, "NO_ENGINE_SUCCEEDED").alias("code"),
        *sums,
        *more,
    )


def may_follow(next_cursor: Column, result_count: Column, limit: Column) -> Column:
    return next_cursor.isNotNull() | (result_count >= limit)


#: Buckets of a histogram, how often it is drawn anew within a bucket, and groups that are broadcast at most.
BUCKETS, ROUNDS, MOST_GROUPS = 1024, 2, 100_000


def weighted_percentile(rows: DataFrame, keys: list[str], value: str, weight: str, share: float) -> DataFrame:
    """(keys, n, q): the exact percentile of each group, a row counted ``weight`` times,
    between two ranks in proportion; ``n`` is the sum of weights.

    Equal values are added up first. Histograms, drawn anew within the bucket that holds
    the rank, lead to a few values, which alone are put in order: no task holds a group.
    Rows without a value, or of no weight, are left out. Null keys are a group like others.
    """
    at = F.struct(*keys).alias("g")
    held = rows.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(at, F.col(value).cast("double").alias("v")).agg(F.sum(F.col(weight).cast("long")).alias("w"))
    ends = held.groupBy("g").agg(F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = (F.col("n") - 1) * share
    ranks = F.array(*[F.struct(F.lit(k).alias("end"), f(place).cast("long").alias("rank")) for k, f in (("below", F.floor), ("above", F.ceil))])
    aimed = ends.select("g", "n", "low", "high", F.lit(0).cast("long").alias("before"), F.explode(ranks).alias("r")).select("g", "n", "low", "high", "before", "r.*")
    few = ends.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    running = W.partitionBy("h", "end").orderBy("b").rowsBetween(W.unboundedPreceding, -1)

    def within(aimed: DataFrame) -> DataFrame:
        t = aimed.withColumnRenamed("g", "h")
        return held.join(F.broadcast(t) if few else t, F.col("g").eqNullSafe(F.col("h")) & F.col("v").between(F.col("low"), F.col("high")))

    hit = F.col("rank").between(F.col("at"), F.col("at") + F.col("w") - 1)
    for _ in range(ROUNDS):
        span = F.col("high") - F.col("low")
        bucket = F.when(span > 0, F.least(F.floor((F.col("v") - F.col("low")) / span * BUCKETS), F.lit(BUCKETS - 1))).otherwise(0).alias("b")
        drawn = within(aimed).groupBy("h", "n", "end", "rank", "before", bucket).agg(F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"))
        placed = drawn.withColumn("at", F.col("before") + F.coalesce(F.sum("w").over(running), F.lit(0)))
        aimed = placed.filter(hit).select(F.col("h").alias("g"), "n", "low", "high", F.col("at").alias("before"), "end", "rank")
    upto = W.partitionBy("h", "end").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    found = within(aimed).withColumn("at", F.col("before") + F.coalesce(F.sum("w").over(upto), F.lit(0))).filter(hit)
    both = found.groupBy("h", "n").agg(F.max(F.when(F.col("end") == "below", F.col("v"))).alias("a"), F.max(F.when(F.col("end") == "above", F.col("v"))).alias("b"))
    part = place - F.floor(place)
    return both.select("h.*", "n", (F.col("a") + (F.col("b") - F.col("a")) * part).alias("q"))


def p95(reports: DataFrame) -> DataFrame:
    """By engine, outcome and kind of failure: events and the 95th percentile of their
    duration, each weighted by ``sample_weight`` where reports have it."""
    rows = reports.withColumn("outcome", outcome(F.col("failure_kind")))
    rows = rows.withColumn("_weight", F.col("sample_weight") if "sample_weight" in reports.columns else F.lit(1))
    found = weighted_percentile(rows, ["engine_id", "outcome", "failure_kind"], "duration_ms", "_weight", 0.95)
    return found.withColumnRenamed("q", "p95_ms")


def points(reports: DataFrame) -> DataFrame:
    """One row for each report, as the telemetry store keeps it."""
    unknown = lambda c, word: F.coalesce(F.col(c), F.lit(word)).alias(c)
    return reports.select(
        "engine_id", F.lit("search").alias("event"), outcome(F.col("failure_kind")).alias("outcome"), unknown("failure_kind", "none"), unknown("parser_version", "unknown"),
        F.lower("cache_status").alias("cache_status"), *[F.col(c).cast("double").alias(c) for c in ("duration_ms", "response_bytes", "parse_ms", "result_count", "redirect_count")],
    )


def log_lines(responses: DataFrame, reports: DataFrame) -> DataFrame:
    """(request_id, line): a JSON line for each response (request_id, query, provider_query,
    cached, duration_ms, result_count, partial, bangs), with hashes in place of queries."""
    asked = reports.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("engine_id", F.col("failure_kind").isNull().alias("good")))).alias("e"))
    ids = lambda rows: F.transform(rows, lambda x: x["engine_id"])
    rows = responses.join(asked, "request_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<engine_id: string, good: boolean>>")))
    fields = {
        "event": F.lit("search_complete"), "request_id": F.col("request_id"), "query_hash": F.sha2("query", 256), "provider_query_hash": F.sha2("provider_query", 256),
        "selected_engines": ids(F.col("e")), "successful_engines": ids(F.filter("e", lambda x: x["good"])), "failed_engines": ids(F.filter("e", lambda x: ~x["good"])),
        "cache_status": F.when(F.col("cached"), "hit").otherwise("miss"), "duration_ms": F.col("duration_ms"), "result_count": F.col("result_count"), "partial": F.col("partial"), "bangs": F.col("bangs"),
    }
    return rows.select("request_id", F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("line"))


def by_cache(reports: DataFrame) -> DataFrame:
    return reports.groupBy("engine_id", "cache_status").agg(F.count("*").alias("n"))


def over_limit(calls: DataFrame, most: int = 60) -> DataFrame:
    """Clients (client, ts) with over ``most`` calls in a minute."""
    return calls.groupBy(F.window("ts", "60 seconds").alias("w"), "client").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("client", F.col("w.start").alias("minute"), "n")
