"""From read responses to answers: merge, rank, report; and the shapes they are sent in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from beaconq.operators import errors, merge, rank, telemetry
from beaconq.sources import responses as R


def answered(requests: DataFrame, read: DataFrame, engines: DataFrame, strategy: str = "query-aware-v1", limit: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, results, reports) for requests (request_id, query) and their responses as
    ``responses.read`` gives them.

    An engine one of whose URLs is no URL loses all its results and is reported as failed.
    A request none of whose engines succeeded has a code and no results.
    """
    found = merge.normalized(merge.capped(R.results(read, engines)))
    reports = R.reports(read, merge.rejected_engines(found)).withColumn("may_follow", telemetry.may_follow(F.lit(None), F.col("result_count"), F.lit(limit)))
    merged = merge.dedup(merge.whole_engines(found))
    results = rank.top(rank.scored(merged, strategy, requests.select("request_id", "query")), limit)
    counted = results.groupBy("request_id").agg(F.count("*").alias("result_count"))
    broken = rank.ranking_errors(merged).withColumnRenamed("code", "_broken")
    answers = requests.join(telemetry.outcomes(reports), "request_id", "left").join(counted, "request_id", "left").join(broken, "request_id", "left")
    code = F.coalesce(F.when(F.col("successes").isNull(), "NO_ENGINE_SUCCEEDED"), "code", "_broken")
    answers = answers.withColumns({"code": code, "ranking": F.lit(strategy), "result_count": F.coalesce("result_count", F.lit(0).cast("long"))}).drop("_broken")
    return answers, results, reports


def result_json() -> Column:
    """A ranked row as a struct in the shape that is sent; null fields are left out of JSON."""
    names = ["url", "canonical_url", "title", "content", "published_at", "thumbnail", "category"]
    positions = F.map_from_arrays("engines", F.transform("engines", lambda e: F.col("positions")[e]))
    return F.struct(
        "rank", *names, F.try_parse_json(F.col("metadata")).alias("metadata"), F.col("engines"), positions.alias("positions"),
        F.transform_values("provider_metadata", lambda _, m: F.try_parse_json(m)).alias("provider_metadata"), "score",
    )


def ranked(results: DataFrame) -> DataFrame:
    """(request_id, results): each request's results in the shape that is sent, by rank."""
    listed = results.select("request_id", result_json().alias("r")).groupBy("request_id").agg(F.collect_list(F.struct(F.col("r.rank").alias("rank"), F.to_json("r").alias("json"))).alias("x"))
    return listed.select("request_id", F.transform(F.array_sort("x"), lambda x: F.try_parse_json(x["json"])).alias("results"))


def bodies(answers: DataFrame, results: DataFrame, reports: DataFrame, instance: str = "/v1/search") -> DataFrame:
    """(request_id, status, body): what is sent for each request, as JSON text: its answer,
    or a problem document. Results come by rank, reports by engine."""
    told = reports.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("engine_id", "failure_kind", "duration_ms", "result_count", "response_bytes", "redirect_count"))).alias("engines"))
    rows = answers.join(ranked(results), "request_id", "left").join(told, "request_id", "left")
    none = F.array().cast("array<variant>")
    fields = [c for c in ("request_id", "query", "provider_query", "bangs", "ranking", "partial", "may_have_more", "result_count", "next_cursor") if c in answers.columns]
    body = F.to_json(F.struct(*fields, F.lit(False).alias("cached"), F.coalesce("results", none).alias("results"), "engines"))
    return sent(rows, body, instance)


def sent(rows: DataFrame, body: Column, instance: str) -> DataFrame:
    """(request_id, status, body): the body, or a problem document where there is a code."""
    detail = F.lit("the request could not be answered")
    problem = errors.problem(F.col("code"), detail, F.lit(instance), F.col("request_id").cast("string"))
    bad = F.col("code").isNotNull()
    return rows.select("request_id", F.when(bad, errors.status(F.col("code"))).otherwise(200).alias("status"), F.when(bad, problem).otherwise(body).alias("body"))


def compat_bodies(answers: DataFrame, results: DataFrame, reports: DataFrame, instance: str = "/search") -> DataFrame:
    """(request_id, status, body) in the older shape: query, number and list of results, and
    engines that did not answer with their kinds of failure, left out where all did."""
    rows = answers.select("request_id", "query", "code").join(ranked(results), "request_id", "left")
    failed = reports.filter("failure_kind IS NOT NULL").groupBy("request_id").agg(F.sort_array(F.collect_list(F.array("engine_id", "failure_kind"))).alias("unresponsive_engines"))
    rows = rows.join(failed, "request_id", "left")
    listed = F.coalesce("results", F.array().cast("array<variant>"))
    return sent(rows, F.to_json(F.struct("query", F.size(listed).alias("number_of_results"), listed.alias("results"), "unresponsive_engines")), instance)
