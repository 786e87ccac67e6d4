"""Stored provider responses to provider results: classify, parse, report.

``raw_responses``: request_id, engine_id, page, status, headers (map), body, final_url,
locations (the redirects that led there, in order), duration_ms. Nothing is fetched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from beaconq.functions import classify, text as T
from beaconq.functions.urls import unwrap_redirect
from beaconq.sources import engines as E
from beaconq.sources.markup import SELECTORS, page_results
from beaconq.sources.providers import HTTP, PARSED, READERS, get, parsed, result, url_if

RESPONSES = (
    "request_id string, engine_id string, page int, status int, headers map<string,string>, body string, final_url string,"
    " locations array<string>, duration_ms long"
)
#: Media types that each kind of source may send.
MEDIA = {
    "json": ["application/json", "text/json"],
    "html": ["text/html", "application/xhtml+xml"],
    "atom": ["application/atom+xml", "application/xml", "text/xml"],
    "exa-mcp": ["application/json", "text/event-stream"],
}
MOST_REDIRECTS, MOST_RESULTS = 2, 20
REDIRECTING = {"duckduckgo-html", "google-web", "yahoo-web"}
OWN_HOSTS = {"brave-web": ["search.brave.com"]}
SENSITIVE = ["authorization", "cookie", "proxy-authorization", "x-api-key", "x-csrf-token", "origin"]


def register(engine_id: str, reader: Callable[[Column], Column]) -> None:
    """Add or replace the reader of an engine's bodies: a body column to (failure, results)."""
    READERS[engine_id] = reader


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def allowed(url: Column, hosts: Column, allow_http: bool = False) -> Column:
    """Whether an engine may be asked at a URL: https, no credentials, a host of its own."""
    scheme = url.rlike(r"(?i)^https?://") if allow_http else url.rlike(r"(?i)^https://")
    return scheme & ~url.rlike(r"(?i)^https?://[^/?#]*@") & F.array_contains(hosts, host_of(url))


def followed(method: Column, status: Column, headers: Column, source: Column, target: Column) -> Column:
    """(method, headers) of the request after a redirect: without what must not reach
    another host, and a plain GET after a 303."""
    away = host_of(source) != host_of(target)
    kept = F.when(away, F.map_filter(headers, lambda k, _: ~F.lower(k).isin(SENSITIVE))).otherwise(headers)
    return F.struct(F.when(status == 303, "GET").otherwise(method).alias("method"), kept.alias("headers"))


def header(headers: Column, name: str) -> Column:
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.get(found, F.lit(0))["value"]


def classified(responses: DataFrame) -> DataFrame:
    """Add ``failure_kind``: what status, headers, redirects and body say before parsing."""
    kinds = {e[0]: MEDIA.get(e[0], MEDIA[e[1]]) for e in E.ENGINES}
    expected = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("engine_id")]
    locations = F.coalesce("locations", F.array().cast("array<string>"))
    hops = F.when(F.size(locations) > MOST_REDIRECTS, "ENGINE_ACCESS_DENIED")
    why = classify.response_failure(
        F.col("status"), F.col("headers"), F.array_join(locations, "\n"), F.col("body"), header(F.col("headers"), "content-type"), F.octet_length(F.coalesce("body", F.lit(""))), expected
    )
    return responses.withColumn("failure_kind", F.coalesce(hops, why))


def props_results(props: Column) -> Column:
    """Results embedded in a page as data. The cap ends the group that it is reached in,
    and is not looked at again, so a later group may go past it."""
    root = F.try_parse_json(props)
    groups = F.filter(get(root, "$.render.presenter.regions.mainline", "array<variant>"), lambda g: get(g, "$.display_type") == "web-google")

    def item(v: Column) -> Column:
        return result(url_if(get(v, "$.clickUrl")), T.strip_markup(get(v, "$.title")), T.strip_markup(get(v, "$.description")))

    def good(group: Column) -> Column:
        rows = F.transform(F.coalesce(get(group, "$.results", "array<variant>"), F.array().cast("array<variant>")), item)
        return F.filter(rows, lambda r: r["url"].isNotNull() & (F.coalesce(r["title"], F.lit("")) != ""))

    lists = F.transform(groups, good)
    none = F.array().cast(f"array<{PARSED.split('array<', 1)[1].rsplit('>>', 1)[0]}>")
    short = lambda got, more: F.when(F.size(got) < MOST_RESULTS, F.slice(more, 1, MOST_RESULTS - F.size(got))).otherwise(more)
    return F.aggregate(lists, none, lambda got, more: F.concat(got, short(got, more)))


def page_outcome(engine: Column, page: Column) -> Column:
    """(failure, results) from what the selectors found."""
    link = lambda u: F.when(engine.isin(*REDIRECTING), unwrap_redirect(u)).otherwise(u)
    listed = F.transform(page["results"], lambda r: result(link(r["url"]), r["title"], r["description"], None, F.when(engine.isin("brave-web", "brave-news"), r["thumbnail"])))
    for name, hosts in OWN_HOSTS.items():
        listed = F.filter(listed, lambda r: (engine != name) | ~host_of(r["url"]).isin(hosts))
    return parsed(page["failure"], F.when(page["props"].isNotNull(), props_results(page["props"])).otherwise(listed))


def read(responses: DataFrame, engines: list[str] | None = None) -> DataFrame:
    """Add ``failure_kind`` and ``results`` to responses, in one pass. Only bodies of pages
    go to Python, and only those that are not failures already. ``engines``: which engines
    the responses are of, where that is known, so that no other readers are planned.

    What the readers make is exploded from a list of one: the optimizer does not merge a
    projection with an explode, so the expression of all readers is in the plan once,
    however often its outcome is used.
    """
    rows = classified(responses)
    fine = F.col("failure_kind").isNull()
    out = F.lit(None).cast(PARSED)
    for engine, reader in READERS.items():
        if engines is None or engine in engines:
            out = F.when(F.col("engine_id") == engine, reader(F.col("body"))).otherwise(out)
    out = F.when(fine, out)
    if engines is None or any(e in SELECTORS for e in engines):
        is_page = F.col("engine_id").isin(*SELECTORS) & fine
        page = page_results(F.when(is_page, F.coalesce("body", F.lit(""))), F.col("final_url"), F.col("engine_id"))
        rows = rows.withColumn("_page", page)
        out = F.when(is_page, page_outcome(F.col("engine_id"), F.col("_page"))).otherwise(out)
    both = rows.select("*", F.explode(F.array(out)).alias("_out"))
    # An engine that nothing reads is a failure like any other.
    why = F.coalesce("failure_kind", "_out.failure", F.when(F.col("_out").isNull(), "ENGINE_PARSE_FAILED"))
    return both.withColumn("failure_kind", why).withColumn("results", F.when(why.isNull(), F.col("_out.results"))).drop("_out", "_page")


def results(read_rows: DataFrame, engines: DataFrame) -> DataFrame:
    """One row for each result of responses that were read, with the engine's place and weight."""
    each = read_rows.select("request_id", "engine_id", F.posexplode("results").alias("nth", "r"))
    each = each.select("request_id", "engine_id", (F.col("nth") + 1).alias("position"), "r.*")
    return each.join(F.broadcast(engines.select("engine_id", "ordinal", "weight", "result_category")), "engine_id").withColumnRenamed("result_category", "category")


def reports(read_rows: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """One row for each engine that was asked for a request: steps summed, failure if any.

    ``rejected`` (request_id, engine_id): engines whose results were all dropped later on.
    """
    by_engine = read_rows.groupBy("request_id", "engine_id").agg(
        F.first("failure_kind", ignorenulls=True).alias("failure_kind"),
        F.sum("duration_ms").alias("duration_ms"),
        F.sum(F.size(F.coalesce("results", F.array().cast(PARSED.split("results: ")[1][:-1])))).alias("result_count"),
        F.sum(F.octet_length(F.coalesce("body", F.lit("")))).alias("response_bytes"),
        F.sum(F.size(F.coalesce("locations", F.array().cast("array<string>")))).alias("redirect_count"),
        F.count("*").alias("upstream_requests"),
    )
    if rejected is None:
        return by_engine
    bad = rejected.select("request_id", "engine_id", F.lit("ENGINE_PARSE_FAILED").alias("_bad")).distinct()
    both = by_engine.join(bad, ["request_id", "engine_id"], "left")
    return both.withColumn("failure_kind", F.coalesce("failure_kind", "_bad")).withColumn("result_count", F.when(F.col("failure_kind").isNull(), F.col("result_count")).otherwise(0)).drop("_bad")
