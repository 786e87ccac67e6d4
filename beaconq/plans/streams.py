"""Queries that run as streams, over the given tables laid out in steps of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconq.operators import crawl
from beaconq.plans import search as S
from beaconq.plans.catalog import ORACLES, PAGES, query
from beaconq.session import shared_path
from beaconq.streaming import replay, sinks, state, ttl

PARTS = 4
#: Seconds in which all pages come once.
HALF_DAY = 12 * 3600


def second(n):
    return F.timestamp_seconds(n)


def in_steps(rows, moment: str, parts: int = PARTS):
    """Add ``part``: which of ``parts`` equal spans of time a row is in, in whole microseconds."""
    at = f"unix_micros({moment})"
    low, high = rows.agg(F.expr(f"min({at})"), F.expr(f"max({at})")).first()
    low, span = (0, 1) if low is None else (low, high - low + 1)
    return rows.withColumn("part", F.expr(f"({at} - ({low})) * {parts} div {span}").cast("int"))


@query(ORACLES["rate_limit_window"])
def rate_limit_stream(spark, d):
    """Clients over the limit, as a stream; a row a day later, of no client, closes the last minute. Its own minute stays open.
    Calls of no known moment never come in a stream of moments; they are counted beside it, as a minute of their own."""
    calls = S.read(spark, d, "events").select((F.col("user_id") % 3).alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    timeless = calls.filter("ts IS NULL").groupBy("client", F.col("ts").alias("minute")).agg(F.count("*").alias("n")).filter("n > 1")
    calls = in_steps(calls.filter("ts IS NOT NULL"), "ts")
    end = calls.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(None).cast("long").alias("client"), "ts", F.lit(PARTS).alias("part"))
    both = calls.unionByName(end)
    found = replay.replayed(both, "part", PARTS + 1, lambda rows: state.over_limit_stream(rows, 1), "calls")
    return found.unionByName(timeless).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


def puts(rows, key, at, order_by, tie, value, expires_at):
    none = F.lit(None).cast("string")
    return rows.select(key.cast("string").alias("key"), at.alias("at"), F.lit(True).alias("put"), order_by.cast("long").alias("order_by"), tie.cast("string").alias("tie"), value.cast("string").alias("value"), expires_at.alias("expires_at"), none.alias("request_id"))


def asks(rows, key, at, request_id):
    none = F.lit(None)
    return rows.select(
        key.cast("string").alias("key"), at.alias("at"), F.lit(False).alias("put"), none.cast("long").alias("order_by"), none.cast("string").alias("tie"), none.cast("string").alias("value"), none.cast("timestamp").alias("expires_at"),
        request_id.cast("string").alias("request_id"),
    )


@query(ORACLES["ttl_cache_hits"])
def ttl_cache_stream(spark, d):
    """Events put values of a user that live up to a second given by their number; customers ask at second 300."""
    n = F.col("event_id")
    entries = puts(S.read(spark, d, "events"), F.col("user_id"), second(F.lit(1)), n, (n % 7 == 0), F.when(n % 7 == 0, "negative").otherwise("positive"), second(n)).withColumn("part", F.pmod(F.xxhash64("order_by"), F.lit(2)).cast("int"))
    asked = asks(S.read(spark, d, "customer"), F.col("c_custkey"), second(F.lit(300)), F.col("c_custkey")).withColumn("part", F.lit(2))
    found = replay.replayed(ttl.last_of_moment(entries, "part").unionByName(asked), "part", 3, lambda rows: ttl.answered(rows, "1 hour"), "cache")
    return found.select(F.col("request_id").cast("long").alias("c_custkey"), F.col("value").alias("hit"))


@query(ORACLES["continuations"])
def continuation_stream(spark, d):
    """Continuations as they come in, of which those asked for at second 1000 that are still alive are given."""
    n = F.col("event_id")
    engine = F.element_at(F.array(*map(F.lit, ("duckduckgo-html", "startpage-web", "semantic-scholar", "github"))), (n % 4 + 1).cast("int"))
    lives = F.element_at(F.array(*map(F.lit, (900, 3600, 300, 180))), (n % 4 + 1).cast("int"))
    key = F.concat_ws("|", engine, (n % 100).cast("string"))
    events = S.read(spark, d, "events")
    given = puts(events, key, second(F.lit(1)), n, F.lit(""), n, second(n + lives)).withColumn("part", F.pmod(F.xxhash64("order_by"), F.lit(2)).cast("int"))
    asked = asks(events.select(key.alias("k")).distinct(), F.col("k"), second(F.lit(1000)), F.col("k")).withColumn("part", F.lit(2))
    found = replay.replayed(ttl.last_of_moment(given, "part").unionByName(asked), "part", 3, lambda rows: ttl.answered(rows, "1 hour"), "continuations").filter("value IS NOT NULL")
    part = F.split("key", r"\|")
    return found.select(part[0].alias("engine_id"), part[1].cast("long").alias("key"), F.col("value").cast("long").alias("value"))


def upserted(spark, rows, table, parts):
    """All of a stream's rows in the table, a batch a step."""
    source = replay.laid_out(rows, "part", parts, "sink-in")
    stream = replay.stream_of(spark, source, rows.drop("part").schema)
    stream.writeStream.foreachBatch(table.upsert).option("checkpointLocation", shared_path(spark, "sink-state")).trigger(availableNow=True).start().awaitTermination()
    return table.rows()


@query("""SELECT user_id::VARCHAR AS key, arg_max(event_id % 5 = 0, event_id) AS negative, max(event_id + CASE WHEN event_id % 5 = 0 THEN 30 ELSE 300 END * (event_id % 5 + 1)) FILTER (event_id = m) AS expires_at
 FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id""")
def cache_sink(spark, d):
    """Cache entries written as they come; the last of a key stands."""
    n = F.col("event_id")
    rows = S.read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), (n % 5 == 0).alias("negative"), n.alias("nth"), (n + F.when(n % 5 == 0, 30).otherwise(300) * (n % 5 + 1)).alias("expires_at"))
    table = sinks.Table(spark, shared_path(spark, "cache-table"), "key", sinks.latest("key", "nth"), "key string, negative boolean, nth long, expires_at long", 16)
    steps = rows.withColumn("part", F.pmod(F.xxhash64("nth"), F.lit(3)).cast("int"))
    return upserted(spark, steps, table, 3).select("key", "negative", "expires_at")


@query(f"""WITH {PAGES}, n AS (SELECT link, max(page_id % 3) AS step FROM links WHERE nth <= 12 AND link NOT IN (SELECT url FROM p) GROUP BY link)
 SELECT sha256(link) AS digest, link AS url, TIMESTAMP '2026-01-08 00:00:00' + step * INTERVAL 1 DAY AS expires_at FROM n""")
def frontier_sink(spark, d):
    """New links of a third of the pages each day go to the frontier, to be kept a week from when they were last seen."""
    raw = S.read(spark, d, "pages")
    found = crawl.pages(raw).select(F.explode(F.slice("links", 1, crawl.FRONTIER_LINKS)).alias("url"), (F.col("page_id") % 3).cast("int").alias("part"))
    known = raw.select(crawl.crawl_url(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()
    day = F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.col("part"))
    rows = found.distinct().join(known, "url", "left_anti").select(crawl.digest(F.col("url")).alias("digest"), "url", (day + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), "part")
    table = sinks.Table(spark, shared_path(spark, "frontier-table"), "digest", sinks.latest("digest", "expires_at"), "digest string, url string, expires_at timestamp", 16)
    return upserted(spark, rows, table, 3).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))


@query("SELECT DISTINCT url FROM (SELECT url FROM pages)")
def new_pages_stream(spark, d):
    """Every page comes twice, the second time an hour later, and is new once. All come within
    half a day however many they are, as a page that comes again after a day is new again."""
    n = F.coalesce("page_id", F.lit(0))
    first = S.read(spark, d, "pages").select("url", second(F.pmod(n, F.lit(HALF_DAY)) + 1).alias("ts")).withColumn("part", F.lit(0))
    again = first.select("url", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit(1).alias("part"))
    return replay.replayed(first.unionByName(again), "part", 2, state.new_pages, "page-arrivals").select("url")
