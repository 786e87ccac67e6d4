"""Cache keys and cache decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PARTIAL_TTL, DEFAULT_TTL = 20, 180
#: Versions that are part of every key.
API_VERSION, REGISTRY_VERSION, RANKING_VERSION = "v1", "2026-07-27.1", "2026-07-26.1"
#: Seconds that values of a conversation with a provider are kept.
CONTINUATION_TTL = {"duckduckgo-html": 900, "startpage-web": 3600, "semantic-scholar": 300}
#: The fields of a query that its answers depend on, besides engines and parsers.
QUERY_FIELDS = ["query", "page", "limit", "locale", "country", "safe_search", "time_range", "ranking"]


def json_key(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of fields in name order, nulls written out."""
    parts = []
    for name in sorted(fields):
        value = F.regexp_extract(F.to_json(F.struct(fields[name].alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
        parts.append(F.concat(F.lit(f'"{name}":'), value))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def cache_key(fields: dict[str, Column], prefix: str = "cache/") -> Column:
    """The key of a whole answer, the same for any order of engines, categories and
    parsers. ``fields``: ``QUERY_FIELDS``, engines, categories, parsers, cursor_hash."""
    given = {k: fields[k] for k in (*QUERY_FIELDS, "cursor_hash")}
    lists = {k: F.array_sort(fields[k]) for k in ("engines", "categories", "parsers")}
    fixed = {"api_version": F.lit(API_VERSION), "registry": F.lit(REGISTRY_VERSION), "ranking_version": F.lit(RANKING_VERSION)}
    return F.concat(F.lit(f"{prefix}{API_VERSION}/search/"), json_key(**given, **lists, **fixed))


def engine_cache_key(fields: dict[str, Column], engine_id: Column, parser_version: Column, prefix: str = "cache/") -> Column:
    """The key of one engine's part of an answer."""
    one = fields | {"engines": F.array(engine_id), "parsers": F.array(F.concat(engine_id, F.lit(":"), parser_version))}
    return F.replace(cache_key(one, prefix), F.lit("/search/"), F.concat(F.lit("/engine/"), engine_id, F.lit("/")))


def cursor_hash(fields: dict[str, Column]) -> Column:
    """What a cursor is bound to: the query, its engines and categories in their order,
    and all that the answers depend on but the page."""
    return json_key(**{k: fields[k] for k in (*QUERY_FIELDS, "engines", "categories") if k != "page"})


def state_key(prefix: str, engine_id: Column, key: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), engine_id, key)


def continuation_key(query: Column, locale: Column, safe_search: Column, time_range: Column) -> Column:
    """The key of what a provider wants to see again with the next page of a query."""
    part = lambda c: F.coalesce(c, F.lit("\u0001"))
    return F.concat(F.lit("continuation:"), F.sha2(F.concat_ws("\0", query, part(locale), part(safe_search), part(time_range)), 256))


def continuations(values: DataFrame, now: Column) -> DataFrame:
    """The last value of each (engine_id, key) of (engine_id, key, value, at) that is not
    older than its engine keeps it; ``at`` and ``now`` are seconds."""
    ttl_of = F.create_map(*[F.lit(x) for kv in CONTINUATION_TTL.items() for x in kv])[F.col("engine_id")]
    last = values.groupBy("engine_id", "key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    return last.filter(F.col("at") + F.coalesce(ttl_of, F.lit(DEFAULT_TTL)) > now)


def ttl(partial: Column, least_ttl: Column) -> Column:
    return F.when(partial, PARTIAL_TTL).otherwise(F.coalesce(least_ttl, F.lit(DEFAULT_TTL)))


def answer_entries(answers: DataFrame, selected: DataFrame, now: Column) -> DataFrame:
    """Entries (key, body, negative, expires_at) for answers (request_id, key, partial,
    body): the least TTL of the engines asked (request_id, response_ttl_s), or little if partial."""
    least = selected.groupBy("request_id").agg(F.min("response_ttl_s").alias("least"))
    rows = answers.join(least, "request_id", "left")
    return rows.select("key", "body", F.lit(False).alias("negative"), (now + ttl(F.col("partial"), F.col("least"))).alias("expires_at"))


def engine_entries(reports: DataFrame, now: Column) -> DataFrame:
    """Entries for each engine's part (key, body, failure_kind, response_ttl_s,
    negative_ttl_s): a failure is kept too, for its own time, to be given again."""
    bad = F.col("failure_kind").isNotNull()
    kept = F.when(bad, F.col("negative_ttl_s")).otherwise(F.col("response_ttl_s"))
    return reports.select("key", F.when(~bad, F.col("body")).alias("body"), "failure_kind", bad.alias("negative"), (now + kept).alias("expires_at"))


def probe(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (key) with ``hit``: null, positive or negative, of entries (key,
    negative, expires_at) that are still alive; the last to expire decides, of equal
    ones a negative one. Other columns of the entries (body, failure_kind) come along."""
    rest = [c for c in cache.columns if c not in ("key", "negative", "expires_at")]
    last = F.struct("expires_at", "negative")
    alive = cache.filter(F.col("expires_at") > now).groupBy("key").agg(*[F.max_by(c, last).alias(c) for c in ("negative", *rest)])
    return requests.join(alive, "key", "left").withColumn("hit", F.when(F.col("negative"), "negative").when(~F.col("negative"), "positive")).drop("negative")


def to_compute(requests: DataFrame, answers: DataFrame, parts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """What the caches leave to do, for (request_id, engine_id, key, engine_key): the
    engines still to be asked, and those that a cached part or failure answers. Requests
    whose whole answer is cached are in neither."""
    asked = probe(requests, answers, now).filter("hit IS NULL").select(*requests.columns)
    found = probe(asked.withColumnRenamed("key", "answer_key").withColumnRenamed("engine_key", "key"), parts, now)
    return found.filter("hit IS NULL").select("request_id", "engine_id", "key"), found.filter("hit IS NOT NULL")


def with_cursors(selected: DataFrame, cursors: DataFrame) -> DataFrame:
    """Engines of requests (request_id, engine_id) with the cursor that each brought back,
    of (request_id, engine_cursors: map)."""
    each = cursors.select("request_id", F.explode("engine_cursors").alias("engine_id", "engine_cursor"))
    return selected.join(each, ["request_id", "engine_id"], "left")
