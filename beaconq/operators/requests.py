"""The query side: shortcuts, validation, and choice of engines, for many requests at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

LEAST_LIMIT, MOST_LIMIT, MOST_ENGINES, MOST_CATEGORIES, MOST_CHARS, MOST_TIMEOUT = 10, 20, 20, 3, 499, 8000


@F.pandas_udf(StringType())
def normalize_query(queries: pd.Series) -> pd.Series:  # pragma: no cover - runs in workers
    from beaconq.operators.requests import normalized_query

    return queries.map(normalized_query)


@F.pandas_udf(StringType())
def query_failure(queries: pd.Series) -> pd.Series:  # pragma: no cover - runs in workers
    from beaconq.operators.requests import query_error

    return queries.map(query_error)


def normalized_query(query: str | None) -> str | None:
    """NFC, trimmed, white space collapsed outside double quotes; None if ``query_error`` has a reason."""
    return None if query_error(query) else _normalized(query)


def query_error(query: str | None) -> str | None:
    """Why a query cannot be asked: control characters, empty, or too long."""
    import unicodedata

    if any(unicodedata.category(c) == "Cc" for c in query or ""):
        return "control_character"
    text = _normalized(query or "")
    return "empty" if not text else "too_long" if len(text) > MOST_CHARS else None


def _normalized(query: str) -> str:
    import re
    import unicodedata

    parts = re.findall(r'"(?:\\.|[^"\\])*"?|(?:\\.|[^"\\])+|\\', unicodedata.normalize("NFC", query).strip(), re.DOTALL)
    return "".join(p if p.startswith('"') else re.sub(r"\s+", " ", p) for p in parts)


def clean_list(csv: Column) -> Column:
    return F.array_sort(F.array_distinct(listed(csv)))


def violations(requests: DataFrame) -> DataFrame:
    """Add the list of rules that each request breaks (empty: none)."""
    c = F.col
    rules = {
        "query_xor_q": F.coalesce(c("query"), F.lit("")).eqNullSafe("") == F.coalesce(c("q"), F.lit("")).eqNullSafe(""),
        "too_many_engines": F.size("engines") > MOST_ENGINES,
        "too_many_categories": F.size("categories") > MOST_CATEGORIES,
        "page_xor_cursor": c("page").isNotNull() & c("cursor").isNotNull(),
        "page": c("page") < 1,
        "limit": ~c("limit").between(LEAST_LIMIT, MOST_LIMIT),
        "timeout": ~c("timeout_ms").between(1, MOST_TIMEOUT),
    }
    return requests.withColumn("violations", F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()])))


def safe_search(value: Column) -> Column:
    return F.when(value.isin("0", "off"), "off").when(value.isin("1", "moderate"), "moderate").when(value.isin("2", "strict"), "strict")


def one_of(value: Column, *known: str) -> Column:
    """The value if it is known, else null, which stands for the default."""
    return F.when(value.isin(*known), value)


def bounded_integer(value: Column, fallback: int, least: int, most: int) -> Column:
    """The integer that a text begins with, brought between the bounds; the fallback without one."""
    found = F.try_to_number(F.regexp_extract(value, r"^\s*([+-]?[0-9]{1,18})", 1), F.lit("S999999999999999999")).cast("long")
    return F.coalesce(F.greatest(F.lit(least).cast("long"), F.least(F.lit(most).cast("long"), found)), F.lit(fallback).cast("long"))


def whole_number(value: Column) -> Column:
    """An unsigned whole number of 32 bits, or null."""
    return F.when(value.rlike(r"^\+?[0-9]{1,10}$"), value.cast("long")).cast("long")


#: Names of parameters that differ on the older route.
OLDER = {"page": "pageno", "locale": "language", "safe_search": "safesearch"}


def parameters(query_string: Column) -> Column:
    """A query string as a map of decoded names to values; the last of equal names counts."""
    pairs = F.filter(F.split(F.regexp_replace(query_string, r"^\?", ""), "&"), lambda p: p != "")
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.contains(p, F.lit("=")), F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")), F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v"),
        ),
    )
    later = lambda k, i: F.exists(F.slice(decoded, i + 2, F.size(decoded)), lambda o: o["k"] == k)
    return F.map_from_entries(F.filter(decoded, lambda p, i: ~later(p["k"], i)))


def parsed(rows: DataFrame, older: bool = False) -> DataFrame:
    """Requests of (request_id, query_string): every field as the interface reads it. What
    cannot be read is null, as if it were not given. ``failure`` marks the older route
    without ``format=json``."""
    p = lambda k: F.col("_p")[OLDER.get(k, k) if older else k]
    fields = {
        "query": F.lit(None).cast("string") if older else p("query"), "q": p("q"), "engines": listed(p("engines")), "categories": listed(p("categories")),
        "page": whole_number(p("page")), "cursor": p("cursor"), "limit": whole_number(p("limit")), "locale": p("locale"), "country": p("country"),
        "safe_search": safe_search(p("safe_search")), "time_range": one_of(p("time_range"), "day", "week", "month", "year"),
        "ranking": one_of(p("ranking"), "query-aware-v1", "rrf-v1", "compat-v1"), "timeout_ms": whole_number(p("timeout_ms")),
        "failure": F.when(~F.coalesce(F.col("_p")["format"] == "json", F.lit(False)), "INVALID_REQUEST") if older else F.lit(None).cast("string"),
    }
    return rows.withColumn("_p", parameters(F.col("query_string"))).select("request_id", *[c.alias(k) for k, c in fields.items()])


def listed(csv: Column) -> Column:
    """The parts of a comma-separated text, trimmed, without empty ones."""
    return F.coalesce(F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def combined(requests: DataFrame) -> DataFrame:
    """Requests (engines, categories) with what their shortcuts (bang_engines,
    bang_categories, status) add; ``failure`` says why that cannot be: an unknown or
    conflicting shortcut, no word left, or shortcuts of one kind with a choice of the other."""
    size = lambda c: F.size(F.col(c)) > 0
    why = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(size("bang_engines") & size("categories"), "engine bangs cannot be combined with explicit categories")
        .when(size("bang_categories") & size("engines"), "category bangs cannot be combined with explicit engines")
    )
    both = lambda a, b: F.array_sort(F.array_distinct(F.concat(a, b)))
    return requests.withColumns({"failure": why, "engines": both("engines", "bang_engines"), "categories": both("categories", "bang_categories")})


def resolve_bangs(requests: DataFrame, bangs: DataFrame) -> DataFrame:
    """Resolve shortcuts in ``query``: provider_query, bangs, engines, categories, status.

    ``!x`` is a shortcut, a lone ``!`` and ``\\!x`` are words. Status is ok, unknown
    (some shortcut is), conflict (engines and categories mixed) or empty (no word left).
    The shortcuts are a small fixed table, so its join is a broadcast.
    """
    word = F.col("word")
    words = requests.select("request_id", F.posexplode(F.filter(F.split(F.trim("query"), r"\s+"), lambda w: w != "")).alias("pos", "word"))
    words = words.withColumn("alias", F.when(word.startswith("!") & (F.char_length("word") > 1), F.lower(F.substr(word, F.lit(2)))))
    words = words.join(F.broadcast(bangs), "alias", "left")
    kept = F.when(F.col("alias").isNull(), F.when(word.startswith("\\!"), F.substr(word, F.lit(2))).otherwise(word))
    found = words.groupBy("request_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kept.isNotNull(), F.struct("pos", kept.alias("w"))))), lambda x: x["w"]), " ").alias("provider_query"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("alias").isNotNull(), F.struct("pos", "alias")))), lambda x: x["alias"]).alias("bangs"),
        F.bool_or(F.col("alias").isNotNull() & F.col("kind").isNull()).alias("_unknown"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("kind") == kind, F.col("targets")))))).alias(name) for kind, name in (("engine", "bang_engines"), ("category", "bang_categories"))],
    )
    status = (
        F.when(F.col("_unknown"), "unknown")
        .when((F.size("bang_engines") > 0) & (F.size("bang_categories") > 0), "conflict")
        .when(F.col("provider_query") == "", "empty")
        .otherwise("ok")
    )
    return found.withColumn("status", status).drop("_unknown")


def select_engines(requests: DataFrame, engines: DataFrame) -> DataFrame:
    """One row for each request (engines, categories) and chosen engine, with the
    engine's columns: the ids asked for; else those of the categories; else all."""
    e = F.broadcast(engines.withColumnRenamed("categories", "engine_categories"))
    asked, of = F.col("engines"), F.col("categories")
    fits = F.when(F.size(asked) > 0, F.array_contains(asked, F.col("engine_id"))).when(
        F.size(of) > 0, F.arrays_overlap(of, F.col("engine_categories"))
    ).otherwise(F.lit(True))
    return requests.join(e, fits)


def selection_failures(requests: DataFrame, engines: DataFrame, switches: dict[str, bool] | None = None) -> DataFrame:
    """(request_id, code, detail) for requests (engines, categories) that no search can
    answer: an engine that does not exist or is switched off, or no engine at all. The
    first bad engine in the request's order is named; engines behind a switch are off
    unless ``switches`` has it."""
    on = [k for k, v in (switches or {}).items() if v]
    e = F.broadcast(engines.select(F.col("engine_id").alias("_id"), "default_enabled", "switch", F.col("ordinal").alias("_place"), F.col("categories").alias("_of")))
    named = requests.select("request_id", F.posexplode("engines").alias("nth", "engine_id")).join(e, F.col("_id") == F.col("engine_id"), "left")
    by_kind = requests.filter(F.size("engines") == 0).join(e, (F.size("categories") == 0) | F.arrays_overlap("categories", "_of"), "left")
    by_kind = by_kind.filter(F.coalesce("default_enabled", F.lit(True))).select("request_id", F.col("_place").alias("nth"), F.col("_id").alias("engine_id"), "_id", "switch")
    off = F.col("switch").isNotNull() & ~F.col("switch").isin(on) if on else F.col("switch").isNotNull()
    both = named.select("request_id", "nth", "engine_id", "_id", "switch").unionByName(by_kind)
    code = F.when(F.col("engine_id").isNull(), "NO_ENGINE_SUCCEEDED").when(F.col("_id").isNull(), "UNKNOWN_ENGINE").when(off, "ENGINE_DISABLED")
    first = both.withColumn("code", code).filter("code IS NOT NULL").groupBy("request_id").agg(F.min_by(F.struct("code", F.col("engine_id").alias("detail")), F.coalesce("nth", F.lit(0))).alias("x"))
    return first.select("request_id", "x.code", "x.detail")


def capability_failure(page: Column, time_range: Column, max_page: Column, time_ranges: Column) -> Column:
    unsupported = ((max_page > 0) & (page > max_page)) | (time_range.isNotNull() & ~F.array_contains(time_ranges, time_range))
    return F.when(unsupported, "UNSUPPORTED_CAPABILITY")


def page_rows(rows: DataFrame, page: Column, limit: Column) -> DataFrame:
    """The rows of a page of ``limit`` by their ``rank``, page one first."""
    return rows.filter(F.col("rank").between((page - 1) * limit + 1, page * limit))


def remaining_ms(deadline_ms: Column, now_ms: Column) -> Column:
    return F.greatest(deadline_ms - now_ms, F.lit(0).cast("long"))
