"""All queries of the search engine by name, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconq.functions import classify, text as T
from beaconq.functions.urls import canonicalized, crawlable, unwrap_redirect
from beaconq.operators import cache, crawl, merge, postings, rank, requests, retrieve, telemetry
from beaconq.plans import search as S
from beaconq.sources import engines as E
from beaconq.streaming import state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = " ".join(sql.split()) if "--" not in sql else sql
        return f

    return add


# ---- SQL pieces ----
def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda w: w <> '')"


def toks(x: str) -> str:
    return f"list_sort(list_distinct({words(x)}))"


def cov(q: str, t: str) -> str:
    return (
        f"(CASE WHEN len({q}) = 0 THEN 0.0 ELSE len(list_filter({q}, lambda a: list_contains({t}, a) OR (length(a) >= 4 AND "
        f"len(list_filter({t}, lambda b: starts_with(b, a))) > 0)))::DOUBLE / len({q}) END)"
    )


ASKED = "asked AS (SELECT item_id AS request_id, text AS query FROM benchmark)"
ENDS = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
TERMS = f"{ASKED}, terms AS (SELECT request_id, unnest({toks('query')}) AS term FROM asked)"
LISTS = f"""{TERMS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words('text')}) AS term FROM documents)
       WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
good AS (SELECT DISTINCT doc_id, 1 AS good FROM labels WHERE quality = 1),
hits AS (SELECT h.*, d.n_chars, good FROM (SELECT request_id, doc_id, sum(tf) AS tf, count(*) AS covered FROM terms JOIN tf USING (term) GROUP BY ALL) h
         JOIN documents d USING (doc_id) LEFT JOIN good USING (doc_id)),
lists AS (
  SELECT request_id, doc_id, 'tf' AS engine_id, 0 AS ordinal, 1.0::DOUBLE AS weight, row_number() OVER (PARTITION BY request_id ORDER BY tf DESC, doc_id) AS position FROM hits
  UNION ALL SELECT request_id, doc_id, 'coverage', 1, 1.25, row_number() OVER (PARTITION BY request_id ORDER BY covered DESC, n_chars, doc_id) FROM hits
  UNION ALL SELECT request_id, doc_id, 'quality', 2, 0.9, row_number() OVER (PARTITION BY request_id ORDER BY tf DESC, doc_id) FROM hits WHERE good = 1)"""
PARTS = [f"max(CASE WHEN ordinal = {i} THEN {{}} END)" for i in range(3)]  # a list has a URL once at most
RRF = "0.0::DOUBLE + " + " + ".join(f"coalesce({p.format('weight / (60 + position)')}, 0)" for p in PARTS)
PRODUCT = "(1.0::DOUBLE * " + " * ".join(f"coalesce({p.format('weight')}, 1)" for p in PARTS) + " * count(*))"
COMPAT = "0.0::DOUBLE + " + " + ".join(f"coalesce({PRODUCT} / {p.format('position')}, 0)" for p in PARTS)
MERGED = f"""{LISTS},
res AS (SELECT l.*, 'https://' || source || '.example.org/d/' || doc_id AS canonical_url, array_to_string(string_split(text, ' ')[1:8], ' ') AS title,
        text AS content, CAST(1990 + doc_id % 35 AS INTEGER) AS year FROM lists l JOIN documents d USING (doc_id) WHERE position <= 20),
merged AS (SELECT request_id, canonical_url, any_value({ENDS.format('title')}) AS title, any_value({ENDS.format('content')}) AS content, any_value(year) AS year,
  count(DISTINCT engine_id) AS n_engines, count(*) AS n, arg_min(engine_id, ordinal) AS first_list, {RRF} + 0.10::DOUBLE * ln(1.0 + count(DISTINCT engine_id)) AS rrf,
  {COMPAT} AS compat, min(position) AS best FROM res GROUP BY request_id, canonical_url)"""


def topk(score: str, rows: str) -> str:
    return f"""SELECT request_id, rank, canonical_url, round(score, 6) AS score, n_engines FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, canonical_url) AS rank FROM (SELECT *, {score} AS score FROM {rows})) WHERE rank <= 10"""


# ---- Text, URLs ----
@query(f"SELECT doc_id, len({words('text')}) AS n_words, len({toks('text')}) AS n_tokens, {toks('text')}[1] AS first_token FROM documents")
def lexical_tokens(spark, d):
    t = T.tokens(F.col("text"))
    return S.texts(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"), F.size(t).alias("n_tokens"), F.try_element_at(t, F.lit(1)).alias("first_token"))


@query("""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g'),
 '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))) AS plain_md5 FROM pages""")
def strip_markup(spark, d):
    return S.texts(spark, d, "pages", "page_id", "html").select("page_id", F.md5(T.strip_markup(F.col("html"))).alias("plain_md5"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
 q AS (SELECT page_id, CASE WHEN regexp_matches(string_split(u, '?')[1], '^https?://[^/]+$') THEN string_split(u, '?')[1] || '/' ELSE string_split(u, '?')[1] END AS base,
   list_filter(string_split(CASE WHEN contains(u, '?') THEN regexp_replace(u, '^[^?]*\\?', '') ELSE '' END, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')
     AND string_split(lower(x), '=')[1] NOT IN ('gclid', 'fbclid', 'mc_cid', 'mc_eid', 'ref_src')) AS kv FROM p)
 SELECT page_id, base || CASE WHEN len(kv) = 0 THEN '' ELSE '?' || array_to_string(list_transform(list_sort(list_transform(kv, lambda x: {'k': string_split(x, '=')[1],
   'v': CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END})), lambda x: x.k || '=' || x.v), '&') END AS canonical_url FROM q""")
def url_canonicalize(spark, d):
    return canonicalized(S.read(spark, d, "pages").select("page_id", "url")).select("page_id", "canonical_url")


@query("""WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://duckduckgo.com/l/?uddg=' WHEN 1 THEN 'https://www.google.com/url?q='
 WHEN 2 THEN 'https://r.search.yahoo.com/x/RU=' ELSE '' END AS head, url FROM pages) SELECT page_id, url AS target FROM t""")
def redirect_unwrap(spark, d):
    coded = F.url_encode("url")
    n = F.col("page_id") % 4
    wrapped = (
        F.when(n == 0, F.concat(F.lit("https://duckduckgo.com/l/?uddg="), coded)).when(n == 1, F.concat(F.lit("https://www.google.com/url?q="), coded))
        .when(n == 2, F.concat(F.lit("https://r.search.yahoo.com/x/RU="), coded, F.lit("/RK=0"))).otherwise(F.col("url"))
    )
    return S.read(spark, d, "pages").select("page_id", unwrap_redirect(wrapped).alias("target"))


@query("""SELECT page_id, starts_with(url, 'https://') AND NOT regexp_matches(url, '^https://(localhost|[^/]*\\.internal|[^/]*\\.localhost|10\\.|127\\.|192\\.168\\.)') AS ok FROM pages""")
def crawl_url_filter(spark, d):
    return S.read(spark, d, "pages").select("page_id", crawlable(F.col("url")).alias("ok"))


@query("""WITH y AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y FROM orders), m AS (SELECT *, max(y) OVER (PARTITION BY o_custkey) - y AS age FROM y)
 SELECT o_orderkey, CASE WHEN age = 0 THEN 0.05 WHEN age = 1 THEN 0.04 WHEN age BETWEEN 2 AND 5 THEN 0.02 ELSE 0.0 END::DOUBLE AS bonus FROM m""")
def freshness(spark, d):
    from pyspark.sql import Window as W

    year = T.publication_year(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = S.read(spark, d, "orders").select("o_custkey", "o_orderkey", year.alias("y"))
    return rows.select("o_orderkey", T.freshness_bonus(F.col("y"), F.max("y").over(W.partitionBy("o_custkey"))).alias("bonus"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE - 1 WHEN 1 THEN o_orderdate::DATE - 7
 WHEN 2 THEN (o_orderdate::DATE - INTERVAL 1 MONTH)::DATE ELSE (o_orderdate::DATE - INTERVAL 12 MONTH)::DATE END AS since FROM orders""")
def calendar_back(spark, d):
    span = F.element_at(F.array(*map(F.lit, ("day", "week", "month", "year"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return S.read(spark, d, "orders").select("o_orderkey", T.days_back(F.to_date("o_orderdate"), span).alias("since"))


# ---- Requests ----
ALIASES = sorted(a for a, _, _ in E.bang_rows()) + ["nosuch"]


BANG_VALUES = ", ".join(f"('{a}', '{k}', {t!r})" for a, k, t in E.bang_rows())


ENGINE_VALUES = ", ".join(f"({i}, '{e[0]}', {e[2]!r}, {e[3]}, {e[4]})" for i, e in enumerate(E.ENGINES))


USER_TURNS = "SELECT concat(conv_id, ':', turn) AS request_id, conv_id + turn AS n, text FROM conversations WHERE role = 'user'"


def user_turns(spark, d):
    """(request_id, n, text): every user turn as a request; n deals out what is planted."""
    turns = S.read(spark, d, "conversations").filter("role = 'user'")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), (F.col("conv_id") + F.col("turn")).alias("n"), "text")


@query(f"""WITH bangs(alias, kind, targets) AS (VALUES {BANG_VALUES}),
 q AS (SELECT request_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS words, {ALIASES!r}[CAST(n % {len(ALIASES)} + 1 AS INTEGER)] AS alias, n % 3 > 0 AS has FROM ({USER_TURNS}))
 SELECT request_id, words AS provider_query, CASE WHEN has THEN q.alias ELSE '' END AS bang,
  CASE WHEN has AND kind = 'engine' THEN array_to_string(list_sort(targets), ',') ELSE '' END AS engines, CASE WHEN has AND kind = 'category' THEN targets[1] ELSE '' END AS categories,
  CASE WHEN has AND kind IS NULL THEN 'unknown' WHEN words = '' THEN 'empty' ELSE 'ok' END AS status FROM q LEFT JOIN bangs b ON q.alias = b.alias""")
def bang_resolution(spark, d):
    """Whole texts of all user turns; in most, a shortcut is put after the first word or at the end."""
    n = F.col("n")
    alias = F.element_at(F.array(*map(F.lit, ALIASES)), (n % len(ALIASES) + 1).cast("int"))
    bang = F.when(n % 3 > 0, F.concat(F.lit("!"), alias))
    w = F.split(F.col("text"), r"\s+", 2)
    text = F.when(n % 2 == 0, F.concat_ws(" ", w[0], bang, F.get(w, F.lit(1)))).otherwise(F.concat_ws(" ", "text", bang))
    rows = requests.resolve_bangs(user_turns(spark, d).select("request_id", text.alias("query")), E.bangs(spark))
    return rows.select("request_id", "provider_query", F.array_join("bangs", ",").alias("bang"), F.array_join("bang_engines", ",").alias("engines"), F.array_join("bang_categories", ",").alias("categories"), "status")


@query(f"""WITH e(ordinal, engine_id, cats, weight, ttl) AS (VALUES {ENGINE_VALUES}), r AS (SELECT request_id, n % 3 AS n FROM ({USER_TURNS}))
 SELECT request_id, CAST(ordinal AS INTEGER) AS ordinal, engine_id FROM r JOIN e ON CASE n WHEN 0 THEN engine_id IN ('github', 'arxiv') WHEN 1 THEN list_has_any(cats, ['reference', 'science']) ELSE true END""")
def engine_selection(spark, d):
    n, none = F.col("n") % 3, F.array().cast("array<string>")
    rows = user_turns(spark, d).select(
        "request_id",
        F.when(n == 0, F.array(F.lit("github"), F.lit("arxiv"))).otherwise(none).alias("engines"),
        F.when(n == 1, F.array(F.lit("reference"), F.lit("science"))).otherwise(none).alias("categories"),
    )
    return requests.select_engines(rows, E.engines(spark)).select("request_id", "ordinal", "engine_id")


@query(f"""SELECT request_id, array_to_string(list_filter([CASE WHEN coalesce(text, '') = '' THEN 'query_xor_q' WHEN n % 4 = 0 THEN 'query_xor_q' END, CASE WHEN n % 5 = 0 THEN 'page_xor_cursor' END,
 CASE WHEN n % 7 = 0 THEN 'page' END, CASE WHEN n % 25 < 10 OR n % 25 > 20 THEN 'limit' END, CASE WHEN n % 9000 = 0 OR n % 9000 > 8000 THEN 'timeout' END],
 lambda x: x IS NOT NULL), ',') AS violations FROM ({USER_TURNS})""")
def request_validation(spark, d):
    n, none = F.col("n"), F.array().cast("array<string>")
    text = F.col("text")
    rows = user_turns(spark, d).select(
        "request_id", text.alias("query"), F.when((n % 4 == 0) & (F.coalesce(text, F.lit("")) != ""), "y").alias("q"), none.alias("engines"), none.alias("categories"),
        F.when(n % 7 == 0, 0).otherwise(1).alias("page"), F.when(n % 5 == 0, "c").alias("cursor"), (n % 25).alias("limit"), (n % 9000).alias("timeout_ms"),
    )
    return requests.violations(rows).select("request_id", F.array_join("violations", ",").alias("violations"))


# ---- Provider lists, merge, rank ----
@query(f"WITH {LISTS} SELECT request_id, engine_id, position, doc_id FROM lists WHERE position <= 20")
def provider_lists(spark, d):
    return S.provider_lists(spark, d).select("request_id", "engine_id", "position", "doc_id")


@query(f"WITH {MERGED} SELECT request_id, canonical_url, md5(title) AS title_md5, md5(content) AS content_md5, n_engines, n, best, first_list FROM merged")
def dedup_merge(spark, d):
    best = F.array_min(F.map_values("positions"))
    return S.merged(spark, d).select(
        "request_id", "canonical_url", F.md5("title").alias("title_md5"), F.md5("content").alias("content_md5"), F.size("engines").alias("n_engines"),
        F.size("contributions").alias("n"), best.alias("best"), F.get_json_object("metadata", "$.list").alias("first_list"),
    )


@query(f"WITH {MERGED} {topk('rrf', 'merged')}")
def rrf_topk(spark, d):
    return S.search(spark, d, "rrf-v1")


@query(f"WITH {MERGED} {topk('compat', 'merged')}")
def compat_topk(spark, d):
    return S.search(spark, d, "compat-v1")


LEX = (
    f"(CASE WHEN {norm('query')} <> '' AND contains({norm('title')}, {norm('query')}) THEN 2.0 ELSE 0.0 END + CASE WHEN {norm('query')} <> '' AND contains({norm('content')}, {norm('query')}) THEN 0.75 ELSE 0.0 END"
    f" + 1.5 * {cov('qt', 'tt')} + 0.6 * {cov('qt', 'ct')} + 0.25 * {cov('qt', 'ut')})::DOUBLE"
)
AWARE = f"""aware AS (SELECT m.*, query, {toks('query')} AS qt, {toks('title')} AS tt, {toks('content')} AS ct, {toks('canonical_url')} AS ut,
  max(year) OVER (PARTITION BY request_id) - year AS age FROM merged m JOIN asked USING (request_id))"""
FRESH = "(CASE WHEN age = 0 THEN 0.05 WHEN age = 1 THEN 0.04 WHEN age BETWEEN 2 AND 5 THEN 0.02 ELSE 0.0 END)"


@query(f"WITH {MERGED}, {AWARE} {topk(f'rrf + CASE WHEN len(qt) > 0 THEN {LEX} + {FRESH} ELSE 0 END', 'aware')}")
def query_aware_topk(spark, d):
    return S.search(spark, d, "query-aware-v1")


@query(f"WITH q AS (SELECT item_id AS request_id, {toks('text')} AS qt FROM benchmark), x AS (SELECT doc_id, {toks('text')} AS dt FROM documents) SELECT request_id, doc_id, {cov('qt', 'dt')} AS coverage FROM q, x")
def token_coverage(spark, d):
    """Each benchmark item, whole, with every document, whole."""
    return S.coverages(S.benchmark_queries(spark, d), S.texts(spark, d, "documents", "doc_id", "text"))


# ---- Responses ----
def _contains(x: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


@query(f"""WITH r AS (SELECT page_id, [200, 200, 200, 429, 403, 500][CAST(page_id % 6 + 1 AS INTEGER)] AS status, lower(substr(CASE WHEN page_id % 11 = 0 THEN 'Verify you are human ' || html ELSE html END, 1, 65536)) AS s FROM pages)
 SELECT page_id, CASE WHEN status = 429 OR {_contains('s', classify.RATE_MARKERS)} THEN 'ENGINE_RATE_LIMITED' WHEN {_contains('s', classify.CHALLENGE_MARKERS)} THEN 'ENGINE_CHALLENGED'
 WHEN status = 403 OR {_contains('s', classify.DENIED_MARKERS)} THEN 'ENGINE_ACCESS_DENIED' END AS failure FROM r""")
def challenge_classify(spark, d):
    status = F.element_at(F.array(*map(F.lit, (200, 200, 200, 429, 403, 500))), (F.col("page_id") % 6 + 1).cast("int"))
    body = F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("Verify you are human "), "html")).otherwise(F.col("html"))
    return S.read(spark, d, "pages").select("page_id", classify.body_failure(status, body).alias("failure"))


@query("""WITH r AS (SELECT event_id, event_id % 50 AS request_id, event_type AS engine_id, event_id % 97 = 0 AS bad FROM events)
 SELECT request_id, engine_id, count(*) AS n FROM r WHERE (request_id, engine_id) NOT IN (SELECT request_id, engine_id FROM r WHERE bad) GROUP BY ALL""")
def all_or_nothing(spark, d):
    url = F.when(F.col("event_id") % 97 == 0, "ftp://x").otherwise("https://x.org/")
    rows = canonicalized(S.read(spark, d, "events").select((F.col("event_id") % 50).alias("request_id"), F.col("event_type").alias("engine_id"), url.alias("url")))
    return merge.whole_engines(rows).groupBy("request_id", "engine_id").agg(F.count("*").alias("n"))


def reports(spark, d):
    """Events as reports of engine runs."""
    return S.read(spark, d, "events").select(
        (F.col("event_id") % 500).alias("request_id"), F.col("event_type").alias("engine_id"), F.when(F.col("event_id") % 5 == 0, "ENGINE_TIMEOUT").alias("failure_kind"),
        F.col("value").alias("duration_ms"), F.when(F.col("user_id") % 3 == 0, "hit").otherwise("miss").alias("cache_status"), F.col("event_id").alias("response_bytes"),
    )


REPORTS = "reports AS (SELECT event_id % 500 AS request_id, event_type AS engine_id, CASE WHEN event_id % 5 = 0 THEN 'ENGINE_TIMEOUT' END AS failure_kind, value AS duration_ms, CASE WHEN user_id % 3 = 0 THEN 'hit' ELSE 'miss' END AS cache_status, event_id AS response_bytes FROM events)"


@query(f"WITH {REPORTS} SELECT request_id, count(*) FILTER (failure_kind IS NULL) AS successes, count(failure_kind) AS failures, count(failure_kind) > 0 AS partial, CASE WHEN count(*) = count(failure_kind) THEN 'NO_ENGINE_SUCCEEDED' END AS code, CAST(sum(response_bytes) AS BIGINT) AS response_bytes FROM reports GROUP BY request_id")
def partial_status(spark, d):
    return telemetry.outcomes(reports(spark, d))


@query(f"WITH {REPORTS} SELECT engine_id, CASE WHEN failure_kind IS NULL THEN 'success' ELSE 'failure' END AS outcome, failure_kind, count(*) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM reports GROUP BY ALL")
def telemetry_p95(spark, d):
    return telemetry.p95(reports(spark, d)).withColumn("p95_ms", F.round("p95_ms", 6))


@query(f"""WITH {REPORTS}, w AS (SELECT engine_id, failure_kind, duration_ms, unnest(range(response_bytes % 4)) AS i FROM reports)
 SELECT engine_id, CASE WHEN failure_kind IS NULL THEN 'success' ELSE 'failure' END AS outcome, failure_kind, count(*) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM w GROUP BY ALL""")
def telemetry_weighted(spark, d):
    """Each report counts as often as its sample weight says, not at all at 0."""
    rows = reports(spark, d).withColumn("sample_weight", F.col("response_bytes") % 4)
    return telemetry.p95(rows).withColumn("p95_ms", F.round("p95_ms", 6))


CHANGED = "c AS (SELECT CASE WHEN event_id % 89 = 0 THEN 'changed' ELSE event_type END AS event_type, user_id FROM events WHERE event_id % 97 <> 0)"


@query(f"""WITH e AS (SELECT event_type, user_id FROM events), {CHANGED} SELECT 'left' AS side, event_type, user_id, count(*) AS n FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM c) GROUP BY ALL
 UNION ALL SELECT 'right', event_type, user_id, count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM e) GROUP BY ALL""")
def relation_equality(spark, d):
    """A table against a copy of which some rows are lost and some changed: what either has more of."""
    rows = S.read(spark, d, "events")
    changed = rows.filter(F.col("event_id") % 97 != 0).withColumn("event_type", F.when(F.col("event_id") % 89 == 0, "changed").otherwise(F.col("event_type")))
    return merge.differences(rows.select("event_type", "user_id"), changed.select("event_type", "user_id"))


@query(f"WITH {REPORTS} SELECT engine_id, cache_status, count(*) AS n FROM reports GROUP BY ALL")
def telemetry_cache(spark, d):
    return telemetry.by_cache(reports(spark, d))


@query("SELECT user_id % 3 AS client, time_bucket(INTERVAL 60 SECOND, ts) AS minute, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_window(spark, d):
    calls = S.read(spark, d, "events").select((F.col("user_id") % 3).alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return telemetry.over_limit(calls, 1).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


# ---- Cache ----
SAFE = "CASE o_orderkey % 3 WHEN 0 THEN '\"strict\"' WHEN 1 THEN '\"off\"' ELSE 'null' END"
RANGE = "CASE WHEN o_orderkey % 2 = 0 THEN '\"week\"' ELSE 'null' END"
COUNTRY = "CASE WHEN o_orderkey % 5 = 0 THEN '\"DE\"' ELSE 'null' END"
LOCALE = "CASE WHEN o_orderkey % 7 = 0 THEN '\"de-AT\"' ELSE 'null' END"
CURSOR = "CASE WHEN o_orderkey % 10 = 0 THEN '\"' || sha256('c') || '\"' ELSE 'null' END"


def key_fields() -> dict:
    """Every field that a key depends on, varied over the orders."""
    n = F.col("o_orderkey")
    lits = lambda *xs: F.array(*map(F.lit, xs))
    return {
        "query": F.col("o_orderpriority"), "engines": lits("github", "arxiv"), "categories": lits("code", "academic"), "page": (n % 4 + 1).cast("int"), "limit": (n % 11 + 10).cast("int"),
        "locale": F.when(n % 7 == 0, "de-AT"), "country": F.when(n % 5 == 0, "DE"), "safe_search": F.when(n % 3 == 0, "strict").when(n % 3 == 1, "off"), "time_range": F.when(n % 2 == 0, "week"),
        "ranking": F.lit("rrf-v1"), "parsers": lits("github:v1", "arxiv:v2"), "cursor_hash": F.when(n % 10 == 0, F.sha2(F.lit("c"), 256)),
    }


def key_json(engines: str, parsers: str) -> str:
    return (
        f"""'{{"api_version":"v1","categories":["academic","code"],"country":' || {COUNTRY} || ',"cursor_hash":' || {CURSOR} || ',"engines":{engines},"limit":' || (o_orderkey % 11 + 10)"""
        f""" || ',"locale":' || {LOCALE} || ',"page":' || (o_orderkey % 4 + 1) || ',"parsers":{parsers},"query":"' || o_orderpriority || '","ranking":"rrf-v1","ranking_version":"{cache.RANKING_VERSION}"'"""
        f""" || ',"registry":"{cache.REGISTRY_VERSION}","safe_search":' || {SAFE} || ',"time_range":' || {RANGE} || '}}'"""
    )


@query(f"""SELECT o_orderkey, 'cache/v1/search/' || sha256({key_json('["arxiv","github"]', '["arxiv:v2","github:v1"]')}) AS key FROM orders""")
def cache_key(spark, d):
    return S.read(spark, d, "orders").select("o_orderkey", cache.cache_key(key_fields()).alias("key"))


@query(f"""SELECT o_orderkey, 'cache/v1/engine/arxiv/' || sha256({key_json('["arxiv"]', '["arxiv:v2"]')}) AS key FROM orders""")
def engine_cache_key(spark, d):
    return S.read(spark, d, "orders").select("o_orderkey", cache.engine_cache_key(key_fields(), F.lit("arxiv"), F.lit("v2")).alias("key"))


@query(f"""SELECT o_orderkey, sha256('{{"categories":["code","academic"],"country":' || {COUNTRY} || ',"engines":["github","arxiv"],"limit":' || (o_orderkey % 11 + 10) || ',"locale":' || {LOCALE} || ',"query":"' || o_orderpriority
 || '","ranking":"rrf-v1","safe_search":' || {SAFE} || ',"time_range":' || {RANGE} || '}}') AS hash FROM orders""")
def cursor_query_hash(spark, d):
    return S.read(spark, d, "orders").select("o_orderkey", cache.cursor_hash(key_fields()).alias("hash"))


@query("""WITH c AS (SELECT user_id AS key, event_id % 7 = 0 AS negative, event_id AS expires_at FROM events),
 a AS (SELECT key, arg_max(negative, expires_at) AS negative FROM c WHERE expires_at > 300 GROUP BY key)
 SELECT c_custkey, CASE WHEN negative THEN 'negative' WHEN NOT negative THEN 'positive' END AS hit FROM customer LEFT JOIN a ON c_custkey = key""")
def ttl_cache_hits(spark, d):
    entries = S.read(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 7 == 0).alias("negative"), F.col("event_id").alias("expires_at"))
    asked = S.read(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("key"))
    return cache.probe(asked, entries, F.lit(300)).select("c_custkey", "hit")


# ---- Crawl ----
def encoded(href: str) -> str:
    text = f"url_encode({href})"
    for c in crawl.KEPT + "*":
        shown = c.replace("'", "''")
        text = f"replace({text}, '%{ord(c):02X}', '{shown}')" if c not in "~%" else text
    return f"replace({text}, '%25', '%')"


HREFS = "regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"#]+)', 1)"
LOCAL = "^https://(localhost|[^/]*\\.internal|[^/]*\\.localhost|10\\.|127\\.|192\\.168\\.)"
STRIPPED = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*(>|$)', ' ', 'g'),
 '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))"""
#: Links of pages are rooted paths in all tables; the first of equal ones counts.
PAGES = f"""p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, regexp_extract(url, '^https://[^/]+') AS origin, html FROM pages WHERE starts_with(url, 'https://') AND NOT regexp_matches(url, '{LOCAL}')),
 h AS (SELECT page_id, origin, unnest({HREFS}) AS href, generate_subscripts({HREFS}, 1) AS i FROM p),
 links AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth FROM (SELECT page_id, origin || {encoded('href')} AS link, min(i) AS i FROM h GROUP BY ALL))"""


@query(f"WITH {PAGES} SELECT page_id, CAST(nth - 1 AS INTEGER) AS nth, link FROM links WHERE nth <= 64")
def page_links(spark, d):
    rows = crawl.pages(S.read(spark, d, "pages"))
    return rows.select("page_id", F.posexplode("links").alias("nth", "link"))


@query(f"""WITH {PAGES}, t AS (SELECT page_id, url, trim(regexp_replace(substr(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), 1, 512), '\\s+', ' ', 'g')) AS title,
  substr({STRIPPED.format("regexp_replace(html, '(?s)^.*?<body[^>]*>', '')")}, 1, 262144) AS text FROM p),
 l AS (SELECT page_id, string_agg('- ' || link, chr(10) ORDER BY nth) AS l FROM links WHERE nth <= 64 GROUP BY page_id)
 SELECT page_id, 'documents/' || sha256(url) || '.md' AS key, md5(concat_ws(chr(10), '---', 'url: ' || to_json(url), 'title: ' || to_json(title), 'fetched_at: "2026-01-01T00:00:00Z"', '---', '', '',
  '# ' || CASE WHEN title = '' THEN url ELSE title END, '', text, '', '## Discovered links', '', l, '')) AS markdown_md5 FROM t LEFT JOIN l USING (page_id) WHERE text <> ''""")
def crawl_documents(spark, d):
    rows = crawl.documents(crawl.pages(S.read(spark, d, "pages")), "2026-01-01T00:00:00Z")
    return rows.select("page_id", "key", F.md5("markdown").alias("markdown_md5"))


@query(f"WITH {PAGES} SELECT sha256(link) AS digest, link AS url FROM (SELECT DISTINCT link FROM links WHERE nth <= 12) WHERE link NOT IN (SELECT url FROM p)")
def frontier_anti(spark, d):
    raw = S.read(spark, d, "pages")
    return crawl.frontier(crawl.pages(raw), raw.select("url"))


# ---- Retrieval ----
BM25 = f"""{TERMS}, lengths AS (SELECT doc_id, len({words('text')}) AS dl FROM documents), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words('text')}) AS term FROM documents) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 bm AS (SELECT request_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM terms JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (doc_id), corpus GROUP BY ALL),
 bmr AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""


@query(f"WITH {BM25} SELECT request_id, rank, doc_id, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def bm25_topk(spark, d):
    rows = retrieve.bm25(S.texts(spark, d, "documents", "doc_id", "text"), S.benchmark_queries(spark, d))
    return rows.select("request_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT request_id, rank, doc_id, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def bm25_index_topk(spark, d):
    """The same from an index of blocks, of which those that cannot win are not read."""
    index = postings.Index(S.texts(spark, d, "documents", "doc_id", "text", "lang"), ["lang"])
    try:
        found = index.search(S.benchmark_queries(spark, d))
        return retrieve.written(found.select("request_id", "rank", "doc_id", F.round("score", 6).alias("score")), "ranked")
    finally:
        index.drop()


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
 s AS (SELECT q.vec_id AS request_id, v.vec_id AS doc_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) AS score FROM q, v),
 r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT request_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def cosine_topk(spark, d):
    """Queries are the stated set of rows with ids divisible by 100."""
    rows = S.read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = rows.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("request_id"), "vector")
    return retrieve.cosine(rows, asked).select("request_id", "rank", "doc_id", F.round("score", 6).alias("score"))


FUSED = f"""{MERGED}, prov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rrf DESC, canonical_url) AS rank FROM merged) WHERE rank <= 10),
 {BM25.split('lengths AS', 1)[1].join(['lengths AS', '']).replace(' tf AS (', ' tf2 AS (').replace('FROM tf GROUP BY term', 'FROM tf2 GROUP BY term').replace('JOIN tf USING', 'JOIN tf2 USING')},
 idx AS (SELECT b.request_id, 'https://' || source || '.example.org/d/' || doc_id AS canonical_url, rank, {ENDS.format("array_to_string(string_split(text, ' ')[1:8], ' ')")} AS title, {ENDS.format('text')} AS content FROM bmr b JOIN documents USING (doc_id) WHERE rank <= 10),
 f AS (SELECT request_id, canonical_url, coalesce(p.title, i.title) AS title, coalesce(p.content, i.content) AS content, coalesce(p.n_engines, 0) + (i.rank IS NOT NULL)::INT AS n_engines, p.rank AS prank,
   coalesce(1.0::DOUBLE / (60 + p.rank), 0) + coalesce(1.0::DOUBLE / (60 + i.rank), 0) AS base FROM prov p FULL JOIN idx i USING (request_id, canonical_url)),
 g AS (SELECT f.*, query, {toks('query')} AS qt, {toks('title')} AS tt, {toks('content')} AS ct, {toks('canonical_url')} AS ut FROM f JOIN asked USING (request_id)),
 h AS (SELECT *, base + ({LEX} + 0.1::DOUBLE * ln(1.0 + n_engines) + 0.05::DOUBLE * 0.0::DOUBLE) AS score FROM g)"""


@query(f"WITH {FUSED} SELECT request_id, rank, canonical_url, round(score, 6) AS score, n_engines FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, prank NULLS LAST, canonical_url) AS rank FROM h) WHERE rank <= 10")
def hybrid_fusion(spark, d):
    asked = S.benchmark_queries(spark, d)
    lists, found = S.provider_and_index(spark, d)
    provider = rank.top(rank.scored(S.merged(spark, d, lists), "rrf-v1")).select("request_id", "canonical_url", "rank", "title", "content", "engines")
    hits = S.read(spark, d, "documents").select("doc_id", "text", "source").join(found, "doc_id")
    index = hits.select(
        "request_id", F.concat(F.lit("https://"), "source", F.lit(".example.org/d/"), F.col("doc_id").cast("string")).alias("canonical_url"), "rank",
        T.trimmed(F.array_join(F.slice(F.split("text", " "), 1, 8), " ")).alias("title"), T.trimmed(F.col("text")).alias("content"), F.array(F.lit("index")).alias("engines"),
    )
    rows = rank.fused(provider, index, asked)
    return rows.select("request_id", "rank", "canonical_url", F.round("score", 6).alias("score"), F.size("engines").alias("n_engines"))


# ---- State ----
@query()
def coordinator_fold(spark, d):
    command = F.element_at(F.array(*map(F.lit, ("acquire", "success", "failure", "snapshot"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = S.read(spark, d, "events").select(
        F.col("event_type").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("nth"), command.alias("command"),
        F.lit("ENGINE_TIMEOUT").alias("failure_kind"), F.lit(60_000).cast("long").alias("duration_ms"),
    )
    return state.coordinate(rows)


from beaconq.plans import interface, streams  # noqa: E402, F401 - add their queries
