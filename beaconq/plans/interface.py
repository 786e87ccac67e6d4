"""Queries of the interface: requests, stored responses, answers, caches, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconq.functions import classify, text as T
from beaconq.operators import cache, crawl, cursors, errors, merge, rank, requests, respond, telemetry
from beaconq.plans import search as S, wire
from beaconq.plans.catalog import LISTS, PAGES, STRIPPED, USER_TURNS, query, user_turns
from beaconq.session import shared_path
from beaconq.sources import engines as E, outgoing, responses as R, stored
from beaconq.sources.providers import pubmed_ids
from beaconq.streaming import state

IDS = wire.IDS
PLACE = ", ".join(f"'{i}'" for i in IDS)

# ---- Stored responses: every document is sent by one of the providers, in its wire form ----
PER_PAGE = 10


def document_responses(spark, d):
    """Ten documents, whole, make a response, and responses go round the providers; each
    provider's first ten responses are of its page 1, the next of page 2, and so on."""
    n = F.floor(F.col("doc_id") / PER_PAGE)
    engine = F.element_at(F.array(*map(F.lit, IDS)), (n % len(IDS) + 1).cast("int"))
    docs = S.texts(spark, d, "documents", "doc_id", "text").select(
        n.alias("request_id"), engine.alias("engine_id"), F.col("doc_id").alias("nth"), F.col("doc_id").alias("uid"), F.concat(F.lit("https://d.example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("content"),
    )
    rows = wire.sent(docs, ["request_id"])
    return rows.withColumns({"page": (F.floor(F.col("request_id") / (10 * len(IDS))) % 5 + 1).cast("int"), "request_id": F.col("request_id").cast("string")})


HTML_IDS = ", ".join(f"'{e[0]}'" for e in E.ENGINES if e[1] == "html")
SQUEEZED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
MARKED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def as_read(engine: str, text: str) -> str:
    """SQL: a text as the reader of the engine gives it back, white space squeezed."""
    return f"(CASE WHEN {engine} IN ({HTML_IDS}) THEN {MARKED.format(SQUEEZED.format(text))} WHEN {engine} = 'crossref' THEN {STRIPPED.format(text)} ELSE {SQUEEZED.format(text)} END)"


SENT = f"""sent AS (SELECT doc_id, CAST(doc_id // {PER_PAGE} AS VARCHAR) AS request_id, [{PLACE}][CAST((doc_id // {PER_PAGE}) % {len(IDS)} + 1 AS INTEGER)] AS engine_id,
 CAST(row_number() OVER (PARTITION BY doc_id // {PER_PAGE} ORDER BY doc_id) AS INTEGER) AS position, CAST((doc_id // {10 * PER_PAGE * len(IDS)}) % 5 + 1 AS INTEGER) AS page, coalesce(text, '') AS text FROM documents)"""
PARSED_SQL = f"""SELECT request_id, engine_id, position, CASE WHEN engine_id = 'pubmed' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' ELSE 'https://d.example.org/' || doc_id END AS url,
 'Document ' || doc_id AS title, md5({as_read('engine_id', 'text')}) AS content_md5 FROM sent"""


def parsed_results(spark, rows, engines=None):
    found = R.results(R.read(rows, engines), E.engines(spark))
    return found.select("request_id", "engine_id", "position", "url", "title", F.md5(T.collapse(F.col("content"))).alias("content_md5"))


@query(f"WITH {SENT} {PARSED_SQL}")
def provider_parse(spark, d):
    """Every document comes back from the wire form that it was sent in, in its place."""
    return parsed_results(spark, stored.load(spark, wire.kept(document_responses(spark, d), "responses")))


@query(f"WITH {SENT} {PARSED_SQL} WHERE engine_id IN ('arxiv', 'mojeek-web', 'crossref') AND page = 1")
def stored_scan(spark, d):
    """Three engines' first pages of the stored table; files of others are not opened."""
    path = wire.kept(document_responses(spark, d), "responses")
    return parsed_results(spark, stored.load(spark, path, "engine_id IN ('arxiv', 'mojeek-web', 'crossref') AND page = 1"), ["arxiv", "mojeek-web", "crossref"])


# ---- Answers from stored responses ----
#: Which engine sends which list, in the order of the catalogue.
SENDERS = [("wikipedia", "coverage"), ("crossref", "tf"), ("mojeek-web", "quality")]
WEIGHTS = {e[0]: (i, e[3]) for i, e in enumerate(E.ENGINES)}


def list_responses(spark, d):
    """The three lists of each benchmark item as bodies of three engines, some of them spoiled."""
    engine = F.create_map(*[F.lit(x) for e, n in SENDERS for x in (n, e)])[F.col("engine_id")]
    docs = S.read(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("content"))
    rows = S.provider_lists(spark, d).withColumn("engine_id", engine).join(docs, "doc_id")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.org/d/"), F.col("doc_id").cast("string"), F.lit("?utm_source="), "engine_id", F.lit("#e"))
    items = rows.select("request_id", "engine_id", F.col("position").alias("nth"), F.col("doc_id").alias("uid"), url.alias("url"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "content")
    sent = wire.sent(items, ["request_id"], [e for e, _ in SENDERS])
    n, e = F.col("request_id"), F.col("engine_id")
    status = F.when((e == "mojeek-web") & (n % 4 == 0), 429).when((e == "wikipedia") & (n % 12 == 0), 403).otherwise(200)
    body = F.when((e == "crossref") & (n % 6 == 0), F.lit('{"status": "ok", "message": {"items": ')).otherwise(F.col("body"))
    return sent.withColumns({"status": status, "body": body, "request_id": n.cast("string")})


def answers_from(spark, d, limit=10):
    responses = stored.load(spark, wire.kept(list_responses(spark, d), "list-responses"))
    read = saved(R.read(responses, [e for e, _ in SENDERS]), "read-responses")
    asked = S.benchmark_queries(spark, d).select(F.col("request_id").cast("string").alias("request_id"), "query")
    return respond.answered(asked, read, E.engines(spark), "rrf-v1", limit)


def saved(rows, name):
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


PARTS_SQL = " + ".join(f"coalesce(max(CASE WHEN engine_id = '{e}' THEN {WEIGHTS[e][1]}::DOUBLE / (60 + position) END), 0)" for e, _ in SENDERS)
ORDINALS = "CASE engine_id " + " ".join(f"WHEN '{e}' THEN {WEIGHTS[e][0]}" for e, _ in SENDERS) + " END"
ANSWERED = f"""WITH {LISTS},
 sent AS (SELECT request_id, doc_id, position, CASE engine_id WHEN 'tf' THEN 'crossref' WHEN 'coverage' THEN 'wikipedia' ELSE 'mojeek-web' END AS engine_id FROM lists WHERE position <= 20),
 reports AS (SELECT request_id, engine_id, count(*) AS n, CASE WHEN engine_id = 'mojeek-web' AND request_id % 4 = 0 THEN 'ENGINE_RATE_LIMITED' WHEN engine_id = 'crossref' AND request_id % 6 = 0 THEN 'ENGINE_PARSE_FAILED'
   WHEN engine_id = 'wikipedia' AND request_id % 12 = 0 THEN 'ENGINE_ACCESS_DENIED' END AS failure FROM sent GROUP BY request_id, engine_id),
 outcomes AS (SELECT item_id AS request_id, count(*) FILTER (engine_id IS NOT NULL AND failure IS NULL) AS successes, count(failure) > 0 AS partial, coalesce(bool_or(failure IS NULL AND n >= 10), false) AS more,
   coalesce(string_agg(engine_id || ':' || failure, ',' ORDER BY engine_id), '') AS failed FROM benchmark LEFT JOIN reports ON item_id = request_id GROUP BY item_id),
 res AS (SELECT s.*, 'https://' || source || '.example.org/d/' || doc_id AS canonical_url, {as_read('s.engine_id', "coalesce(text, '')")} AS content FROM sent s JOIN reports r ON s.request_id = r.request_id AND s.engine_id = r.engine_id AND failure IS NULL JOIN documents USING (doc_id)),
 merged AS (SELECT request_id, canonical_url, 'Document ' || any_value(doc_id) AS title, md5(arg_max(content, [strlen(content), -({ORDINALS})])) AS content_md5, string_agg(DISTINCT engine_id, ',' ORDER BY engine_id) AS engines,
   0.0::DOUBLE + {PARTS_SQL} + 0.10::DOUBLE * ln(1.0 + count(DISTINCT engine_id)) AS score FROM res GROUP BY request_id, canonical_url),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, canonical_url) AS rank FROM merged) WHERE rank <= 10)"""
RESULT_SHAPE = "array<struct<rank: int, canonical_url: string, title: string, content: string, score: double, engines: array<string>>>"


def told(body, path):
    return F.get_json_object(body, f"$.{path}")


def failed_of(engines):
    return F.array_join(F.transform(F.filter(engines, lambda e: e["failure_kind"].isNotNull()), lambda e: F.concat(e["engine_id"], F.lit(":"), e["failure_kind"])), ",")


def flattened(rows, results):
    each = rows.select("*", F.explode_outer(F.from_json(told(F.col("body"), results), RESULT_SHAPE)).alias("r"))
    return each.withColumns(
        {"rank": F.col("r.rank"), "canonical_url": F.col("r.canonical_url"), "title": F.col("r.title"), "content_md5": F.md5(T.collapse(F.col("r.content"))), "score": F.round("r.score", 6), "result_engines": F.array_join("r.engines", ",")}
    ).drop("r")


@query(f"""{ANSWERED} SELECT CAST(o.request_id AS VARCHAR) AS request_id, CASE WHEN successes = 0 THEN 502 ELSE 200 END AS status, CASE WHEN successes = 0 THEN 'NO_ENGINE_SUCCEEDED' END AS code, CASE WHEN successes > 0 THEN partial END AS partial,
 CASE WHEN successes > 0 THEN more END AS may_have_more, CASE WHEN successes > 0 THEN count(canonical_url) OVER (PARTITION BY o.request_id) END AS result_count, CASE WHEN successes > 0 THEN failed END AS failed,
 CAST(rank AS INTEGER) AS rank, canonical_url, title, content_md5, round(score, 6) AS score, engines AS result_engines FROM outcomes o LEFT JOIN top t ON o.request_id = t.request_id AND successes > 0""")
def search_bodies(spark, d):
    """What is sent for each benchmark item, from stored responses, read back from its JSON text."""
    body = F.col("body")
    rows = respond.bodies(*answers_from(spark, d)).select(
        "request_id", "status", told(body, "code").alias("code"), told(body, "partial").cast("boolean").alias("partial"), told(body, "may_have_more").cast("boolean").alias("may_have_more"), told(body, "result_count").cast("long").alias("result_count"),
        failed_of(F.from_json(F.when(F.col("status") == 200, told(body, "engines")), "array<struct<engine_id: string, failure_kind: string>>")).alias("failed"), "body",
    )
    return flattened(rows, "results").drop("body")


@query(f"""{ANSWERED} SELECT CAST(o.request_id AS VARCHAR) AS request_id, CASE WHEN successes = 0 THEN 502 ELSE 200 END AS status, CASE WHEN successes > 0 THEN md5(text) END AS query_md5, CASE WHEN successes > 0 THEN count(canonical_url) OVER (PARTITION BY o.request_id) END AS number_of_results,
 CASE WHEN successes > 0 THEN failed END AS unresponsive, CAST(rank AS INTEGER) AS rank, canonical_url, title, content_md5, round(score, 6) AS score, engines AS result_engines
 FROM outcomes o JOIN benchmark ON item_id = o.request_id LEFT JOIN top t ON o.request_id = t.request_id AND successes > 0""")
def compat_bodies(spark, d):
    """The same in the older shape."""
    body = F.col("body")
    pairs = F.from_json(F.when(F.col("status") == 200, F.coalesce(told(body, "unresponsive_engines"), F.lit("[]"))), "array<array<string>>")
    rows = respond.compat_bodies(*answers_from(spark, d)).select(
        "request_id", "status", F.md5(told(body, "query")).alias("query_md5"), told(body, "number_of_results").cast("long").alias("number_of_results"), F.array_join(F.transform(pairs, lambda p: F.array_join(p, ":")), ",").alias("unresponsive"), "body"
    )
    return flattened(rows, "results").drop("body")


#: Padding goes by whole copies of this: one space at a time, two million of them took longer than all else.
SPACES = " " * 4096


@query(f"""WITH r AS (SELECT page_id, page_id % 12 AS c, {{}} FROM pages)
 SELECT page_id, CASE WHEN c = 7 THEN 'ENGINE_ACCESS_DENIED' WHEN c = 1 THEN 'ENGINE_CHALLENGED' WHEN c = 2 THEN 'ENGINE_CHALLENGED' WHEN c = 3 THEN 'ENGINE_RATE_LIMITED' WHEN c = 4 OR c = 5 THEN 'ENGINE_ACCESS_DENIED'
  WHEN c = 6 THEN 'ENGINE_INVALID_CONTENT_TYPE' WHEN c = 8 THEN 'ENGINE_RATE_LIMITED' WHEN c = 9 THEN 'ENGINE_CHALLENGED' WHEN c = 10 THEN 'ENGINE_RESPONSE_TOO_LARGE' END AS failure_kind FROM r""".replace(", {}", ""))
def response_classify(spark, d):
    """All pages as responses, eleven in twelve of which are spoiled in a way of their own."""
    c = F.col("page_id") % 12
    said = F.when(c == 8, F.concat(F.lit("Rate Limit Exceeded "), "html")).when(c == 9, F.concat(F.lit("Attention Required "), "html")).when(c == 10, F.rpad(F.col("html"), classify.MOST_BYTES + 1, SPACES)).otherwise(F.col("html"))
    kind = F.when(c == 6, "image/png").otherwise("text/html; charset=utf-8")
    headers = F.when(c == 2, F.create_map(F.lit("CF-Mitigated"), F.lit("challenge"), F.lit("Content-Type"), kind)).otherwise(F.create_map(F.lit("content-type"), kind))
    hops = F.when(c == 1, F.array(F.lit("https://x.org/sorry/index"))).when(c == 7, F.array(F.lit("/a"), F.lit("/b"), F.lit("/c")))
    status = F.when(c == 3, 429).when(c == 4, 403).when(c == 5, 500).otherwise(200)
    rows = S.read(spark, d, "pages").select("page_id", F.lit("mojeek-web").alias("engine_id"), status.alias("status"), headers.alias("headers"), said.alias("body"), hops.alias("locations"))
    return R.classified(rows).select("page_id", "failure_kind")


# ---- Requests ----
@query(f"""SELECT request_id, CASE WHEN regexp_matches(text, '[\\x00-\\x1f\\x7f-\\x9f]') THEN 'control_character' WHEN trim(text) = '' THEN 'empty' WHEN length(regexp_replace(trim(text), '\\s+', ' ', 'g')) > 499 THEN 'too_long' END AS error,
 CASE WHEN NOT regexp_matches(text, '[\\x00-\\x1f\\x7f-\\x9f]') AND trim(text) <> '' AND length(regexp_replace(trim(text), '\\s+', ' ', 'g')) <= 499 THEN md5(regexp_replace(trim(text), '\\s+', ' ', 'g')) END AS query_md5 FROM ({USER_TURNS})""")
def query_normalize(spark, d):
    rows = user_turns(spark, d)
    return rows.select("request_id", requests.query_failure("text").alias("error"), F.md5(requests.normalize_query("text")).alias("query_md5"))


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN 'a b' ELSE o_orderpriority END AS q, 'github,arxiv,github' AS engines, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 END AS page, CASE o_orderkey % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'strict' END AS safe_search,
 CASE WHEN o_orderkey % 2 = 0 THEN 'month' END AS time_range, greatest(10, least(20, o_orderkey % 31)) AS clamped, 'arxiv,github' AS cleaned FROM orders""")
def request_parse(spark, d):
    """Query strings of requests; the last of equal names counts, what is unreadable is null."""
    n = F.col("o_orderkey")
    q = F.when(n % 3 == 0, "a+b").otherwise(F.url_encode("o_orderpriority"))
    page = F.when(n % 4 < 3, (n % 4).cast("string")).otherwise("x")
    safe = F.when(n % 5 == 0, "off").when(n % 5 == 1, "2").otherwise("other")
    line = F.concat(F.lit("?q=first&engines=github,%20arxiv,,github&page="), page, F.lit("&safe_search="), safe, F.lit("&time_range="), F.when(n % 2 == 0, "month").otherwise("decade"), F.lit("&q="), q)
    rows = S.read(spark, d, "orders").select(n.alias("request_id"), line.alias("query_string"), (n % 31).alias("m"))
    got = requests.parsed(rows)
    more = rows.select("request_id", requests.bounded_integer(F.concat(F.col("m").cast("string"), F.lit("px")), 10, 10, 20).alias("clamped"), requests.clean_list(F.lit(" github, arxiv,,github")).alias("c"))
    return got.join(more, "request_id").select("request_id", "q", F.array_join("engines", ",").alias("engines"), "page", "safe_search", "time_range", "clamped", F.array_join("c", ",").alias("cleaned"))


@query(f"""SELECT request_id, CASE n % 5 WHEN 0 THEN 'UNKNOWN_ENGINE' WHEN 1 THEN 'NO_ENGINE_SUCCEEDED' WHEN 2 THEN 'ENGINE_DISABLED' WHEN 4 THEN 'ENGINE_DISABLED' END AS code,
 CASE n % 5 WHEN 0 THEN 'nosuch' WHEN 2 THEN 'google-web' WHEN 4 THEN 'google-web' END AS detail FROM ({USER_TURNS}) WHERE n % 5 <> 3""")
def selection_errors(spark, d):
    n, none = F.col("n") % 5, F.array().cast("array<string>")
    rows = user_turns(spark, d).select(
        "request_id", F.when(n == 0, F.array(F.lit("arxiv"), F.lit("nosuch"), F.lit("google-web"))).when(n == 2, F.array(F.lit("google-web"), F.lit("nosuch"))).when(n == 3, F.array(F.lit("startpage-web"))).otherwise(none).alias("engines"),
        F.when(n == 1, F.array(F.lit("nothing"))).otherwise(none).alias("categories"),
    )
    return requests.selection_failures(rows, E.engines(spark), {"ENABLE_STARTPAGE": True})


# ---- Requests to providers ----
def enc(x):
    return f"replace(replace(replace(url_encode(({x})::VARCHAR), '%20', '+'), '%2A', '*'), '~', '%7E')"


def line(*named):
    """SQL of form-encoded pairs; a name without a value stands as it is."""
    return "concat_ws('&', " + ", ".join(f"'{k}'" if v is None else f"'{k}=' || {enc(v)}" for k, v in named) + ")"


def by(column, *values):
    of = ("off", "moderate", "strict") if column == "safe" else ("day", "week", "month", "year")
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in zip(of, values)) + " END"


LANG, LAND = "lower(regexp_split_to_array(coalesce(locale, 'en-US'), '[-_]')[1])", "upper(coalesce(country, regexp_split_to_array(coalesce(locale, 'en-US'), '[-_]')[2], 'US'))"
LATER = "CASE WHEN page > 1 THEN {} END"
SINCE = "strftime(CASE span WHEN 'day' THEN today - 1 WHEN 'week' THEN today - 7 WHEN 'month' THEN today - INTERVAL 1 MONTH WHEN 'year' THEN today - INTERVAL 12 MONTH END, '%Y%m%d')"
SEGMENT = "replace(replace(url_encode(query), '%27', chr(39)), '%2A', '*')"
for sign in "!$&()+,:;=@[]|^":
    SEGMENT = f"replace({SEGMENT}, '%{ord(sign):02X}', '{sign}')"
ARXIV = "array_to_string(list_transform(list_filter(list_transform(string_split(trim(regexp_replace(query, '\\s+', ' ', 'g')), ' '), lambda w: trim(translate(w, chr(34) || chr(92), '  '))), lambda w: w <> ''), lambda w: 'all:' || chr(34) || w || chr(34)), ' AND ')"
YAHOO = "'https://' || CASE " + " ".join(f"WHEN {LAND} = '{k}' THEN '{v}.'" for k, v in outgoing.YAHOO_HOSTS.items()) + f" WHEN {LANG} = 'zh' THEN 'hk.' ELSE '' END || 'search.yahoo.com/search?'"
YAHOO_COOKIE = f"""'sB=v=1&vm=' || {by('safe', 'p', 'i', 'r')} || '&fl=1&vl=lang_' || CASE WHEN {LANG} = 'zh' THEN CASE WHEN {LAND} IN ('TW', 'HK') THEN 'zh_cht' ELSE 'zh_chs' END
  WHEN list_contains({outgoing.YAHOO_LANGUAGES!r}, {LANG}) THEN {LANG} ELSE 'en' END || '&pn=10&rw=new&userset=1'"""
BRAVE_COOKIE = f"'country=' || lower({LAND}) || '; safesearch=' || safe || '; summarizer=0; ui_lang=' || {LANG} || '-' || lower({LAND}) || '; useLocation=0'"
TEN, TWENTY, WHOLE = "least(lim, 10)", "least(lim, 20)", "(page - 1) * lim"


def asks(url, *named):
    return f"'{url}?' || {line(*named)}"


SCHOLAR = """'{"authors":[],"coAuthors":[],"getQuerySuggestions":false,"page":' || page || ',"pageSize":' || lim || ',"performTitleMatch":true,"queryString":' || to_json(query) || ',"sort":"relevance","venues":[]}'"""
CALL = """'{"id":2,"jsonrpc":"2.0","method":"tools/call","params":{"arguments":{"numResults":' || lim || ',"query":' || to_json(query) || '},"name":"web_search_exa"}}'"""
DDG = line(("q", "query"), ("b=", None), ("kl", "coalesce(lower(replace(locale, '_', '-')), 'wt-wt')"), ("kp", by("safe", "-2", "-1", "1")), ("s", LATER.format(WHOLE)), ("dc", LATER.format(WHOLE + " + 1")), ("vqd", "token"), ("df", by("span", "d", "w", "m", "y")))
STARTPAGE = line(
    ("query", "query"), ("cat=web&t=device", None), ("sc", "token"), ("abd=1&abe=1&qsr=all", None), ("qadf", by("safe", "none", "moderate", "heavy")), ("language=en&lui=en", None),
    ("page", LATER.format("page")), ("segment", LATER.format("'startpage.udog'")), ("with_date", by("span", "d", "w", "m", "y")),
)
BRAVE_SPANS, NO_SPAN = by("span", "pd", "pw", "pm", "py"), "span IS NOT NULL"
#: URL, body, cookies and condition of failure of each engine, as SQL.
WANTED = {
    "arxiv": (asks("https://export.arxiv.org/api/query", ("search_query", ARXIV), ("start", WHOLE), ("max_results", "lim")), "NULL", "NULL", "false"),
    "wikipedia": (f"'https://' || CASE WHEN {LANG} IN ('fr', 'de', 'es') THEN {LANG} ELSE 'en' END || '.wikipedia.org/api/rest_v1/page/summary/' || {SEGMENT}", "NULL", "NULL", "page > 1"),
    "duckduckgo-html": ("'https://html.duckduckgo.com/html/'", DDG, "NULL", "page > 20"),
    "brave-web": (asks("https://search.brave.com/search", ("q", "query"), ("source=web", None), ("offset", LATER.format("page - 1")), ("tf", BRAVE_SPANS)), "NULL", BRAVE_COOKIE, "page > 10"),
    "brave-news": (asks("https://search.brave.com/news", ("q", "query"), ("offset", "page - 1"), ("safesearch", "safe"), ("country", "lower(country)"), ("tf", BRAVE_SPANS)), "NULL", "NULL", "page > 10"),
    "qwant-web": (asks("https://api.qwant.com/v3/search/web", ("q", "query"), ("count", TEN), ("locale", f"{LANG} || '_' || {LAND}"), ("offset", f"(page - 1) * {TEN}"), ("tgp=1&device=desktop", None), ("safesearch", by("safe", "0", "1", "2")), ("displayed=true&llm=true", None)), "NULL", "NULL", f"page > 5 OR {NO_SPAN}"),
    "pubmed": (asks("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", ("db=pubmed", None), ("term", "query"), ("retmode=json", None), ("retstart", WHOLE), ("retmax", "lim"), ("sort=relevance", None)), "NULL", "NULL", f"page > 500 OR {NO_SPAN}"),
    "semantic-scholar": ("'https://www.semanticscholar.org/api/1/search'", SCHOLAR, "NULL", "page > 100"),
    "crossref": (asks("https://api.crossref.org/works", ("query.bibliographic", "query"), ("rows", "lim"), ("offset", WHOLE), ("mailto", "token")), "NULL", "NULL", f"page > 500 OR {NO_SPAN}"),
    "github": (asks("https://api.github.com/search/repositories", ("q", "query"), ("sort=stars&order=desc", None), ("page", "page"), ("per_page", "lim")), "NULL", "NULL", NO_SPAN),
    "mojeek-web": (asks("https://www.mojeek.com/search", ("q", "query"), ("safe", by("safe", "0", "1", "1")), ("s", LATER.format("10 * (page - 1)")), ("since", SINCE)), "NULL", f"'arc=' || {LAND} || '; lb=' || {LANG}", "page > 10"),
    "yahoo-web": (f"{YAHOO} || {line(('p', 'query'), ('btf', by('span', 'd', 'w', 'm')))} || CASE WHEN page = 1 THEN '&iscqry=' ELSE '&b=' || (page * 7 + 1) || '&pz=7&bct=0&xargs=0' END", "NULL", YAHOO_COOKIE, "page > 10 OR span IS NOT DISTINCT FROM 'year'"),
    "yandex-web": (asks("https://yandex.com/search/site/", ("tmpl_version=releases", None), ("text", "query"), ("web=1&frame=1&searchid=3131712", None), ("p", "page - 1"), ("lang", LANG)), "NULL", "NULL", f"page > 10 OR {NO_SPAN}"),
    "baidu-web": (asks("https://www.baidu.com/s", ("wd", "query"), ("pn", "10 * (page - 1)"), ("rn", TEN), ("ie=utf-8", None)), "NULL", "NULL", f"page > 10 OR {NO_SPAN}"),
    "google-web": (asks("https://www.google.com/search", ("q", "query"), ("start", "10 * (page - 1)"), ("num", TEN), ("hl", LANG), ("gl", LAND), ("safe", by("safe", "off", "active", "active")), ("filter=0", None), ("tbs", by("span", "qdr:d", "qdr:w", "qdr:m", "qdr:y"))), "NULL", "NULL", "page > 10"),
    "grokipedia": (asks("https://grokipedia.com/api/full-text-search", ("query", "query"), ("limit", TWENTY), ("offset", f"(page - 1) * {TWENTY}")), "NULL", "NULL", f"page > 10 OR {NO_SPAN}"),
    "openalex": (asks("https://api.openalex.org/works", ("search", "query"), ("page", "page"), ("per-page", "lim"), ("sort=relevance_score%3Adesc", None), ("select", f"'{outgoing.OPENALEX_FIELDS}'")), "NULL", "NULL", f"page > 100 OR {NO_SPAN}"),
    "exa-mcp": ("'https://mcp.exa.ai/mcp'", CALL, "NULL", "false"),
    "startpage-web": ("'https://www.startpage.com/sp/search'", STARTPAGE, "NULL", "page > 10"),
}
NO_TOKEN = {"duckduckgo-html": "page > 1 AND token IS NULL", "startpage-web": "token IS NULL"}


def wanted(k, kind="VARCHAR"):
    return "CASE engine_id " + " ".join(f"WHEN '{e}' THEN ({w[k]})::{kind}" for e, w in WANTED.items()) + " END"


MISSING = "CASE engine_id " + " ".join(f"WHEN '{e}' THEN {c}" for e, c in NO_TOKEN.items()) + " ELSE false END"


@query(f"""WITH r AS (SELECT item_id AS request_id, text AS query, [1, 2, 12][item_id % 3 + 1]::BIGINT AS page, 10 + item_id % 11 AS lim, [NULL, 'de-AT', 'fr_FR', 'zh-TW'][item_id % 4 + 1] AS locale, CASE WHEN item_id % 5 = 0 THEN 'ca' END AS country,
 ['off', 'moderate', 'strict'][item_id % 3 + 1] AS safe, ['day', 'week', 'month', 'year', NULL, NULL, NULL, NULL][item_id % 8 + 1] AS span, CASE WHEN item_id % 7 > 0 THEN 'tok&' || item_id END AS token, DATE '2024-03-31' AS today FROM benchmark),
 a AS (SELECT *, unnest([{PLACE}]) AS engine_id FROM r), f AS (SELECT *, CASE WHEN {wanted(3, "BOOLEAN")} THEN 'UNSUPPORTED_CAPABILITY' WHEN {MISSING} THEN 'INVALID_REQUEST' END AS failure FROM a)
 SELECT request_id, engine_id, failure, CASE WHEN failure IS NULL THEN {wanted(0)} END AS url, CASE WHEN failure IS NULL THEN {wanted(1)} END AS body, CASE WHEN failure IS NULL THEN {wanted(2)} END AS cookies,
 CASE WHEN failure IS NULL THEN CASE WHEN {wanted(1)} IS NULL THEN 'GET' ELSE 'POST' END END AS method FROM f""")
def provider_requests(spark, d):
    """What every provider would be asked for every benchmark item, by page, locale and so on."""
    n = F.col("item_id")
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (n % len(xs)).cast("int"))
    rows = S.read(spark, d, "benchmark").select(
        n.alias("request_id"), F.col("text").alias("query"), pick(1, 2, 12).alias("page"), (10 + n % 11).cast("int").alias("limit"), pick(None, "de-AT", "fr_FR", "zh-TW").alias("locale"), F.when(n % 5 == 0, "ca").alias("country"),
        pick("off", "moderate", "strict").alias("safe_search"), pick("day", "week", "month", "year", None, None, None, None).alias("time_range"), F.when(n % 7 > 0, F.concat(F.lit("tok&"), n.cast("string"))).alias("token"),
        F.lit("2024-03-31").cast("date").alias("today"), F.explode(F.array(*map(F.lit, IDS))).alias("engine_id"),
    )
    return outgoing.requested(rows).select("request_id", "engine_id", "failure", "url", "body", "cookies", "method")


@query(f"""WITH s AS (SELECT CAST(doc_id // {PER_PAGE} AS VARCHAR) AS request_id, doc_id, row_number() OVER (PARTITION BY doc_id // {PER_PAGE} ORDER BY doc_id DESC) AS position FROM documents),
 u AS (SELECT request_id, 'https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esummary.fcgi?db=pubmed&id=' || string_agg(doc_id, '%2C' ORDER BY position) || '&retmode=json&version=2.0' AS url FROM s GROUP BY request_id)
 SELECT request_id, u.url AS asked, CAST(position AS INTEGER) AS position, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS url, 'Document ' || doc_id AS title FROM s JOIN u USING (request_id) WHERE (request_id::BIGINT) % 5 <> 2""")
def two_steps(spark, d):
    """PubMed's two steps: the ids that a search brought are what the second request asks
    for, and its stored response is joined by that address. A fifth of the searches failed."""
    n = F.floor(F.col("doc_id") / PER_PAGE)
    docs = S.read(spark, d, "documents").select(n.alias("request_id"), F.lit("pubmed").alias("engine_id"), (-F.col("doc_id")).alias("nth"), F.col("doc_id").alias("uid"), F.lit("").alias("url"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("content"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "uid"))), lambda x: x["uid"].cast("string"))
    listed = docs.groupBy("request_id").agg(ids.alias("ids"))
    found = F.to_json(F.struct(F.struct(F.col("ids").alias("idlist")).alias("esearchresult")))
    first = listed.select(F.col("request_id").cast("string").alias("request_id"), F.when(F.col("request_id") % 5 == 2, '{"error": "API rate limit exceeded"}').otherwise(found).alias("body"))
    asked = first.select("request_id", outgoing.second_step("pubmed", pubmed_ids(F.col("body"))).alias("asked"))
    second = wire.sent(docs, ["request_id"], ["pubmed"]).join(listed, "request_id").withColumns({"final_url": outgoing.second_step("pubmed", F.col("ids")), "request_id": F.col("request_id").cast("string")}).drop("ids")
    stored_rows = stored.load(spark, wire.kept(second, "second-step"), "engine_id = 'pubmed'")
    answered = asked.filter("asked IS NOT NULL").join(stored_rows.withColumnRenamed("request_id", "_sent_for"), F.col("asked") == F.col("final_url")).drop("_sent_for")
    return R.results(R.read(answered, ["pubmed"]), E.engines(spark)).join(asked, "request_id").select("request_id", "asked", "position", "url", "title")


TAKEN = """CASE WHEN n % 7 = 0 THEN 'unknown' WHEN n % 2 = 0 AND n % 4 = 0 THEN 'engine bangs cannot be combined with explicit categories' WHEN n % 3 = 0 AND n % 5 = 0 THEN 'category bangs cannot be combined with explicit engines' END"""


@query(f"""SELECT request_id, {TAKEN} AS failure, concat_ws(',', CASE WHEN n % 2 = 0 THEN 'arxiv' END, CASE WHEN n % 2 = 0 OR n % 5 = 0 THEN 'github' END, CASE WHEN n % 5 = 0 THEN 'pubmed' END) AS engines,
 concat_ws(',', CASE WHEN n % 3 = 0 THEN 'general' END, CASE WHEN n % 4 = 0 THEN 'news' END) AS categories FROM ({USER_TURNS})""")
def selection_conflicts(spark, d):
    """Shortcuts of all user turns against what they choose themselves."""
    n = F.col("n")
    some = lambda when, *xs: F.when(when, F.array(*map(F.lit, xs))).otherwise(F.array().cast("array<string>"))
    rows = user_turns(spark, d).select(
        "request_id", F.when(n % 7 == 0, "unknown").otherwise("ok").alias("status"), some(n % 5 == 0, "pubmed", "github").alias("engines"), some(n % 4 == 0, "news").alias("categories"),
        some(n % 2 == 0, "github", "arxiv").alias("bang_engines"), some(n % 3 == 0, "general").alias("bang_categories"),
    )
    return requests.combined(rows).select("request_id", "failure", F.array_join("engines", ",").alias("engines"), F.array_join("categories", ",").alias("categories"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
 SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM r WHERE rank BETWEEN (o_custkey % 3) * (2 + o_custkey % 4) + 1 AND (o_custkey % 3 + 1) * (2 + o_custkey % 4)""")
def paged_rows(spark, d):
    """A page of each customer's orders by price; page and size go by customer."""
    from pyspark.sql import Window as W

    n = F.col("o_custkey")
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    rows = S.read(spark, d, "orders").select("o_custkey", "o_orderkey", rank.alias("rank"))
    return requests.page_rows(rows, n % 3 + 1, 2 + n % 4)


@query("SELECT event_id, greatest(5000 + event_id - CAST(floor(value * 100) AS BIGINT), 0) AS left_ms FROM events")
def deadline_left(spark, d):
    left = requests.remaining_ms(5000 + F.col("event_id"), F.floor(F.col("value") * 100).cast("long"))
    return S.read(spark, d, "events").select("event_id", left.alias("left_ms"))


@query("""WITH r AS (SELECT page_id % 20 AS request_id, page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages)
 SELECT request_id, page_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY page_id) AS INTEGER) AS position FROM r WHERE lower(host) NOT IN (SELECT host FROM (SELECT lower(host) AS host, count(*) AS n FROM r GROUP BY lower(host)) ORDER BY n DESC, host LIMIT 1)""")
def own_hosts(spark, d):
    """Pages but for those of the commonest host, numbered anew in their request."""
    pages = S.read(spark, d, "pages").select((F.col("page_id") % 20).alias("request_id"), F.lit("brave-web").alias("engine_id"), F.col("page_id"), F.col("page_id").alias("position"), "url")
    host = F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)).alias("host")
    common = pages.groupBy(host).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").first()
    return merge.without_hosts(pages, [common["host"]] if common else []).select("request_id", "page_id", "position")


@query("""SELECT o_orderkey, 'a=' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE 1 END || ',b=' || CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 2 END || CASE WHEN o_orderkey % 2 = 0 THEN ',c=8' ELSE '' END AS last, 'a=1,b=2' || CASE WHEN o_orderkey % 2 = 0 THEN ',c=8' ELSE '' END AS first FROM orders""")
def map_unions(spark, d):
    """Maps of positions united, of equal keys the last value, or the first."""
    n = F.col("o_orderkey")
    of = lambda *kv: F.create_map(*[x if isinstance(x, type(n)) else F.lit(x) for x in kv])
    none = F.map_filter(of("x", F.lit(0).cast("long")), lambda k, _: k == "y")
    maps = F.array(of("a", F.lit(1).cast("long"), "b", F.lit(2).cast("long")), F.when(n % 2 == 0, of("b", F.lit(7).cast("long"), "c", F.lit(8).cast("long"))).otherwise(none), F.when(n % 3 == 0, of("a", n)).otherwise(none))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return S.read(spark, d, "orders").select("o_orderkey", text(merge.last_wins(maps)).alias("last"), text(merge.first_wins(maps)).alias("first"))


@query("SELECT DISTINCT event_id % 500 AS request_id, 'INTERNAL_ERROR' AS code FROM events WHERE event_id % 1000 = 7 OR event_id % 100 = 3")
def ranking_failures(spark, d):
    """Requests one of whose results stands at place 0, or has a weight below 0."""
    n = F.col("event_id")
    place = F.struct((n % 1000 != 7).cast("int").alias("position"), F.when(n % 100 == 3, -1.0).otherwise(1.0).alias("weight"))
    return rank.ranking_errors(S.read(spark, d, "events").select((n % 500).alias("request_id"), F.array(place).alias("contributions")))


CAPABLE = ", ".join(f"('{e[0]}', {e[6]}, {e[7]!r}::VARCHAR[])" for e in E.ENGINES)


@query(f"""WITH e(engine_id, most, ranges) AS (VALUES {CAPABLE}), r AS (SELECT o_orderkey, o_orderkey % 700 AS page, CASE o_orderkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'year' END AS span FROM orders)
 SELECT o_orderkey, engine_id FROM r, e WHERE (most > 0 AND page > most) OR (span IS NOT NULL AND NOT list_contains(ranges, span))""")
def capability_failures(spark, d):
    n = F.col("o_orderkey")
    rows = S.read(spark, d, "orders").select("o_orderkey", (n % 700).alias("page"), F.when(n % 3 == 0, "day").when(n % 3 == 1, "year").alias("time_range"), F.array().cast("array<string>").alias("engines"), F.array().cast("array<string>").alias("categories"))
    each = requests.select_engines(rows, E.engines(spark))
    return each.filter(requests.capability_failure(F.col("page"), F.col("time_range"), F.col("max_page"), F.col("time_ranges")) == "UNSUPPORTED_CAPABILITY").select("o_orderkey", "engine_id")


CODE_VALUES = ", ".join(f"({i}, '{c[0]}', {c[1]}, '{c[2]}')" for i, c in enumerate(errors.CODES))


@query(f"""WITH c(i, code, status, title) AS (VALUES {CODE_VALUES}) SELECT event_id, status, title, 'https://problems.invalid/' || replace(lower(code), '_', '-') AS type, code IN ('ENGINE_TIMEOUT', 'ENGINE_RATE_LIMITED') AS retryable,
 CASE WHEN code IN ({", ".join(f"'{k}'" for k in errors.FAILURE_KINDS)}) THEN code ELSE 'INTERNAL_ERROR' END AS engine_code FROM events JOIN c ON event_id % {len(errors.CODES)} = i""")
def error_problem(spark, d):
    code = F.element_at(F.array(*[F.lit(c[0]) for c in errors.CODES]), (F.col("event_id") % len(errors.CODES) + 1).cast("int"))
    body = F.try_parse_json(errors.problem(code, F.lit("x"), F.lit("/v1/search"), F.col("event_id").cast("string")))
    at = lambda k, kind="string": F.try_variant_get(body, f"$.{k}", kind).alias(k)
    return S.read(spark, d, "events").select("event_id", at("status", "int"), at("title"), at("type"), classify.retryable(code).alias("retryable"), errors.code_of(code).alias("engine_code"))


# ---- Caches, cursors, state ----
@query("""WITH c AS (SELECT user_id AS key, event_id % 5 = 0 AS partial, 1000 + event_id + CASE WHEN event_id % 5 = 0 THEN 20 WHEN event_id % 3 = 0 THEN 180 ELSE 60 END AS expires_at FROM events)
 SELECT key, partial, max(expires_at) AS expires_at, count(*) AS n FROM c GROUP BY ALL""")
def cache_entries(spark, d):
    """An answer for each event, stored for the least time of its engines, or a little if it is partial."""
    n = F.col("event_id")
    rows = S.read(spark, d, "events").select(n.alias("request_id"), F.col("user_id").alias("key"), (n % 5 == 0).alias("partial"), F.lit("{}").alias("body"))
    selected = rows.filter(F.col("request_id") % 3 != 0).select("request_id", F.explode(F.array(F.lit(60), F.lit(900))).alias("response_ttl_s"))
    entries = cache.answer_entries(rows, selected, 1000 + F.col("request_id"))
    ended = entries.withColumn("partial", rows_partial(F.col("expires_at")))
    return ended.groupBy("key", "partial").agg(F.max("expires_at").alias("expires_at"), F.count("*").alias("n"))


def rows_partial(expires_at):
    """Answers end after 20, 60 or 180 seconds, and start at 1000 plus their number; a partial one's number is divisible by 5."""
    return (expires_at - 1020) % 5 == 0


@query("""WITH e AS (SELECT user_id AS key, arg_max(event_id % 5 = 0, event_id) AS negative FROM events GROUP BY user_id HAVING max(event_id + CASE WHEN event_id % 5 = 0 THEN 30 ELSE 300 END) > 500)
 SELECT c_custkey, CASE WHEN key IS NULL THEN 'ask' ELSE 'cached' END AS todo FROM customer LEFT JOIN (SELECT DISTINCT user_id AS key FROM events WHERE event_id + CASE WHEN event_id % 5 = 0 THEN 30 ELSE 300 END > 500) ON c_custkey = key WHERE c_custkey % 4 <> 0""")
def cache_plan(spark, d):
    """Customers as requests: a quarter are answered whole, others by an engine's part or failure that is still alive."""
    n = F.col("event_id")
    reports = S.read(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.lit("{}").alias("body"), F.when(n % 5 == 0, "ENGINE_TIMEOUT").alias("failure_kind"), F.lit(300).alias("response_ttl_s"), F.lit(30).alias("negative_ttl_s"), n.alias("at"))
    parts = cache.engine_entries(reports, F.col("at"))
    asked = S.read(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.lit("github").alias("engine_id"), F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").cast("string").alias("engine_key"))
    answers = asked.filter("request_id % 4 = 0").select("key", F.lit(False).alias("negative"), F.lit(10_000).alias("expires_at"))
    todo, found = cache.to_compute(asked, answers, parts, F.lit(500))
    name = lambda rows, what: rows.select(F.col("request_id").alias("c_custkey"), F.lit(what).alias("todo"))
    return name(todo, "ask").unionByName(name(found, "cached"))


@query("""SELECT o_orderkey AS request_id, e AS engine_id, CASE WHEN (e = 'arxiv' AND o_orderkey % 2 = 0) OR (e = 'github' AND o_orderkey % 3 = 0) THEN e || o_orderkey END AS engine_cursor FROM orders, (VALUES ('arxiv'), ('github'), ('pubmed')) v(e)""")
def engine_cursors(spark, d):
    n = F.col("o_orderkey")
    mine = lambda e: F.concat(F.lit(e), n.cast("string"))
    orders = S.read(spark, d, "orders").select(n.alias("request_id"), F.map_filter(F.create_map(F.lit("arxiv"), F.when(n % 2 == 0, mine("arxiv")), F.lit("github"), F.when(n % 3 == 0, mine("github"))), lambda _, v: v.isNotNull()).alias("engine_cursors"))
    selected = orders.select("request_id", F.explode(F.array(*map(F.lit, ("arxiv", "github", "pubmed")))).alias("engine_id"))
    return cache.with_cursors(selected, orders)


KEY = b"a key for tests, longer than the sixty-four bytes that a block of the hash holds"
PADS = ["".join(f"\\x{b:02X}" for b in pad) for pad in cursors.pads(KEY)]
NOW = 1_700_000_000_000


def hmac_sql(message):
    return f"unhex(sha256('{PADS[1]}'::BLOB || unhex(sha256('{PADS[0]}'::BLOB || ({message})))))"


def url64(blob):
    return f"rtrim(translate(to_base64({blob}), '+/', '-_'), '=')"


BODY = f"""'{{"query_hash":"' || sha256(o_orderpriority) || '","page":' || (o_orderkey % 9 + 1) || ',"engine_cursors":{{' || CASE WHEN o_orderkey % 2 = 0 THEN '"arxiv":"a' || o_orderkey || '",' ELSE '' END || '"github":"g' || o_orderkey || '"}},"expires_at_ms":' || ({NOW} - (o_orderkey % 5) * 250000 + {cursors.CURSOR_MS}) || '}}'"""


def cursor_rows(spark, d):
    """Orders with their cursors, of pages 1 to 9 and up to a thousand seconds old; some are spoiled."""
    n = F.col("o_orderkey")
    held = F.create_map(F.lit("github"), F.concat(F.lit("g"), n.cast("string")), F.lit("arxiv"), F.when(n % 2 == 0, F.concat(F.lit("a"), n.cast("string"))))
    rows = S.read(spark, d, "orders").select("o_orderkey", F.sha2("o_orderpriority", 256).alias("query_hash"), (n % 9 + 1).alias("page"), F.map_filter(held, lambda _, v: v.isNotNull()).alias("held"))
    made = cursors.sign(F.col("query_hash"), F.col("page"), F.col("held"), F.lit(NOW) - (n % 5) * 250_000, KEY)
    return rows.withColumn("cursor", made)


@query(f"""WITH c AS (SELECT o_orderkey, encode({BODY}) AS body FROM orders) SELECT o_orderkey, {url64('body')} || '.' || {url64(hmac_sql('body'))} AS cursor FROM c""")
def cursor_sign(spark, d):
    return cursor_rows(spark, d).select("o_orderkey", "cursor")


@query(f"""WITH r AS (SELECT o_orderkey, o_orderkey % 7 AS spoiled, o_orderkey % 5 AS age, o_orderkey % 9 + 1 AS page FROM orders)
 SELECT o_orderkey, CASE WHEN spoiled IN (1, 2, 3, 4) OR age = 4 THEN 'INVALID_CURSOR' END AS failure, CASE WHEN spoiled IN (1, 2, 3, 4) OR age = 4 THEN NULL ELSE page END AS page,
 CASE WHEN spoiled IN (1, 2, 3, 4) OR age = 4 THEN NULL ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'arxiv=a' || o_orderkey || ',' ELSE '' END || 'github=g' || o_orderkey END AS engine_cursors FROM r""")
def cursor_open(spark, d):
    """Cursors of all orders come back; altered, cut, foreign and expired ones do not."""
    n, c = F.col("o_orderkey") % 7, F.col("cursor")
    other = F.when(F.substr(c, F.lit(20), F.lit(1)) == "A", "B").otherwise("A")
    spoiled = F.when(n == 1, F.overlay(c, other, 20)).when(n == 2, F.substring_index(c, ".", 1)).when(n == 3, F.concat(c, F.lit("*"))).otherwise(c)
    query_hash = F.when(n == 4, F.sha2(F.lit("another query"), 256)).otherwise(F.col("query_hash"))
    rows = cursor_rows(spark, d).withColumns({"cursor": spoiled, "query_hash": query_hash, "page": F.lit(1)})
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("engine_cursors")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return cursors.resumed(rows, KEY, F.lit(NOW)).select("o_orderkey", "failure", "page", flat.alias("engine_cursors"))


@query("""SELECT o_orderkey, 'state:duckduckgo-html:continuation:' || sha256(o_orderpriority || chr(0) || CASE WHEN o_orderkey % 2 = 0 THEN 'de-DE' ELSE chr(1) END || chr(0) || 'strict' || chr(0) || chr(1)) AS key FROM orders""")
def state_key(spark, d):
    key = cache.continuation_key(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "de-DE"), F.lit("strict"), F.lit(None).cast("string"))
    return S.read(spark, d, "orders").select("o_orderkey", cache.state_key("state", F.lit("duckduckgo-html"), key).alias("key"))


@query("""WITH v AS (SELECT event_id % 100 AS key, ['duckduckgo-html', 'startpage-web', 'semantic-scholar', 'github'][CAST(event_id % 4 + 1 AS INTEGER)] AS engine_id, event_id, event_id AS sec FROM events)
 SELECT engine_id, key, max(event_id) AS value FROM v GROUP BY ALL HAVING max(sec) + CASE engine_id WHEN 'duckduckgo-html' THEN 900 WHEN 'startpage-web' THEN 3600 WHEN 'semantic-scholar' THEN 300 ELSE 180 END > 1000""")
def continuations(spark, d):
    n = F.col("event_id")
    engine = F.element_at(F.array(*map(F.lit, ("duckduckgo-html", "startpage-web", "semantic-scholar", "github"))), (n % 4 + 1).cast("int"))
    return cache.continuations(S.read(spark, d, "events").select((n % 100).alias("key"), engine.alias("engine_id"), n.alias("value"), n.alias("at")), F.lit(1000)).select("engine_id", "key", "value")


# ---- Telemetry ----
@query("""SELECT event_type AS engine_id, 'search' AS event, CASE WHEN event_id % 5 = 0 THEN 'failure' ELSE 'success' END AS outcome, CASE WHEN event_id % 5 = 0 THEN 'ENGINE_TIMEOUT' ELSE 'none' END AS failure_kind, 'unknown' AS parser_version,
 count(*) AS n, round(sum(value), 4) AS duration_ms FROM events GROUP BY ALL""")
def telemetry_points(spark, d):
    n = F.col("event_id")
    rows = S.read(spark, d, "events").select(
        F.col("event_type").alias("engine_id"), F.when(n % 5 == 0, "ENGINE_TIMEOUT").alias("failure_kind"), F.lit(None).cast("string").alias("parser_version"), F.lit("MISS").alias("cache_status"), F.col("value").alias("duration_ms"),
        n.alias("response_bytes"), F.lit(0).alias("parse_ms"), F.lit(1).alias("result_count"), F.lit(0).alias("redirect_count"),
    )
    points = telemetry.points(rows)
    return points.groupBy("engine_id", "event", "outcome", "failure_kind", "parser_version").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 4).alias("duration_ms"))


@query("""SELECT event_id AS request_id, sha256(event_type) AS query_hash, CASE WHEN event_id % 2 = 0 THEN 'arxiv' ELSE 'arxiv,github' END AS successful, CASE WHEN event_id % 2 = 0 THEN 'github' ELSE '' END AS failed FROM events""")
def log_lines(spark, d):
    n = F.col("event_id")
    rows = S.read(spark, d, "events").select(n.alias("request_id"), F.col("event_type").alias("query"), F.lower("event_type").alias("provider_query"), F.lit(False).alias("cached"), F.lit(5).alias("duration_ms"), F.lit(1).alias("result_count"), (n % 2 == 0).alias("partial"), F.array().cast("array<string>").alias("bangs"))
    reports = rows.select("request_id", F.explode(F.array(F.lit("github"), F.lit("arxiv"))).alias("engine_id")).withColumn("failure_kind", F.when((F.col("request_id") % 2 == 0) & (F.col("engine_id") == "github"), "ENGINE_TIMEOUT"))
    line = lambda k: F.array_join(F.from_json(F.get_json_object("line", f"$.{k}"), "array<string>"), ",")
    return telemetry.log_lines(rows, reports).select("request_id", F.get_json_object("line", "$.query_hash").alias("query_hash"), line("successful_engines").alias("successful"), line("failed_engines").alias("failed"))


@query("""WITH c AS (SELECT ['duckduckgo-html', 'google-web'][CAST(user_id % 2 + 1 AS INTEGER)] AS engine_id, epoch_ms(ts) AS ms, event_id, CASE event_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 's' ELSE 'x' END AS cmd FROM events),
 k AS (SELECT engine_id, ms, event_id, CASE WHEN cmd = 'f' AND engine_id = 'google-web' THEN 300000 WHEN cmd = 'x' THEN NULL WHEN cmd = 's' THEN 0 END AS pause FROM c WHERE cmd = 's' OR (cmd = 'f' AND engine_id = 'google-web')),
 h AS (SELECT engine_id, ms, least(ms + pause, coalesce(lead(ms) OVER (PARTITION BY engine_id ORDER BY ms, event_id), ms + pause)) AS until FROM k),
 r AS (SELECT event_id AS request_id, engine_id, ms + 1000 AS ms FROM c)
 SELECT request_id, r.engine_id, bool_or(h.ms IS NOT NULL) AS stopped FROM r LEFT JOIN h ON r.engine_id = h.engine_id AND r.ms >= h.ms AND r.ms < h.until GROUP BY ALL""")
def cooldown_gate(spark, d):
    """Events report on two engines; a second after each, the engine is asked again. Only
    one of them pauses when access is denied, which is what fails here."""
    n, at = F.col("event_id"), T.rounded_millis(F.col("ts").cast("timestamp"))
    engine = F.element_at(F.array(F.lit("duckduckgo-html"), F.lit("google-web")), (F.col("user_id") % 2 + 1).cast("int"))
    kind = F.when(n % 3 == 0, "ENGINE_ACCESS_DENIED").when(n % 3 == 2, "ENGINE_TIMEOUT")
    rows = S.read(spark, d, "events").select(engine.alias("engine_id"), at.alias("at_ms"), n.alias("nth"), kind.alias("failure_kind"))
    snapshots = state.coordinate(state.commands_of(rows))
    asked = rows.select(F.col("nth").alias("request_id"), "engine_id", (F.col("at_ms") + 1000).alias("at_ms"))
    return state.gate(asked, snapshots).select("request_id", "engine_id", F.col("failure_kind").isNotNull().alias("stopped"))


# ---- Crawl ----
@query("""WITH u AS (SELECT request_id, url, min(rank) AS rank FROM (SELECT page_id // 7 AS request_id, page_id AS rank, url FROM pages) GROUP BY ALL)
 SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rank) AS INTEGER) AS nth, url FROM u QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY rank) <= 3""")
def crawl_targets(spark, d):
    rows = S.read(spark, d, "pages").select(F.floor(F.col("page_id") / 7).alias("request_id"), F.col("page_id").alias("rank"), "url")
    return crawl.to_crawl(rows)


@query(f"""WITH {PAGES}, t AS (SELECT page_id, url, trim(regexp_replace(substr(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), 1, 512), '\\s+', ' ', 'g')) AS title,
  substr({STRIPPED.format("regexp_replace(html, '(?s)^.*?<body[^>]*>', '')")}, 1, 262144) AS text FROM p),
 l AS (SELECT page_id, string_agg('- ' || link, chr(10) ORDER BY nth) AS l FROM links WHERE nth <= 64 GROUP BY page_id)
 SELECT page_id, url AS canonical_url, CASE WHEN title = '' THEN url ELSE title END AS title, md5(regexp_replace(substr(concat_ws(chr(10), text, '', '## Discovered links', '', l), 1, 600), '\\s+$', '')) AS content_md5,
  CAST(page_id AS DOUBLE) / 4 AS index_score, 'documents/' || sha256(url) || '.md' AS item FROM t LEFT JOIN l USING (page_id) WHERE text <> ''""")
def chunk_results(spark, d):
    """Every stored page comes back from its Markdown as a result."""
    docs = crawl.documents(crawl.pages(S.read(spark, d, "pages")), "2026-01-01T00:00:00Z")
    none = F.lit(None).cast("string")
    chunks = docs.select(F.col("page_id").alias("request_id"), F.lit(1).alias("position"), F.col("markdown").alias("text"), none.alias("url"), none.alias("title"), (F.col("page_id") / 4).alias("score"), "key")
    rows = crawl.chunk_results(chunks)
    content = F.md5(F.regexp_replace("content", r"\s+$", ""))
    return rows.select(F.col("request_id").alias("page_id"), "canonical_url", "title", content.alias("content_md5"), "index_score", F.get_json_object("metadata", "$.index_item").alias("item"))


@query("""WITH h AS (SELECT url, page_id % 3 = 0 AS held FROM pages) SELECT url FROM h WHERE url NOT IN (SELECT url FROM h WHERE held)""")
def crawl_fresh(spark, d):
    """Pages that no marker of the last day holds back: a third were crawled an hour ago, a third two days ago."""
    raw = S.read(spark, d, "pages")
    now = F.lit("2026-01-03 00:00:00").cast("timestamp")
    ago = lambda n, hours: crawl.markers(raw.filter(F.col("page_id") % 3 == n), now - F.expr(f"INTERVAL {hours} HOURS"))
    return crawl.fresh(raw.select("url"), ago(0, 1).unionByName(ago(1, 48)), now)
