"""The requests that providers are sent, as columns: method, URL, body, cookies.

Nothing is sent. A row of requests (request_id, engine_id, query, page, limit, locale,
country, safe_search, time_range, today, token) becomes what its engine's first or only
data request would be, or the kind of failure that stops it before. ``token`` is what an
earlier step found: a continuation, a page's hidden token, ids, an address for contact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from beaconq.functions import text as T

UNSUPPORTED, INVALID = "UNSUPPORTED_CAPABILITY", "INVALID_REQUEST"
REQUEST = "struct<method: string, url: string, body: string, cookies: string, failure: string>"
#: Characters that a path segment keeps, besides letters, digits and those that a form keeps.
SEGMENT_KEPT = "!$&'()+,:;=@[]|~^"

C = F.col


def page_() -> Column:
    return C("page")


def limit_() -> Column:
    return C("limit")


def asked_() -> tuple[str, Column]:
    return "q", C("query")


def language_() -> Column:
    return T.language_of(F.coalesce(C("locale"), F.lit("en-US")))


def country_() -> Column:
    return F.coalesce(T.country_of(F.coalesce(C("locale"), F.lit("en-US")), C("country")), F.lit("US"))


def form_encoded(text: Column) -> Column:
    return F.url_encode(text)


def segment_encoded(text: Column) -> Column:
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in SEGMENT_KEPT:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def pairs(*named: tuple[str, Column | str]) -> Column:
    """Form-encoded pairs in order; a pair whose value is null is left out."""
    each = [F.concat(F.lit(f"{k}="), form_encoded(v.cast("string")) if isinstance(v, Column) else F.lit(v)) for k, v in named]
    return F.array_join(F.array_compact(F.array(*each)), "&")


def coded(column: str, codes: dict[str, str]) -> Column:
    """A value by its code; null for one that has none."""
    out = F.lit(None).cast("string")
    for value, code in codes.items():
        out = F.when(C(column) == value, code).otherwise(out)
    return out


def after_first(value: Column) -> Column:
    return F.when(page_() > 1, value)


SAFE = ("off", "moderate", "strict")
SPANS = ("day", "week", "month", "year")


def safe(*codes: str) -> Column:
    return coded("safe_search", dict(zip(SAFE, codes)))


def span(*codes: str) -> Column:
    return coded("time_range", dict(zip(SPANS, codes)))


#: Hosts by country, languages by name.
YAHOO_HOSTS = {
    "CA": "ca", "DE": "de", "FR": "fr", "GB": "uk", "UK": "uk", "BR": "br", "IN": "in", "ES": "espanol", "MX": "mx", "SG": "sg", "HK": "hk", "TW": "tw",
}
YAHOO_LANGUAGES = ["ar", "de", "es", "fr", "it", "ja", "ko", "nl", "pl", "pt", "ru", "sv", "tr"]
WIKIPEDIA_LANGUAGES = ["fr", "de", "es"]


def yahoo_url() -> Column:
    host = F.create_map(*[F.lit(x) for k, v in YAHOO_HOSTS.items() for x in (k, v)])[country_()]
    host = F.coalesce(host, F.when(language_() == "zh", "hk"))
    return F.concat(F.lit("https://"), F.coalesce(F.concat(host, F.lit(".")), F.lit("")), F.lit("search.yahoo.com/search"))


def yahoo_cookies() -> Column:
    chinese = F.when(country_().isin("TW", "HK"), "zh_cht").otherwise("zh_chs")
    language = F.when(language_() == "zh", chinese).when(language_().isin(*YAHOO_LANGUAGES), language_()).otherwise("en")
    return F.concat(F.lit("sB=v=1&vm="), safe("p", "i", "r"), F.lit("&fl=1&vl=lang_"), language, F.lit("&pn=10&rw=new&userset=1"))


def wikipedia_url() -> Column:
    language = F.when(language_().isin(*WIKIPEDIA_LANGUAGES), language_()).otherwise("en")
    return F.concat(F.lit("https://"), language, F.lit(".wikipedia.org/api/rest_v1/page/summary/"), segment_encoded(C("query")))


def arxiv_terms() -> Column:
    """Each word, without quotes and backslashes, as a quoted term, all of them required."""
    words = F.transform(F.split(T.collapse(C("query")), " "), lambda w: F.trim(F.translate(w, '"\\', "  ")))
    return F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit('all:"'), w, F.lit('"'))), " AND ")


def since() -> Column:
    return F.date_format(T.days_back(C("today"), C("time_range")), "yyyyMMdd")


def offset(size: Column | int) -> Column:
    return (page_() - 1) * size


@dataclass
class Request:
    """``most`` pages at most; ``spans``: time ranges that can be asked for (None: it is not looked at)."""

    url: Callable[[], Column] | str
    query: Callable[[], list[tuple[str, Column | str]]] = list
    body: Callable[[], Column] | None = None
    cookies: Callable[[], Column] | None = None
    most: int = 0
    spans: tuple[str, ...] | None = None
    unready: Callable[[], Column] = field(default=lambda: F.lit(False))

    def column(self) -> Column:
        base = F.lit(self.url) if isinstance(self.url, str) else self.url()
        query = self.query()
        url = F.concat(base, F.lit("?"), pairs(*query)) if query else base
        none = F.lit(None).cast("string")
        failure = none
        if self.most:
            failure = F.when(page_() > self.most, UNSUPPORTED).otherwise(failure)
        if self.spans is not None:
            failure = F.when(C("time_range").isNotNull() & ~C("time_range").isin(*self.spans), UNSUPPORTED).otherwise(failure)
        failure = F.coalesce(failure, F.when(self.unready(), INVALID))
        fine = failure.isNull()
        body = none if self.body is None else self.body()
        method = F.lit("GET" if self.body is None else "POST")
        cookies = none if self.cookies is None else self.cookies()
        return F.struct(
            F.when(fine, method).alias("method"), F.when(fine, url).alias("url"), F.when(fine, body).alias("body"),
            F.when(fine, cookies).alias("cookies"), failure.alias("failure"),
        ).cast(REQUEST)


OPENALEX_FIELDS = "id,doi,title,publication_date,primary_location,authorships,cited_by_count,open_access"


def scholar_body() -> Column:
    none = F.array().cast("array<string>")
    return F.to_json(
        F.struct(
            none.alias("authors"), none.alias("coAuthors"), F.lit(False).alias("getQuerySuggestions"), page_().alias("page"), limit_().alias("pageSize"), F.lit(True).alias("performTitleMatch"),
            C("query").alias("queryString"), F.lit("relevance").alias("sort"), none.alias("venues"),
        )
    )


def tool_call() -> Column:
    arguments = F.struct(limit_().alias("numResults"), C("query").alias("query"))
    call = F.struct(arguments.alias("arguments"), F.lit("web_search_exa").alias("name"))
    return F.to_json(F.struct(F.lit(2).alias("id"), F.lit("2.0").alias("jsonrpc"), F.lit("tools/call").alias("method"), call.alias("params")))


def ddg_form() -> Column:
    locale = F.lower(F.replace(C("locale"), F.lit("_"), F.lit("-")))
    kl = F.when(F.length(locale) >= 2, locale).otherwise("wt-wt")
    start = offset(limit_())
    return pairs(
        asked_(), ("b", ""), ("kl", kl), ("kp", safe("-2", "-1", "1")), ("s", after_first(start)), ("dc", after_first(start + 1)), ("vqd", C("token")), ("df", span("d", "w", "m", "y"))
    )


def startpage_form() -> Column:
    return pairs(
        ("query", C("query")), ("cat", "web"), ("t", "device"), ("sc", C("token")), ("abd", "1"), ("abe", "1"), ("qsr", "all"), ("qadf", safe("none", "moderate", "heavy")), ("language", "en"), ("lui", "en"),
        ("page", after_first(page_())), ("segment", after_first(F.lit("startpage.udog"))), ("with_date", span("d", "w", "m", "y")),
    )


def brave_cookies() -> Column:
    country = F.lower(country_())
    return F.concat(F.lit("country="), country, F.lit("; safesearch="), safe(*SAFE), F.lit("; summarizer=0; ui_lang="), language_(), F.lit("-"), country, F.lit("; useLocation=0"))


ten = lambda: F.least(limit_(), F.lit(10))
#: Addresses and parameters of each provider.
REQUESTS: dict[str, Request] = {
    "arxiv": Request("https://export.arxiv.org/api/query", lambda: [("search_query", arxiv_terms()), ("start", offset(limit_())), ("max_results", limit_())], unready=lambda: arxiv_terms() == ""),
    "wikipedia": Request(wikipedia_url, most=1),
    "duckduckgo-html": Request("https://html.duckduckgo.com/html/", body=ddg_form, most=20, unready=lambda: (page_() > 1) & C("token").isNull()),
    "brave-web": Request("https://search.brave.com/search", lambda: [asked_(), ("source", "web"), ("offset", after_first(page_() - 1)), ("tf", span("pd", "pw", "pm", "py"))], cookies=brave_cookies, most=10),
    "brave-news": Request("https://search.brave.com/news", lambda: [asked_(), ("offset", page_() - 1), ("safesearch", safe(*SAFE)), ("country", F.lower("country")), ("tf", span("pd", "pw", "pm", "py"))], most=10),
    "qwant-web": Request(
        "https://api.qwant.com/v3/search/web",
        lambda: [asked_(), ("count", ten()), ("locale", F.concat(language_(), F.lit("_"), country_())), ("offset", offset(ten())), ("tgp", "1"), ("device", "desktop"), ("safesearch", safe("0", "1", "2")), ("displayed", "true"), ("llm", "true")],
        most=5, spans=(),
    ),
    "pubmed": Request("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi", lambda: [("db", "pubmed"), ("term", C("query")), ("retmode", "json"), ("retstart", offset(limit_())), ("retmax", limit_()), ("sort", "relevance")], most=500, spans=()),
    "semantic-scholar": Request("https://www.semanticscholar.org/api/1/search", body=scholar_body, most=100),
    "crossref": Request("https://api.crossref.org/works", lambda: [("query.bibliographic", C("query")), ("rows", limit_()), ("offset", offset(limit_())), ("mailto", C("token"))], most=500, spans=()),
    "github": Request("https://api.github.com/search/repositories", lambda: [asked_(), ("sort", "stars"), ("order", "desc"), ("page", page_()), ("per_page", limit_())], spans=()),
    "mojeek-web": Request(
        "https://www.mojeek.com/search", lambda: [asked_(), ("safe", safe("0", "1", "1")), ("s", after_first(10 * (page_() - 1))), ("since", since())],
        cookies=lambda: F.concat(F.lit("arc="), country_(), F.lit("; lb="), language_()), most=10,
    ),
    "yahoo-web": Request(
        yahoo_url, lambda: [("p", C("query")), ("btf", span("d", "w", "m")), ("iscqry", F.when(page_() == 1, "")), ("b", after_first(page_() * 7 + 1)), ("pz", after_first(F.lit("7"))), ("bct", after_first(F.lit("0"))), ("xargs", after_first(F.lit("0")))],
        cookies=yahoo_cookies, most=10, spans=SPANS[:3],
    ),
    "yandex-web": Request("https://yandex.com/search/site/", lambda: [("tmpl_version", "releases"), ("text", C("query")), ("web", "1"), ("frame", "1"), ("searchid", "3131712"), ("p", page_() - 1), ("lang", language_())], most=10, spans=()),
    "baidu-web": Request("https://www.baidu.com/s", lambda: [("wd", C("query")), ("pn", 10 * (page_() - 1)), ("rn", ten()), ("ie", "utf-8")], most=10, spans=()),
    "google-web": Request(
        "https://www.google.com/search",
        lambda: [asked_(), ("start", 10 * (page_() - 1)), ("num", ten()), ("hl", language_()), ("gl", country_()), ("safe", F.when(C("safe_search") == "off", "off").otherwise("active")), ("filter", "0"), ("tbs", span("qdr:d", "qdr:w", "qdr:m", "qdr:y"))],
        most=10,
    ),
    "grokipedia": Request("https://grokipedia.com/api/full-text-search", lambda: [("query", C("query")), ("limit", F.least(limit_(), F.lit(20))), ("offset", offset(F.least(limit_(), F.lit(20))))], most=10, spans=()),
    "openalex": Request("https://api.openalex.org/works", lambda: [("search", C("query")), ("page", page_()), ("per-page", limit_()), ("sort", F.lit("relevance_score:desc")), ("select", F.lit(OPENALEX_FIELDS))], most=100, spans=()),
    "exa-mcp": Request("https://mcp.exa.ai/mcp", body=tool_call),
    "startpage-web": Request("https://www.startpage.com/sp/search", body=startpage_form, most=10, unready=lambda: C("token").isNull()),
}


def requested(rows: DataFrame) -> DataFrame:
    """Add ``method``, ``url``, ``body``, ``cookies`` and ``failure`` to requests of engines.

    An engine that nothing is known of is a failure. The optimizer does not merge a
    projection with an explode, so what each engine asks is in the plan once.
    """
    out = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("method", "url", "body", "cookies")], F.lit("UNKNOWN_ENGINE").alias("failure")).cast(REQUEST)
    for engine, request in REQUESTS.items():
        out = F.when(C("engine_id") == engine, request.column()).otherwise(out)
    return rows.select("*", F.explode(F.array(out)).alias("_r")).select(*rows.columns, "_r.*")


def second_step(engine: str, found: Column) -> Column:
    """URL of the request that follows from what the first brought: PubMed's ids."""
    if engine != "pubmed":
        raise ValueError(f"{engine} has no second step")
    return F.concat(F.lit("https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esummary.fcgi?"), pairs(("db", "pubmed"), ("id", F.array_join(found, ",")), ("retmode", "json"), ("version", "2.0")))
