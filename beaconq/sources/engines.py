"""The catalogue of providers and of query shortcuts, as small fixed tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Id, kind, categories, weight, response TTL, negative TTL, largest page (0: any), time ranges.
ENGINES = [
    ("arxiv", "atom", ["academic"], 1.25, 1800, 30, 0, []),
    ("wikipedia", "json", ["reference"], 1.15, 1800, 30, 1, []),
    ("duckduckgo-html", "html", ["general"], 1.0, 180, 30, 20, ["day", "week", "month", "year"]),
    ("brave-web", "html", ["general"], 1.1, 180, 30, 10, ["day", "week", "month", "year"]),
    ("brave-news", "html", ["news"], 1.0, 120, 30, 0, ["day", "week", "month", "year"]),
    ("qwant-web", "json", ["general"], 1.05, 180, 30, 5, []),
    ("pubmed", "json", ["academic"], 1.4, 900, 30, 500, []),
    ("semantic-scholar", "json", ["academic"], 1.35, 900, 30, 100, []),
    ("crossref", "json", ["academic"], 1.3, 900, 30, 500, []),
    ("github", "json", ["code"], 1.0, 300, 30, 0, []),
    ("mojeek-web", "html", ["general"], 1.0, 180, 30, 0, ["day", "week", "month", "year"]),
    ("yahoo-web", "html", ["general"], 0.9, 180, 30, 0, ["day", "week", "month"]),
    ("yandex-web", "html", ["general"], 0.9, 180, 30, 0, []),
    ("baidu-web", "html", ["general"], 0.9, 180, 30, 0, []),
    ("google-web", "html", ["general"], 1.0, 120, 30, 0, ["day", "week", "month", "year"]),
    ("grokipedia", "json", ["general", "reference"], 0.9, 300, 30, 0, []),
    ("openalex", "json", ["science"], 1.0, 900, 30, 0, []),
    ("exa-mcp", "json", ["general"], 1.0, 300, 60, 0, []),
    ("startpage-web", "html", ["general"], 0.9, 120, 60, 0, ["day", "week", "month", "year"]),
]
#: Shortcuts for categories, for sets of engines, and for engines.
CATEGORY_BANGS = {"general": "general", "web": "general"}
PROFILE_BANGS = {"books": ["crossref", "openalex"]}
ENGINE_BANGS = {
    "arxiv": "arxiv ax", "wikipedia": "wikipedia wp", "duckduckgo-html": "ddg", "brave-web": "brave",
    "brave-news": "news brave-news", "qwant-web": "qwant qw", "mojeek-web": "mojeek mj", "yahoo-web": "yahoo yh",
    "yandex-web": "yandex ya", "baidu-web": "baidu bd", "google-web": "google", "grokipedia": "grokipedia grok",
    "pubmed": "pubmed", "semantic-scholar": "semantic-scholar ss", "crossref": "crossref cr", "github": "github gh",
    "openalex": "openalex", "exa-mcp": "exa", "startpage-web": "startpage sp",
}
#: Display name, parser version, hosts that may be asked.
DETAILS = {
    "arxiv": ("arXiv", "arxiv-atom-v2", ["export.arxiv.org"]),
    "wikipedia": ("Wikipedia", "wikipedia-rest-summary-json-v2", ["en.wikipedia.org", "fr.wikipedia.org", "de.wikipedia.org", "es.wikipedia.org"]),
    "duckduckgo-html": ("DuckDuckGo HTML", "duckduckgo-html-v1", ["html.duckduckgo.com", "duckduckgo.com"]),
    "brave-web": ("Brave Web", "brave-web-html-v2", ["search.brave.com"]),
    "brave-news": ("Brave News", "brave-news-html-v1", ["search.brave.com"]),
    "qwant-web": ("Qwant Web", "qwant-web-json-v2", ["api.qwant.com", "www.qwant.com"]),
    "pubmed": ("PubMed", "pubmed-eutils-json-v1", ["eutils.ncbi.nlm.nih.gov"]),
    "semantic-scholar": ("Semantic Scholar", "semantic-scholar-web-search-json-v2", ["www.semanticscholar.org"]),
    "crossref": ("Crossref", "crossref-works-json-v1", ["api.crossref.org"]),
    "github": ("GitHub", "github-rest-json-v1", ["api.github.com"]),
    "mojeek-web": ("Mojeek Web", "mojeek-web-html-v1", ["www.mojeek.com"]),
    "yahoo-web": ("Yahoo Web", "yahoo-web-html-v1", ["search.yahoo.com", "ca.search.yahoo.com", "de.search.yahoo.com"]),
    "yandex-web": ("Yandex Web", "yandex-web-html-v1", ["yandex.com", "www.yandex.com"]),
    "baidu-web": ("Baidu Web", "baidu-web-html-v1", ["www.baidu.com"]),
    "google-web": ("Google Web", "google-web-html-v1", ["www.google.com"]),
    "grokipedia": ("Grokipedia", "grokipedia-full-text-json-v2", ["grokipedia.com"]),
    "openalex": ("OpenAlex", "openalex-works-json-v1", ["api.openalex.org"]),
    "exa-mcp": ("Exa MCP", "exa-streamable-http-mcp-v1", ["mcp.exa.ai"]),
    "startpage-web": ("Startpage Web", "startpage-web-react-v2", ["www.startpage.com"]),
}
#: The category of results where it is not the engine's first; engines that a setting must switch on.
RESULT_CATEGORIES = {"grokipedia": "reference"}
SWITCHED = {"google-web": "ENABLE_GOOGLE", "startpage-web": "ENABLE_STARTPAGE"}
ENGINE_SCHEMA = (
    "ordinal int, engine_id string, source_kind string, categories array<string>, weight double,"
    " response_ttl_s int, negative_ttl_s int, max_page int, time_ranges array<string>,"
    " display_name string, parser_version string, allowed_hosts array<string>, result_category string, default_enabled boolean, switch string"
)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table that is part of the plan; made from a list, it would be read by Python workers of its own."""
    kinds = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.table([list(c) for c in zip(*rows)], names=kinds.names), kinds)


def engines(spark: SparkSession) -> DataFrame:
    """The catalogue, in its order."""
    rows = [(i, *e, *DETAILS[e[0]], RESULT_CATEGORIES.get(e[0], e[2][0]), True, SWITCHED.get(e[0])) for i, e in enumerate(ENGINES)]
    return local_rows(spark, rows, ENGINE_SCHEMA)


def engine(spark: SparkSession, engine_id: str) -> DataFrame:
    """One engine, or no row for an id that is unknown."""
    return engines(spark).filter(F.col("engine_id") == engine_id)


def bang_rows() -> list[tuple[str, str, list[str]]]:
    rows = [(a, "category", [c]) for a, c in CATEGORY_BANGS.items()]
    rows += [(a, "engine", ids) for a, ids in PROFILE_BANGS.items()]
    return rows + [(a, "engine", [e]) for e, aliases in ENGINE_BANGS.items() for a in aliases.split()]


def bangs(spark: SparkSession) -> DataFrame:
    return local_rows(spark, bang_rows(), "alias string, kind string, targets array<string>")
