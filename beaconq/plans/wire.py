"""Bodies in the form that each provider sends, made from rows of the given tables.

There are no stored responses among the tables, so queries over responses write some
first, from documents, and read them through ``sources.stored``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from beaconq.session import shared_path
from beaconq.sources import engines as E, responses as R, stored

IDS = [e[0] for e in E.ENGINES]


def json_body(item, path: str, more: str = ""):
    """Ten items as a JSON body: ``path`` names the objects around the list."""
    names = path.split(".")
    head = "".join(f'{{"{n}":' for n in names[:-1]) + f'{{{more}"{names[-1]}":'
    return lambda rows: F.concat(F.lit(head), F.to_json(F.transform(rows, item)), F.lit("}" * len(names)))


def page_body(item):
    return lambda rows: F.concat(F.lit("<html><body><div id=\"links\">"), F.array_join(F.transform(rows, item), "\n"), F.lit("</div></body></html>"))


def fields(**given):
    return lambda r: F.struct(*[(c(r) if callable(c) else F.lit(c)).alias(k) for k, c in given.items()])


def one(column: str):
    return lambda r: r[column]


def many(column: str):
    return lambda r: F.array(r[column])


def escaped(text):
    """Text as it stands in markup."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def markup(pattern: str):
    """An item of a page from a pattern with {url}, {title} and {content}."""
    parts = re.split(r"\{(\w+)\}", pattern)
    return page_body(lambda r: F.concat(*[F.lit(p) if i % 2 == 0 else escaped(r[p]) for i, p in enumerate(parts)]))


WIRE = {
    "crossref": json_body(fields(title=many("title"), URL=one("url"), abstract=one("content")), "message.items", ""),
    "github": json_body(fields(full_name=one("title"), html_url=one("url"), description=one("content")), "items"),
    "openalex": json_body(lambda r: F.struct(r["title"].alias("title"), r["url"].alias("doi"), F.struct(F.struct(r["content"].alias("display_name")).alias("source")).alias("primary_location")), "results"),
    "grokipedia": json_body(fields(name=one("title"), page_url=one("url"), snippet=one("content")), "data.results"),
    "qwant-web": json_body(fields(title=one("title"), url=one("url"), desc=one("content")), "data.result.items"),
    "semantic-scholar": json_body(lambda r: F.struct(F.struct(r["title"].alias("text")).alias("title"), r["url"].alias("url"), r["content"].alias("abstract")), "data"),
    "wikipedia": json_body(fields(title=one("title"), fullurl=one("url"), extract=one("content")), "query.pages"),
    "exa-mcp": lambda rows: F.concat(F.lit("event: message\ndata: "), F.to_json(F.struct(F.struct(F.array(F.struct(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("Title: "), r["title"], F.lit("\nURL: "), r["url"], F.lit("\nHighlights:\n"), r["content"])), "\n\n---\n\n").alias("text"))).alias("content")).alias("result")))),
    "pubmed": lambda rows: F.concat(F.lit('{"result":{"uids":'), F.to_json(F.transform(rows, lambda r: r["uid"])), F.lit(","), F.array_join(F.transform(rows, lambda r: F.concat(F.lit('"'), r["uid"], F.lit('":'), F.to_json(F.struct(r["title"].alias("title"), r["content"].alias("source"))))), ","), F.lit("}}")),
    "arxiv": lambda rows: F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<entry><id>"), r["url"], F.lit("</id><title>"), escaped(r["title"]), F.lit("</title><summary>"), escaped(r["content"]), F.lit("</summary><published>2020-01-01</published></entry>"))), ""), F.lit("</feed>")),
    "duckduckgo-html": markup('<div class="web-result"><h2><a href="{url}">{title}</a></h2><a class="result__snippet">{content}</a></div>'),
    "brave-web": markup('<div class="snippet" data-type="web"><a class="l1" href="{url}"><div class="search-snippet-title">{title}</div></a><div class="content">{content}</div></div>'),
    "brave-news": markup('<div class="news-result"><a href="{url}"><b class="title">{title}</b></a><p class="content">{content}</p></div>'),
    "mojeek-web": markup('<ul class="results-standard"><li><h2><a class="ob" href="{url}">{title}</a></h2><p class="s">{content}</p></li></ul>'),
    "yahoo-web": markup('<div class="algo-sr"><div class="compTitle"><a href="https://r.search.yahoo.com/RU={url}/RK=0"><h3>{title}</h3></a></div><div class="compText">{content}</div></div>'),
    "yandex-web": markup('<li class="serp-item"><h3><a href="{url}">{title}</a></h3><div class="organic__text">{content}</div></li>'),
    "baidu-web": markup('<div class="c-container"><h3><a href="{url}">{title}</a></h3><div class="c-abstract">{content}</div></div>'),
    "google-web": markup('<div class="MjjYud"><a href="/url?q={url}&amp;sa=U"><h3>{title}</h3></a><div class="VwiC3b">{content}</div></div>'),
    "startpage-web": markup('<div class="result"><a class="result-title result-link" href="{url}">{title}</a><p class="result-description">{content}</p></div>'),
}
#: What stands before the list in bodies that say that all is well.
STATUS = {"crossref": '{"status":"ok",', "qwant-web": '{"status":"success",'}
MEDIA = {e[0]: R.MEDIA.get(e[0], R.MEDIA[e[1]])[0] for e in E.ENGINES}
HOST = {i: E.DETAILS[i][2][0] for i in IDS}


def of_engine(table: dict):
    return F.create_map(*[F.lit(x) for i in IDS for x in (i, table[i])])[F.col("engine_id")]


def sent(rows: DataFrame, by: list[str], engines: list[str] = IDS) -> DataFrame:
    """Responses from rows (by, engine_id, nth, uid, url, title, content): each group's items, in order, as one body."""
    item = F.struct("nth", F.col("uid").cast("string").alias("uid"), "url", "title", "content")
    grouped = rows.groupBy(*by, "engine_id").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    body = F.lit(None).cast("string")
    for engine in engines:
        made = WIRE[engine](F.col("rows"))
        made = F.concat(F.lit(STATUS[engine]), F.substr(made, F.lit(2))) if engine in STATUS else made
        body = F.when(F.col("engine_id") == engine, made).otherwise(body)
    return grouped.select(
        *by, "engine_id", F.lit(1).alias("page"), F.lit(200).alias("status"), F.create_map(F.lit("Content-Type"), of_engine(MEDIA)).alias("headers"), body.alias("body"),
        F.concat(F.lit("https://"), of_engine(HOST), F.lit("/search")).alias("final_url"), F.lit(None).cast("array<string>").alias("locations"), F.lit(10).cast("long").alias("duration_ms"),
    )


def kept(responses: DataFrame, name: str) -> str:
    """Write responses as a stored table; gives its path."""
    path = shared_path(responses.sparkSession, name)
    stored.write(responses, path)
    return path
