"""Crawl pages to documents, links and frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from beaconq.functions import text as T
from beaconq.functions.urls import crawl_url, resolved_links

MOST_LINKS, FRONTIER_LINKS, MARKER_HOURS, FRONTIER_DAYS = 64, 12, 24, 7
MOST_BYTES, TITLE_CHARS, TEXT_CHARS, METADATA_CHARS = 1 << 20, 512, 256 * 1024, 1024
#: Links that need no Python: rooted paths without dot segments or characters that are encoded in a way of their own.
ROOTED = r"""^/(?!/)[^\\\x00-\x20"#<>^`{|}\[\]]*(#.*)?$"""
DOTS = r"(?i)/(\.|%2e){1,2}(/|\?|#|$)"
#: Characters that stand for themselves in a path or query; % is the last to be put back.
KEPT = "/,;:@!$&'()=?~+%"


def hrefs(html: Column) -> Column:
    """The targets of a page's anchors as they are written, in order."""
    pattern = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    found = [F.regexp_extract_all(html, F.lit(pattern), k) for k in (1, 2, 3)]
    return F.filter(F.transform(F.arrays_zip(*[x.alias(c) for x, c in zip(found, "abc")]), lambda z: F.concat(z["a"], z["b"], z["c"])), lambda u: u != "")


def title(html: Column) -> Column:
    return T.collapse(F.substring(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), 1, TITLE_CHARS))


def body_text(html: Column) -> Column:
    return F.substring(T.strip_markup(F.regexp_replace(html, r"(?is)^.*?<body[^>]*>", "")), 1, TEXT_CHARS)


def pages(raw: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) that may be crawled, are not too large and have a text:
    page_id, url without fragment, title, text, links."""
    rows = raw.withColumn("url", crawl_url(F.col("url"))).filter(F.col("url").isNotNull() & (F.octet_length("html") <= MOST_BYTES))
    read = rows.select("page_id", "url", title(F.col("html")).alias("title"), body_text(F.col("html")).alias("text"), hrefs(F.col("html")).alias("hrefs"))
    return with_links(read.filter(F.col("text") != ""))


def encoded(path: Column) -> Column:
    """A rooted path with all that is not ASCII in percent form, and escapes as they are."""
    text = F.replace(F.url_encode(F.regexp_replace(path, "#.*$", "")), F.lit("+"), F.lit("%20"))
    for c in KEPT:
        text = F.replace(text, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return text


def with_links(rows: DataFrame) -> DataFrame:
    """Replace ``hrefs`` by ``links``: the first ``MOST_LINKS`` distinct targets that may be
    crawled, resolved against the page. Only pages with links of other kinds go to Python."""
    plain = F.forall("hrefs", lambda h: h.rlike(ROOTED) & ~h.rlike(DOTS))
    origin = F.regexp_extract("url", r"^https://[^/]+", 0)
    fast = rows.filter(plain).withColumn("_to", F.transform("hrefs", lambda h: F.concat(origin, encoded(h))))
    odd = rows.filter(~plain).withColumn("_to", resolved_links("url", "hrefs"))
    targets = F.filter(F.transform(F.col("_to"), crawl_url), lambda u: u.isNotNull())
    return fast.unionByName(odd).withColumn("links", F.slice(F.array_distinct(targets), 1, MOST_LINKS)).drop("_to", "hrefs")


def digest(url: Column) -> Column:
    return F.sha2(url, 256)


def documents(rows: DataFrame, fetched_at: str) -> DataFrame:
    """Key, Markdown with front matter, and metadata of each page."""
    safe = T.trimmed(F.regexp_replace("title", r"[\r\n]+", " "))
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    literal = lambda c: F.regexp_extract(quoted(c), r'(?s)^\{"v":(.*)\}$', 1)
    head = [
        F.lit("---"), F.concat(F.lit("url: "), literal(F.col("url"))), F.concat(F.lit("title: "), literal(safe)),
        F.concat(F.lit("fetched_at: "), literal(F.lit(fetched_at))), F.lit("---"), F.lit(""), F.lit(""),
        F.concat(F.lit("# "), F.when(safe == "", F.col("url")).otherwise(safe)), F.lit(""), F.col("text"), F.lit(""),
        F.lit("## Discovered links"), F.lit(""),
    ]
    bullets = F.transform("links", lambda u: F.concat(F.lit("- "), u))
    markdown = F.array_join(F.concat(F.array(*head), bullets, F.array(F.lit(""))), "\n")
    key = F.concat(F.lit("documents/"), digest(F.col("url")), F.lit(".md"))
    return rows.select("page_id", key.alias("key"), markdown.alias("markdown"), "url", F.substring("title", 1, METADATA_CHARS).alias("title"))


def fresh(pages: DataFrame, markers: DataFrame, now: Column) -> DataFrame:
    """Pages (url) that no marker (digest, fetched_at) of the last day holds back."""
    alive = markers.filter(F.col("fetched_at") > now - F.expr(f"INTERVAL {MARKER_HOURS} HOURS")).select("digest")
    return pages.withColumn("digest", digest(F.col("url"))).join(alive, "digest", "left_anti").drop("digest")


def markers(rows: DataFrame, now: Column) -> DataFrame:
    """What a crawl of the pages leaves: (digest, fetched_at, expires_at)."""
    return rows.select(digest(F.col("url")).alias("digest"), now.alias("fetched_at"), (now + F.expr(f"INTERVAL {MARKER_HOURS} HOURS")).alias("expires_at")).distinct()


def frontier(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Links of pages, the first ``FRONTIER_LINKS`` of each, that are not in ``seen`` (url): (digest, url)."""
    known = seen.select(crawl_url(F.col("url")).alias("url")).filter("url IS NOT NULL").distinct()
    new = rows.select(F.explode(F.slice("links", 1, FRONTIER_LINKS)).alias("url")).distinct().join(known, "url", "left_anti")
    return new.select(digest(F.col("url")).alias("digest"), "url")


def to_crawl(results: DataFrame, most: int = 3) -> DataFrame:
    """The first distinct URLs of each request's results (request_id, rank, url) to crawl, 0 to 10 of them."""
    first = results.filter(F.coalesce("url", F.lit("")) != "").groupBy("request_id", "url").agg(F.min("rank").alias("rank"))
    nth = F.row_number().over(W.partitionBy("request_id").orderBy("rank", "url"))
    return first.withColumn("nth", nth).filter(F.col("nth") <= min(max(most, 0), 10)).select("request_id", "nth", "url")


def chunk_results(chunks: DataFrame) -> DataFrame:
    """Chunks of stored documents (request_id, position, text, url, title, score, key) as
    results: URL and title from the metadata, else from front matter and heading."""
    front = F.nullif(F.regexp_extract("text", r"""(?m)^url:\s*["']?([^"'\n]+)["']?""", 1), F.lit(""))
    heading = F.nullif(T.trimmed(F.regexp_extract("text", r"(?m)^#[^\S\n]+(.+)$", 1)), F.lit(""))
    url = crawl_url(F.coalesce(F.nullif("url", F.lit("")), front))
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)\A---.*?---\s*", ""), r"(?m)^#[^\S\n]+.*$", "")
    rows = chunks.withColumn("_url", url).filter(F.col("_url").isNotNull())
    host = F.regexp_extract("_url", r"^https://([^/:]+)", 1)
    return rows.select(
        "request_id", F.col("position").alias("rank"), F.col("_url").alias("canonical_url"), F.coalesce(F.nullif("title", F.lit("")), heading, host).alias("title"),
        F.substring(T.trimmed(bare), 1, 600).alias("content"), F.array(F.lit("index")).alias("engines"), F.col("score").cast("double").alias("index_score"),
        F.to_json(F.struct(F.col("key").alias("index_item"), F.col("score").alias("index_score"))).alias("metadata"),
    )
