"""URL functions: native expressions for plain URLs, a pandas UDF for the others."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

#: Query parameters that only track, besides all that begin with utm_.
TRACKING = ["gclid", "fbclid", "mc_cid", "mc_eid", "ref_src"]
#: URLs that need no decoding: lower-case host, no port, no escapes, no dot segments.
PLAIN = r"^https?://[a-z0-9.-]+(/[A-Za-z0-9._~/-]*)?(\?[A-Za-z0-9._=&-]*)?(#.*)?$"
DOTS = r"/\.{1,2}(/|\?|#|$)"


@F.pandas_udf(StringType())
def _canonical_any(urls: pd.Series) -> pd.Series:  # pragma: no cover - runs in workers
    from beaconq.functions.urls import canonicalize

    return urls.map(canonicalize)


def canonicalize(url: str | None) -> str | None:
    """One spelling for a URL, or None if it is not http(s), has credentials or no host."""
    from urllib.parse import parse_qsl, quote, urlencode, urlsplit

    if url is None:
        return None
    cleaned = url.strip("".join(map(chr, range(0x21)))).translate({9: None, 10: None, 13: None}).replace("\\", "/")
    try:
        parts = urlsplit(cleaned)
        port, host = parts.port, parts.hostname
        if parts.scheme not in ("http", "https") or not host or "@" in parts.netloc:
            return None
        host = host if host.isascii() else host.encode("idna").decode()
    except (ValueError, UnicodeError):
        return None
    if ":" in host:
        host = f"[{host}]"
    if port is not None and port != {"http": 80, "https": 443}[parts.scheme]:
        host += f":{port}"
    path: list[str] = []
    segments = parts.path.split("/")[1:]
    for i, segment in enumerate(segments):
        dots = segment.lower().replace("%2e", ".")
        if dots == "..":
            path = path[:-1]
        elif dots != ".":
            path.append(segment)
            continue
        if i == len(segments) - 1:
            path.append("")
    pairs = [
        (k, v)
        for k, v in parse_qsl(parts.query, keep_blank_values=True, errors="replace")
        if not k.lower().startswith("utm_") and k.lower() not in TRACKING
    ]
    query = urlencode(sorted(pairs), safe="*").replace("~", "%7E")
    return f"{parts.scheme}://{host}/" + quote("/".join(path), safe="/%:@!$&'()*+,;=~[]|^") + (f"?{query}" if query else "")


def is_plain(url: Column) -> Column:
    return F.coalesce(url.rlike(PLAIN) & ~url.rlike(DOTS), F.lit(False))


def plain_canonical(url: Column) -> Column:
    """``canonicalize`` of a plain URL, by expressions."""
    bare = F.regexp_replace(url, "#.*$", "")
    base = F.substring_index(bare, "?", 1)
    slashed = F.when(base.rlike("^https?://[^/]+$"), F.concat(base, F.lit("/"))).otherwise(base)
    query = F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("")
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("k"),
            F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(TRACKING))
    text = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.concat(slashed, F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))


def canonicalized(rows: DataFrame, url: str = "url", to: str = "canonical_url") -> DataFrame:
    """Add the canonical URL, null if there is none, in one projection. Only URLs out of
    the plain kind go to Python."""
    plain = is_plain(F.col(url))
    return rows.withColumn(to, F.coalesce(_canonical_any(F.when(~plain, F.col(url))), F.when(plain, plain_canonical(F.col(url)))))


@F.pandas_udf(ArrayType(StringType()))
def resolved_links(base: pd.Series, hrefs: pd.Series) -> pd.Series:  # pragma: no cover - runs in workers
    from beaconq.functions.urls import join_url

    return pd.Series([[join_url(b, h) for h in listed] for b, listed in zip(base, hrefs)], dtype=object)


def join_url(base: str | None, href: str | None) -> str | None:
    """A link's target, resolved against its page's URL, in percent form; None if it cannot be."""
    from urllib.parse import quote, urljoin, urlsplit, urlunsplit

    if base is None or href is None:
        return None
    try:
        plain = "".join(c for c in href.strip("".join(map(chr, range(0x21)))) if c not in "\t\r\n").replace("\\", "/")
        parts = urlsplit(urljoin(base, plain))
        host = parts.hostname or ""
        netloc = parts.netloc if host.isascii() else parts.netloc.replace(host, host.encode("idna").decode())
    except (ValueError, UnicodeError):
        return None
    path = quote(parts.path, safe="/%:@!$&'()*+,;=~[]|^")
    return urlunsplit((parts.scheme, netloc, path, quote(parts.query, safe="/%:@!$&()*+,;=~[]|^?{}`\\"), quote(parts.fragment, safe="%")))


def crawlable(url: Column) -> Column:
    """Whether a crawler may fetch it: https, no credentials, no local or private host."""
    rest = F.regexp_extract(url, r"(?i)^https://([^/?#]+)", 1)
    host = F.lower(F.regexp_replace(rest, r":\d+$", ""))
    private = r"^(0|10|127|169\.254|172\.(1[6-9]|2\d|3[01])|192\.168)\."
    return (
        (rest != "")
        & ~F.contains(rest, F.lit("@"))
        & (host != "localhost")
        & ~host.endswith(".localhost")
        & ~host.endswith(".internal")
        & ~host.rlike(private)
    )


def crawl_url(url: Column) -> Column:
    """The URL without its fragment, with a path and a lower-case host, if a crawler may fetch it."""
    head = F.regexp_extract(url, r"(?i)^https://[^/?#]*", 0)
    rest = F.regexp_replace(F.substr(url, F.char_length(head) + 1), "#.*$", "")
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(crawlable(url), F.concat(F.regexp_replace(F.lower(head), ":443$", ""), path))


def unwrap_redirect(url: Column) -> Column:
    """The target of three known kinds of result redirects, else the URL itself."""
    def param(name: str) -> Column:
        return F.try_url_decode(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1))

    ddg, google = r"^(https?:)?//([a-z]+\.)?duckduckgo\.com/l/\?", r"^(https?://(www\.)?google\.com)?/url\?"
    yahoo = F.try_url_decode(F.regexp_extract(url, r"/RU=(.*?)/R[KS]", 1))
    return (
        F.when(url.rlike(ddg) & (param("uddg") != ""), param("uddg"))
        .when(url.rlike(google) & (param("q") != ""), param("q"))
        .when(url.rlike(google) & (param("url") != ""), param("url"))
        .when(yahoo != "", yahoo)
        .otherwise(url)
    )
