"""Parsers for stored bodies: HTML by selectors, Atom, event streams, embedded JSON."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, functions as F

from beaconq.functions import text as T

MOST_ITEMS = 20
HTML_RESULT = "array<struct<title string, url string, description string, thumbnail string>>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Selectors by provider: item, title, url, description, thumbnail, no results.
SELECTORS = {
    "duckduckgo-html": ("#links .web-result", "h2 a", "h2 a", "a.result__snippet", "", ".no-results, .result--no-result"),
    "brave-web": ('div.snippet[data-type="web"]', "div.search-snippet-title", "a.l1", "div.content", "a.thumbnail img", ".no-results, #no-results, .search-no-results"),
    "brave-news": ('.snippet[data-type="news"], .news-result', ".title, .snippet-title", "a", ".description, .content", "img", ".no-results"),
    "mojeek-web": ("ul.results-standard li", "h2 a", "a.ob", "p.s", "", ".no-results, .no-results-found, #no-results"),
    "yahoo-web": ("div.algo-sr", "h3", "div.compTitle a", "div.compText", "", ".no-results, #no-results, .NoResults"),
    "yandex-web": ("li.serp-item", "h2 a, h3 a", "h2 a, h3 a", "div.text-container, div.OrganicTextContentSpan, div.organic__text", "", ".serp-list_type_search-empty, .misspell__message, .EmptySearchResults"),
    "baidu-web": ("div.result, div.c-container", "h3 a", "h3 a", "div.c-abstract, div.content-right_8Zs40, span.content-right_8Zs40", "", "div.nors, div#content_none, .search-noresult"),
    "google-web": ("div.MjjYud, div.ezO2md", "h3", "a", "div.VwiC3b, div.FrIlee, span.aCOpRe", "", "#topstuff .card-section, .med .card-section"),
    "startpage-web": (".w-gl__result, .result", ".w-gl__result-title, .result-title", "a.w-gl__result-title, a.result-link", ".w-gl__description, .result-description", "", ".no-results"),
}


class Simple:
    """One compound selector: tag, ids, classes and attributes."""

    def __init__(self, text: str) -> None:
        self.tag = (re.match(r"^[A-Za-z][\w-]*", text) or [""])[0].lower()
        self.ids = re.findall(r"#([\w-]+)", text)
        self.classes = re.findall(r"\.([\w-]+)", re.sub(r"\[.*?\]", "", text))
        self.attributes = re.findall(r'\[([\w-]+)="([^"]*)"\]', text)

    def fits(self, element: tuple[str, dict]) -> bool:
        tag, attrs = element
        return (
            self.tag in ("", tag)
            and all(attrs.get("id") == i for i in self.ids)
            and set(self.classes) <= set((attrs.get("class") or "").split())
            and all(attrs.get(k) == v for k, v in self.attributes)
        )


def selector(text: str) -> list[list[Simple]]:
    return [[Simple(s) for s in alternative.split()] for alternative in text.split(",") if alternative.strip()]


def fits(alternatives: list[list[Simple]], path: list[tuple[str, dict]]) -> bool:
    """Whether the last element of the path fits, its ancestors in order."""
    for steps in alternatives:
        if not steps[-1].fits(path[-1]):
            continue
        left = list(steps[:-1])
        for element in reversed(path[:-1]):
            if left and left[-1].fits(element):
                left.pop()
        if not left:
            return True
    return False


class ItemParser(HTMLParser):
    """Collects items of a result page. Only the innermost open item gathers text; when
    it closes, none is open. Items past the cap are not opened, empty ones count."""

    def __init__(self, spec: tuple[str, ...], most: int) -> None:
        super().__init__(convert_charrefs=False)
        self.item, *self.parts, self.nothing = map(selector, spec)
        # A part is looked for below an item; only its first alternative is tied to it.
        self.parts = [[[*i, *p[0]] for i in self.item for p in [part]] + part[1:] if part else [] for part in self.parts]
        self.most, self.path, self.items, self.open, self.empty = most, [], [], None, False

    def handle_starttag(self, tag, attrs):
        attributes = {}
        for k, v in attrs:
            attributes.setdefault(k, v or "")
        self.path.append((tag, attributes))
        if self.nothing and fits(self.nothing, self.path):
            self.empty = True
        if fits(self.item, self.path) and len(self.items) < self.most:
            self.open = (len(self.path), {"title": [], "url": "", "description": [], "thumbnail": ""})
            self.items.append(self.open[1])
        elif self.open:
            if not self.open[1]["url"] and fits(self.parts[1], self.path):
                self.open[1]["url"] = attributes.get("href") or attributes.get("data-href") or ""
            if self.parts[3] and not self.open[1]["thumbnail"] and fits(self.parts[3], self.path):
                self.open[1]["thumbnail"] = attributes.get("src") or attributes.get("data-src") or ""
        if tag in VOID:
            self.path.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.path), 0, -1):
            if self.path[depth - 1][0] == tag:
                del self.path[depth - 1 :]
                break
        if self.open and len(self.path) < self.open[0]:
            self.open = None

    def handle_data(self, data):
        if self.open and self.path:
            for name, part in (("title", self.parts[0]), ("description", self.parts[2])):
                if any(fits(part, self.path[:n]) for n in range(len(self.path), self.open[0] - 1, -1)):
                    self.open[1][name].append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def html_results(body: str, base: str, spec: tuple[str, ...], most: int = MOST_ITEMS) -> list[dict] | None:
    """Results of a page; None if it has neither results nor says that there are none,
    or one of its URLs cannot be resolved. Entities stay as they are written."""
    parser = ItemParser(spec, most)
    parser.feed(body)
    parser.close()
    found = []
    for item in parser.items:
        title, text = (" ".join("".join(item[k]).split()) for k in ("title", "description"))
        if not title or not item["url"].strip():
            continue
        try:
            url, image = urljoin(base, item["url"].strip()), item["thumbnail"] and urljoin(base, item["thumbnail"])
        except ValueError:
            return None
        found.append({"title": title, "url": url, "description": text, "thumbnail": image or None})
    return found if found or parser.empty else None


def embedded_json(text: str, marker: str, most: int = 1 << 20, depth: int = 64):
    """The JSON value that follows a marker in a page, by balancing its brackets outside
    strings; raises ValueError if it is absent, too large, too deep or broken."""
    at = text.find(marker)
    start = at + len(marker) if at >= 0 else len(text)
    while start < len(text) and text[start].isspace():
        start += 1
    if at < 0 or start >= len(text) or text[start] not in "{[":
        raise ValueError("not found")
    level = 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}\[\]]', text[start : start + most], re.DOTALL):
        level += 1 if m[0] in "{[" else -1 if m[0] in "}]" else 0
        if level > depth:
            raise ValueError("too deep")
        if not level and m[0] in "}]":
            return json.loads(text[start : start + m.end()])
    raise ValueError("too large or cut off")


def event_json(body: Column) -> Column:
    """A body as JSON text: itself, or the first data line of an event stream."""
    line = F.regexp_extract(body, r"(?m)^data:[ \t]*(\S.*)$", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body).when(line != "", line)


def block_results(body: Column) -> Column:
    """Title, URL, date and text of plain-text blocks; blocks without a URL are dropped."""
    blocks = F.split(body, "\n\n---\n\n")
    field = lambda b, k: T.trimmed(F.regexp_extract(b, rf"(?m)^{k}:[ \t]*(.*)$", 1))
    rows = F.transform(
        blocks,
        lambda b: F.struct(
            field(b, "Title").alias("title"), field(b, "URL").alias("url"), F.nullif(F.nullif(field(b, "Published"), F.lit("N/A")), F.lit("")).alias("published_at"),
            T.trimmed(F.regexp_extract(b, r"(?s)Highlights:(.*)$", 1)).alias("content"),
        ),
    )
    return F.filter(rows, lambda r: r["url"].rlike("^https?://[^/ ]+"))


#: Hidden tokens of pages by name: how they are marked, and the longest that is taken.
TOKENS = {
    "vqd": (r"""(?:name="vqd" value="|vqd=")\s*([A-Za-z0-9_-]{1,256})\s*"|vqd='\s*([A-Za-z0-9_-]{1,256})\s*'""", 256),
    "sc": (r"""<input(?=[^>]*name=["']sc["'])[^>]*value=(?:"([^"]+)"|'([^']+)')""", 512),
    "s2-ui-version": (r"""<meta(?=[^>]*s2-ui-version)[^>]*content=(?:"\s*([^"]+?)\s*"|'\s*([^']+?)\s*')""", 128),
}


def page_token(body: Column, name: str) -> Column:
    """A hidden token of a page; null if it is not there, empty or too long."""
    pattern, most = TOKENS[name]
    found = F.concat(F.regexp_extract(body, pattern, 1), F.regexp_extract(body, pattern, 2))
    return F.when(F.octet_length(found).between(1, most), found)


PROPS_MARKER = "React.createElement(UIStartpage.AppSerpWeb, "
PAGE = f"struct<results: {HTML_RESULT}, props: string, failure: string>"
PAGE_TYPE = pa.struct([("results", pa.list_(pa.struct([(k, pa.string()) for k in ("title", "url", "description", "thumbnail")]))), ("props", pa.string()), ("failure", pa.string())])


def read_page(body: str | None, base: str | None, engine: str) -> dict:
    """Results of a page by its engine's selectors, or the data embedded in it as JSON text."""
    body = body or ""
    if engine == "startpage-web" and PROPS_MARKER in body:
        try:
            return {"props": json.dumps(embedded_json(body, PROPS_MARKER, len(body), len(body)))}
        except ValueError:
            return {"failure": "ENGINE_PARSE_FAILED"}
    found = html_results(body, base or "", SELECTORS[engine])
    return {"failure": "ENGINE_PARSE_FAILED"} if found is None else {"results": found}


def page_results(body: Column, base: Column, engine: Column) -> Column:
    """``read_page`` as a column. Of a batch only one page at a time is held as Python's objects."""

    def run(bodies: pa.Array, bases: pa.Array, engines: pa.Array) -> pa.Array:
        rows = (read_page(b.as_py(), base.as_py(), e.as_py()) if b.is_valid else {} for b, base, e in zip(bodies, bases, engines))
        return pa.concat_arrays([pa.array([], PAGE_TYPE), *(pa.array([r], PAGE_TYPE) for r in rows)])

    run.__annotations__ = {"bodies": pa.Array, "bases": pa.Array, "engines": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, PAGE)(body, base, engine)
