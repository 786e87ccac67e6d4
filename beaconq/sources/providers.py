"""JSON and Atom providers: a stored body to its results, by expressions alone.

Each provider says where its list is, how an item becomes a result, and what its error
reports look like. A body becomes (failure, results): one of the two, so that a body
that cannot be read is a row and no exception.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from beaconq.functions import text as T
from beaconq.sources.markup import block_results, event_json

PARSE_FAILED, RATE_LIMITED, CHALLENGED, DENIED, INVALID = (
    "ENGINE_PARSE_FAILED", "ENGINE_RATE_LIMITED", "ENGINE_CHALLENGED", "ENGINE_ACCESS_DENIED", "INVALID_REQUEST",
)
RESULT = "struct<url: string, title: string, content: string, published_at: string, thumbnail: string, metadata: string>"
PARSED = f"struct<failure: string, results: array<{RESULT}>>"
ABSOLUTE, HTTP = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+", r"^https?://[^/?#\s]+"


def get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def filled(value: Column) -> Column:
    """Trimmed; null if that leaves nothing."""
    return F.nullif(T.trimmed(value), F.lit(""))


def first_filled(v: Column, *fields: str) -> Column:
    return F.coalesce(*[filled(get(v, f"$.{k}")) for k in fields])


def url_if(value: Column, kind: str = ABSOLUTE) -> Column:
    return F.when(value.rlike(kind), value)


def result(url, title, content=None, published_at=None, thumbnail=None, **metadata: Column) -> Column:
    """One result; metadata is JSON text of the fields that are not null, in order of their names."""
    none = F.lit(None).cast("string")
    named = [metadata[k].alias(k) for k in sorted(metadata)]
    return F.struct(
        url.alias("url"), title.alias("title"), F.coalesce(content if content is not None else none, F.lit("")).alias("content"),
        (none if published_at is None else published_at).alias("published_at"), (none if thumbnail is None else thumbnail).alias("thumbnail"),
        (F.to_json(F.struct(*named)) if named else F.lit("{}")).alias("metadata"),
    ).cast(RESULT)


def parsed(failure: Column, results: Column, most: int | None = None) -> Column:
    """(failure, results): a missing list is a failure, results without URL or title are dropped."""
    kept = F.filter(results, lambda r: r["url"].isNotNull() & (F.coalesce(r["title"], F.lit("")) != ""))
    kept = F.slice(kept, 1, most) if most else kept
    why = F.coalesce(failure, F.when(results.isNull(), PARSE_FAILED))
    return F.struct(why.alias("failure"), F.when(why.isNull(), kept).alias("results")).cast(PARSED)


def names(v: Column, path: str, name: Callable[[Column], Column]) -> Column:
    listed = F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(listed, lambda a: filled(name(a))), lambda n: n.isNotNull())


def date_of_parts(parts: Column) -> Column:
    """[y], [y, m] or [y, m, d] as a date text of 4, 7 or 10 characters; a month or day out of range ends it."""
    at = lambda i: F.try_element_at(parts, F.lit(i))
    month = at(2).between(1, 12)
    return (
        F.when(month & at(3).between(1, 31), F.format_string("%04d-%02d-%02d", at(1), at(2), at(3)))
        .when(month, F.format_string("%04d-%02d", at(1), at(2)))
        .when(at(1).isNotNull(), F.format_string("%04d", at(1)))
    )


def has(text: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(text), F.lit(w))
    return F.coalesce(found, F.lit(False))


@dataclass
class Provider:
    """``items``: root to its list (null: none). ``item``: an entry to a result.
    ``error``: root to the failure that it reports, or null. ``most``: results kept."""

    items: Callable[[Column], Column]
    item: Callable[[Column], Column]
    error: Callable[[Column], Column] = lambda root: F.lit(None).cast("string")
    most: int | None = None

    def read(self, body: Column) -> Column:
        def of(root: Column) -> Column:
            unread = F.when(root.isNull(), PARSE_FAILED)
            return parsed(F.coalesce(unread, self.error(root)), F.transform(self.items(root), self.item), self.most)

        # An array of one binds the parsed body.
        return F.element_at(F.transform(F.array(F.try_parse_json(body)), of), 1)


def listed(*paths: str) -> Callable[[Column], Column]:
    return lambda root: F.coalesce(*[get(root, p, "array<variant>") for p in paths])


# ---- Crossref ----
def crossref(v: Column) -> Column:
    date = F.coalesce(*[get(v, f"$['{k}']['date-parts'][0]", "array<int>") for k in ("published", "published-online", "published-print", "issued")])
    container = filled(get(v, "$['container-title'][0]"))
    person = lambda a: F.concat_ws(" ", get(a, "$.given"), get(a, "$.family"))
    link = F.coalesce(first_filled(v, "URL"), F.concat(F.lit("https://doi.org/"), first_filled(v, "DOI")))
    return result(
        url_if(link, HTTP), filled(get(v, "$.title[0]")), F.coalesce(F.nullif(T.strip_markup(get(v, "$.abstract")), F.lit("")), container), date_of_parts(date),
        authors=names(v, "$.author", person), doi=get(v, "$.DOI"), container_title=container, type=get(v, "$.type"), publisher=get(v, "$.publisher"),
        citation_count=get(v, "$['is-referenced-by-count']", "long"), subjects=get(v, "$.subject", "array<string>"),
    )


def crossref_error(root: Column) -> Column:
    said = get(root, "$.message")
    limited = has(said, "rate") & has(said, "limit")
    return F.when(~F.coalesce(get(root, "$.status") == "ok", F.lit(False)), F.when(limited, RATE_LIMITED).otherwise(PARSE_FAILED))


# ---- GitHub ----
def github(v: Column) -> Column:
    language, licence = first_filled(v, "language"), get(v, "$.license.spdx_id")
    count = lambda k: get(v, f"$.{k}", "long")
    return result(
        url_if(first_filled(v, "html_url")), first_filled(v, "full_name"), F.concat_ws(" / ", language, first_filled(v, "description")),
        first_filled(v, "updated_at", "created_at"), get(v, "$.owner.avatar_url"),
        repository_id=count("id"), stars=count("stargazers_count"), forks=count("forks_count"), open_issues=count("open_issues_count"),
        language=language, owner=get(v, "$.owner.login"), topics=get(v, "$.topics", "array<string>"),
        license_spdx=F.when(licence != "NOASSERTION", licence), homepage=first_filled(v, "homepage"), clone_url=first_filled(v, "clone_url"), default_branch=first_filled(v, "default_branch"),
    )


def github_error(root: Column) -> Column:
    said = get(root, "$.message")
    kind = F.when(has(said, "rate limit", "secondary rate"), RATE_LIMITED).when(has(said, "abuse", "temporarily blocked"), CHALLENGED)
    return F.when(said.isNotNull(), kind.otherwise(PARSE_FAILED))


# ---- OpenAlex ----
def openalex(v: Column) -> Column:
    authors = F.slice(F.filter(F.transform(F.coalesce(get(v, "$.authorships", "array<variant>"), F.array().cast("array<variant>")), lambda a: get(a, "$.author.display_name")), lambda n: n.isNotNull()), 1, 20)
    venue = F.nullif(get(v, "$.primary_location.source.display_name"), F.lit(""))
    return result(
        url_if(F.coalesce(get(v, "$.doi"), get(v, "$.id"))), first_filled(v, "title"), F.concat_ws(" — ", venue, F.nullif(F.array_join(authors, ", "), F.lit(""))), get(v, "$.publication_date"),
        cited_by_count=get(v, "$.cited_by_count", "long"), is_open_access=F.coalesce(get(v, "$.open_access.is_oa", "boolean"), F.lit(False)),
    )


# ---- Grokipedia ----
def grokipedia(v: Column) -> Column:
    slug = first_filled(v, "slug")
    paged = F.concat(F.lit("https://grokipedia.com/page/"), F.replace(F.url_encode(slug), F.lit("+"), F.lit("%20")))
    return result(
        F.coalesce(url_if(first_filled(v, "url", "page_url")), paged), first_filled(v, "title", "name"), first_filled(v, "snippet", "description", "content"),
        first_filled(v, "updated_at", "published_at"), first_filled(v, "thumbnail", "image_url"), id=get(v, "$.id"), slug=get(v, "$.slug"),
    )


def grokipedia_error(root: Column) -> Column:
    said = get(root, "$.message")
    return F.when(said.isNotNull(), F.when(has(said, "rate limit"), RATE_LIMITED).otherwise(PARSE_FAILED))


# ---- Qwant ----
def qwant_items(root: Column) -> Column:
    direct = get(root, "$.data.result.items", "array<variant>")
    rows = F.filter(get(root, "$.data.result.items.mainline", "array<variant>"), lambda r: F.coalesce(get(r, "$.type"), F.lit("web")) == "web")
    empty = F.array().cast("array<variant>")
    return F.coalesce(direct, F.flatten(F.transform(rows, lambda r: F.coalesce(get(r, "$.items", "array<variant>"), empty))))


def qwant(v: Column) -> Column:
    return result(url_if(first_filled(v, "url"), HTTP), first_filled(v, "title"), get(v, "$.desc"), source=get(v, "$.source"))


def qwant_error(root: Column) -> Column:
    kind = F.when(get(root, "$.data.error_code", "long") == 24, RATE_LIMITED).when(get(root, "$.url").isNotNull(), CHALLENGED)
    return F.when(~F.coalesce(get(root, "$.status") == "success", F.lit(False)), kind.otherwise(PARSE_FAILED))


# ---- Semantic Scholar ----
SCHOLAR_FIELDS = "paperId venue externalIds citationCount influentialCitationCount isOpenAccess openAccessPdf fieldsOfStudy publicationTypes journal".split()


def semantic_scholar(v: Column) -> Column:
    title = F.when(F.schema_of_variant(get(v, "$.title", "variant")) == "STRING", get(v, "$.title")).otherwise(get(v, "$.title.text"))
    person = lambda a: F.coalesce(get(a, "$.name"), get(a, "$[0].name"))
    link = F.coalesce(filled(F.coalesce(get(v, "$.primaryPaperLink.url"), get(v, "$.url"), get(v, "$.links[0]"))), F.concat(F.lit("https://www.semanticscholar.org/paper/"), first_filled(v, "paperId", "id")))
    some = lambda k: F.when(~F.is_variant_null(get(v, f"$.{k}", "variant")), get(v, f"$.{k}", "variant"))
    return result(
        url_if(link, HTTP), filled(title), T.trimmed(F.coalesce(get(v, "$.abstract"), get(v, "$.paperAbstract.text"))),
        F.coalesce(get(v, "$.publicationDate"), get(v, "$.pubDate"), get(v, "$.year")),
        authors=names(v, "$.authors", person), year=get(v, "$.year", "long"), **{k: some(k) for k in SCHOLAR_FIELDS},
    )


def scholar_error(root: Column) -> Column:
    bad = get(root, "$.error", "variant").isNotNull() | (
        get(root, "$.message", "variant").isNotNull() & get(root, "$.data", "variant").isNull() & get(root, "$.results", "variant").isNull()
    )
    said = F.coalesce(get(root, "$.error"), get(root, "$.message"))
    return F.when(bad, F.when(has(said, "rate", "too many"), RATE_LIMITED).when(has(said, "api key", "unauthorized"), DENIED).otherwise(PARSE_FAILED))


# ---- Wikipedia ----
def wikipedia_items(root: Column) -> Column:
    """A summary is a list of one; an answer without a query is an empty list."""
    none = F.array().cast("array<variant>")
    pages = F.when(get(root, "$.query", "variant").isNull(), none).otherwise(get(root, "$.query.pages", "array<variant>"))
    return F.when(get(root, "$.content_urls", "variant").isNotNull(), F.array(root)).otherwise(pages)


def wikipedia(v: Column) -> Column:
    is_summary = get(v, "$.content_urls", "variant").isNotNull()
    title = F.coalesce(get(v, "$.titles.display"), get(v, "$.displaytitle"), get(v, "$.title"))
    page = F.coalesce(get(v, "$.content_urls.desktop.page"), filled(get(v, "$.fullurl")))
    return result(
        url_if(page), F.when(is_summary, T.strip_markup(title)).otherwise(filled(get(v, "$.title"))), T.collapse(F.coalesce(get(v, "$.extract"), F.when(is_summary, get(v, "$.description")))),
        F.when(is_summary, get(v, "$.timestamp")), get(v, "$.thumbnail.source"), page_id=F.when(~is_summary, get(v, "$.pageid", "long")),
    )


def wikipedia_error(root: Column) -> Column:
    code = F.lower(get(root, "$.error.code"))
    summary = wikipedia(root)
    unread = get(root, "$.content_urls", "variant").isNotNull() & (summary["url"].isNull() | (F.coalesce(summary["title"], F.lit("")) == ""))
    limited = F.when(code.isin("maxlag", "ratelimited"), RATE_LIMITED).otherwise(PARSE_FAILED)
    return F.when(get(root, "$.error", "variant").isNotNull(), limited).when(unread, PARSE_FAILED)


# ---- PubMed: the second of its two steps; ``pubmed_ids`` reads the first ----
def pubmed_items(root: Column) -> Column:
    """Entries in the order of ``uids``; those without one are left out."""
    ids, held = get(root, "$.result.uids", "array<string>"), get(root, "$.result", "map<string,variant>")
    return F.transform(F.filter(ids, lambda i: F.map_contains_key(held, i)), lambda i: F.struct(i.alias("uid"), F.element_at(held, i).alias("v")))


def pubmed(entry: Column) -> Column:
    uid, v = entry["uid"], entry["v"]
    listed_ids = F.coalesce(get(v, "$.articleids", "array<variant>"), F.array().cast("array<variant>"))
    of_type = lambda kind: filled(get(F.get(F.filter(listed_ids, lambda a: get(a, "$.idtype") == kind), F.lit(0)), "$.value"))
    date = T.trimmed(get(v, "$.sortpubdate"))
    journal = filled(F.coalesce(get(v, "$.fulljournalname"), get(v, "$.source")))
    return result(
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), uid, F.lit("/")), T.strip_markup(get(v, "$.title")), journal,
        F.coalesce(F.when(F.char_length(date) >= 10, F.replace(F.substring(date, 1, 10), F.lit("/"), F.lit("-"))), filled(get(v, "$.pubdate"))),
        pmid=uid, authors=names(v, "$.authors", lambda a: get(a, "$.name")), publication_types=F.coalesce(get(v, "$.pubtype", "array<string>"), F.array().cast("array<string>")),
        doi=of_type("doi"), pmcid=of_type("pmc"), journal=journal,
    )


def pubmed_error(root: Column) -> Column:
    said = F.coalesce(get(root, "$.error"), get(root, "$.esearchresult.error"))
    bad = get(root, "$.error", "variant").isNotNull() | get(root, "$.esearchresult.error", "variant").isNotNull()
    return F.when(bad, F.when(has(said, "rate", "too many"), RATE_LIMITED).otherwise(PARSE_FAILED))


def pubmed_ids(body: Column) -> Column:
    """Ids that a search (the first step) found; null if it failed, in which case ``pubmed_error`` says how."""
    root = F.try_parse_json(body)
    ids = get(root, "$.esearchresult.idlist", "array<string>")
    return F.when(pubmed_error(root).isNull(), F.filter(F.transform(ids, T.trimmed), lambda i: i != ""))


# ---- Exa: JSON-RPC or an event stream, holding JSON or plain text blocks ----
def exa(v: Column) -> Column:
    link = url_if(get(v, "$.url"))
    return result(link, F.coalesce(get(v, "$.title"), link), F.coalesce(get(v, "$.text"), get(v, "$.summary")), get(v, "$.publishedDate"), get(v, "$.image"))


def read_exa(body: Column) -> Column:
    def of(root: Column) -> Column:
        content = get(root, "$.result.content", "array<variant>")
        texts = F.filter(F.transform(content, lambda c: get(c, "$.text")), lambda t: t.isNotNull())
        whole = F.get(F.filter(F.transform(texts, F.try_parse_json), lambda v: v.isNotNull()), F.lit(0))
        blocks = F.transform(
            block_results(F.array_join(texts, "\n\n---\n\n")), lambda b: result(b["url"], F.coalesce(F.nullif(b["title"], F.lit("")), b["url"]), b["content"], b["published_at"])
        )
        items = F.coalesce(get(whole, "$.results", "array<variant>"), get(whole, "$", "array<variant>"))
        results = F.when(whole.isNotNull(), F.transform(items, exa)).otherwise(blocks)
        bad = root.isNull() | get(root, "$.error", "variant").isNotNull() | content.isNull()
        return parsed(F.when(bad, PARSE_FAILED), results)

    return F.element_at(F.transform(F.array(F.try_parse_json(event_json(body))), of), 1)


# ---- arXiv: an Atom feed ----
FEED = (
    "entry array<struct<id: string, title: string, summary: string, published: string, updated: string, author: array<struct<name: string>>,"
    " link: array<struct<_href: string, _title: string, _type: string>>, category: array<struct<_term: string>>, doi: string, journal_ref: string, comment: string>>"
)


def atom_entry(e: Column) -> Column:
    pdf = F.filter(e["link"], lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf"))
    return result(
        e["id"], T.collapse(e["title"]), T.collapse(e["summary"]), F.coalesce(e["published"], e["updated"]),
        authors=F.transform(F.coalesce(e["author"], F.array().cast("array<struct<name: string>>")), lambda a: T.collapse(a["name"])), pdf_url=F.get(pdf, F.lit(0))["_href"], doi=T.collapse(e["doi"]),
        journal_reference=T.collapse(e["journal_ref"]), categories=F.transform(F.coalesce(e["category"], F.array().cast("array<struct<_term: string>>")), lambda c: c["_term"]), comments=T.collapse(e["comment"]),
    )


def read_atom(body: Column) -> Column:
    """An entry without a required field, or the provider's error report, fails the feed."""
    plain = F.regexp_replace(F.regexp_replace(body, r"(</?)[A-Za-z]+:", "$1"), r'\sxmlns(:\w+)?="[^"]*"', "")
    is_feed = plain.rlike(r"(?s)^\s*(<\?xml.*?\?>)?\s*<feed\b.*</feed>\s*$")

    def of(feed: Column) -> Column:
        entries = F.when(is_feed, F.coalesce(feed["entry"], F.array().cast(FEED.split(" ", 1)[1])))
        lacking = F.exists(entries, lambda e: e["id"].isNull() | e["title"].isNull() | e["summary"].isNull() | F.coalesce(e["published"], e["updated"]).isNull())
        report = F.exists(entries, lambda e: (F.lower(T.trimmed(e["title"])) == "error") | F.contains(e["id"], F.lit("/api/errors#")))
        why = F.when(report, INVALID).when(lacking, PARSE_FAILED)
        return parsed(why, F.transform(entries, atom_entry))

    return F.element_at(F.transform(F.array(F.from_xml(plain, FEED)), of), 1)


#: Readers by engine: body column to (failure, results).
READERS: dict[str, Callable[[Column], Column]] = {
    "crossref": Provider(listed("$.message.items"), crossref, crossref_error).read,
    "github": Provider(listed("$.items"), github, github_error).read,
    "openalex": Provider(listed("$.results"), openalex).read,
    "grokipedia": Provider(listed("$", "$.results", "$.data.results"), grokipedia, grokipedia_error).read,
    "qwant-web": Provider(qwant_items, qwant, qwant_error, 20).read,
    "semantic-scholar": Provider(listed("$.data", "$.results"), semantic_scholar, scholar_error).read,
    "wikipedia": Provider(wikipedia_items, wikipedia, wikipedia_error).read,
    "pubmed": Provider(pubmed_items, pubmed, pubmed_error).read,
    "exa-mcp": read_exa,
    "arxiv": read_atom,
}
