"""Readers of the 19 providers on hand-written bodies of every response class."""

import json

import pytest
from pyspark.sql import functions as F

from beaconq.sources import engines as E, responses as R
from beaconq.sources.markup import SELECTORS, embedded_json, html_results, page_token


def html(item, nothing):
    """Two items and one without a link."""
    return f"<html><body><div id='links'>{item('https://a.org/1', 'One <b>two</b>', 'first  text')}{item('https://b.org/2', 'Second', 'more &amp; more')}{item('', 'None', 'x')}</div></body></html>", f"<html><body>{nothing}</body></html>"


PAGES = {
    "duckduckgo-html": html(lambda u, t, d: f"<div class='web-result'><h2><a href='{u}'>{t}</a></h2><a class='result__snippet'>{d}</a></div>", "<div class='no-results'></div>"),
    "brave-web": html(lambda u, t, d: f"<div class='snippet' data-type='web'><a class='l1' href='{u}'><div class='search-snippet-title'>{t}</div></a><div class='content'>{d}</div></div>", "<div id='no-results'></div>"),
    "brave-news": html(lambda u, t, d: f"<div class='news-result'><a href='{u}'><span class='title'>{t}</span></a><img src='/i.png'><p class='description'>{d}</p></div>", "<p class='no-results'>"),
    "mojeek-web": html(lambda u, t, d: f"<ul class='results-standard'><li><h2><a class='ob' href='{u}'>{t}</a></h2><p class='s'>{d}</p></li></ul>", "<p id='no-results'>"),
    "yahoo-web": html(lambda u, t, d: f"<div class='algo-sr'><div class='compTitle'><a href='{u}'><h3>{t}</h3></a></div><div class='compText'>{d}</div></div>", "<p class='NoResults'>"),
    "yandex-web": html(lambda u, t, d: f"<li class='serp-item'><h2><a href='{u}'>{t}</a></h2><div class='organic__text'>{d}</div></li>", "<p class='EmptySearchResults'>"),
    "baidu-web": html(lambda u, t, d: f"<div class='result c-container'><h3><a href='{u}'>{t}</a></h3><div class='c-abstract'>{d}</div></div>", "<div class='nors'></div>"),
    "google-web": html(lambda u, t, d: f"<div class='MjjYud'><a href='{u}'><h3>{t}</h3></a><div class='VwiC3b'>{d}</div></div>", "<div id='topstuff'><p class='card-section'></div>"),
    "startpage-web": html(lambda u, t, d: f"<div class='result'><a class='result-title result-link' href='{u}'>{t}</a><p class='result-description'>{d}</p></div>", "<p class='no-results'>"),
}
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>t</title>
<entry><id>http://arxiv.org/abs/1</id><title>Deep\n  learning</title><summary> About
 it </summary><published>2020-01-02T00:00:00Z</published><author><name>A B</name></author><link href="http://arxiv.org/pdf/1" title="pdf"/><author><name>C D</name></author>
<category term="cs.LG"/><arxiv:doi>10.1/x</arxiv:doi></entry>
<entry><summary>s</summary><title>Two</title><updated>2021-05-05</updated><id>http://arxiv.org/abs/2</id></entry></feed>"""
SCHOLAR = {"data": [{"title": {"text": " One "}, "paperId": "p1", "year": 2019, "authors": [[{"name": "X"}], {"name": "Y"}], "venue": None}, {"title": "Two", "url": "https://s.org/2", "abstract": "abs", "pubDate": "2020-01-01"}]}
CROSSREF = {"status": "ok", "message": {"items": [
    {"title": ["One"], "DOI": "10.1/a", "abstract": "<jats:p>Tides &amp; <i>currents</i> of a bay</jats:p>", "issued": {"date-parts": [[2020, 3]]}, "author": [{"given": "A", "family": "B"}], "is-referenced-by-count": 4},
    {"title": ["Two"], "URL": "https://c.org/2", "container-title": ["Journal"], "published": {"date-parts": [[2021, 13, 2]]}}, {"title": []},
]}}
SUMMARY = {"result": {"uids": ["22", "11", "33"], "11": {"title": "Eleven", "source": "J", "sortpubdate": "2020/01/02 00:00", "articleids": [{"idtype": "doi", "value": "10.1/e"}]}, "22": {"title": "<i>Two</i> two", "fulljournalname": "Full", "pubdate": "2019"}}}
EXA = {"result": {"content": [{"type": "text", "text": "Title: One\nURL: https://e.org/1\nPublished: N/A\nHighlights:\nline\nline2\n\n---\n\nTitle: \nURL: https://e.org/2\nPublished: 2020-01-01\n\n---\n\nTitle: x\nURL: nothing"}]}}
PROPS = {"render": {"presenter": {"regions": {"mainline": [{"display_type": "web-google", "results": [{"clickUrl": "https://p.org/1", "title": "<b>One</b>", "description": "d } {"}, {"title": "no link"}]}, {"display_type": "images", "results": [{"clickUrl": "https://p.org/9", "title": "x"}]}]}}}}
GOOD = {
    "arxiv": (ATOM, [("http://arxiv.org/abs/1", "Deep learning", "About it", "2020-01-02T00:00:00Z"), ("http://arxiv.org/abs/2", "Two", "s", "2021-05-05")]),
    "crossref": (CROSSREF, [("https://doi.org/10.1/a", "One", "Tides & currents of a bay", "2020-03"), ("https://c.org/2", "Two", "Journal", "2021")]),
    "github": ({"items": [{"full_name": "a/b", "html_url": "https://github.com/a/b", "language": "Rust", "description": " d ", "created_at": "2020", "license": {"spdx_id": "NOASSERTION"}}, {"full_name": "x"}]}, [("https://github.com/a/b", "a/b", "Rust / d", "2020")]),
    "openalex": ({"results": [{"id": "https://openalex.org/W1", "title": "One", "authorships": [{"author": {"display_name": "A"}}, {"author": {"display_name": "B"}}], "primary_location": {"source": {"display_name": "V"}}}]}, [("https://openalex.org/W1", "One", "V — A, B", None)]),
    "grokipedia": ([{"name": "One", "slug": "a b", "description": "d"}, {"title": "Two", "url": "https://g.org/2", "updated_at": "2020"}], [("https://grokipedia.com/page/a%20b", "One", "d", None), ("https://g.org/2", "Two", "", "2020")]),
    "qwant-web": ({"status": "success", "data": {"result": {"items": {"mainline": [{"type": "ads", "items": [{"title": "ad", "url": "https://ad.org/"}]}, {"type": "web", "items": [{"title": "One", "url": "https://q.org/1", "desc": "d"}]}, {"items": [{"title": "Two", "url": "ftp://q"}, {"title": "Three", "url": "https://q.org/3"}]}]}}}}, [("https://q.org/1", "One", "d", None), ("https://q.org/3", "Three", "", None)]),
    "semantic-scholar": (SCHOLAR, [("https://www.semanticscholar.org/paper/p1", "One", "", "2019"), ("https://s.org/2", "Two", "abs", "2020-01-01")]),
    "wikipedia": ({"query": {"pages": [{"title": "One", "fullurl": "https://en.wikipedia.org/wiki/One", "extract": "a  b", "pageid": 7}]}}, [("https://en.wikipedia.org/wiki/One", "One", "a b", None)]),
    "pubmed": (SUMMARY, [("https://pubmed.ncbi.nlm.nih.gov/22/", "Two two", "Full", "2019"), ("https://pubmed.ncbi.nlm.nih.gov/11/", "Eleven", "J", "2020-01-02")]),
    "exa-mcp": ("event: message\ndata: \ndata: " + json.dumps(EXA) + "\n", [("https://e.org/1", "One", "line\nline2", None), ("https://e.org/2", "https://e.org/2", "", "2020-01-01")]),
} | {engine: (page, [("https://a.org/1", "One two", "first text", None), ("https://b.org/2", "Second", "more &amp; more", None)]) for engine, (page, _) in PAGES.items()}
EMPTY = {
    "arxiv": '<feed xmlns="http://www.w3.org/2005/Atom"><title>none</title></feed>', "crossref": {"status": "ok", "message": {"items": []}}, "github": {"items": []}, "openalex": {"results": []},
    "grokipedia": {"data": {"results": []}}, "qwant-web": {"status": "success", "data": {"result": {"items": []}}}, "semantic-scholar": {"results": []}, "wikipedia": {"batchcomplete": True},
    "pubmed": {"result": {"uids": []}}, "exa-mcp": {"result": {"content": [{"text": "{\"results\": []}"}]}},
} | {engine: nothing for engine, (_, nothing) in PAGES.items()}
ERRORS = [
    ("github", {"message": "API rate limit exceeded"}, "ENGINE_RATE_LIMITED"), ("github", {"message": "abuse detection"}, "ENGINE_CHALLENGED"), ("github", {"message": "Bad"}, "ENGINE_PARSE_FAILED"),
    ("qwant-web", {"status": "error", "data": {"error_code": 24}}, "ENGINE_RATE_LIMITED"), ("qwant-web", {"status": "error", "url": "https://x.org/verify"}, "ENGINE_CHALLENGED"), ("qwant-web", {"data": {}}, "ENGINE_PARSE_FAILED"),
    ("crossref", {"status": "failed", "message": "Rate for this limit"}, "ENGINE_RATE_LIMITED"), ("crossref", {"status": "ok", "message": {}}, "ENGINE_PARSE_FAILED"),
    ("pubmed", {"error": "API rate high"}, "ENGINE_RATE_LIMITED"), ("pubmed", {"result": {}}, "ENGINE_PARSE_FAILED"),
    ("semantic-scholar", {"message": "Too Many"}, "ENGINE_RATE_LIMITED"), ("semantic-scholar", {"error": "Unauthorized"}, "ENGINE_ACCESS_DENIED"),
    ("wikipedia", {"error": {"code": "maxlag", "info": "x"}}, "ENGINE_RATE_LIMITED"), ("wikipedia", {"error": {"code": "other"}}, "ENGINE_PARSE_FAILED"), ("wikipedia", {"content_urls": {}, "title": "x"}, "ENGINE_PARSE_FAILED"),
    ("grokipedia", {"message": "Rate limit hit"}, "ENGINE_RATE_LIMITED"), ("exa-mcp", {"error": {"code": 1}}, "ENGINE_PARSE_FAILED"), ("openalex", {"meta": {}}, "ENGINE_PARSE_FAILED"),
    ("arxiv", ATOM.replace("Deep\n  learning", "Error"), "INVALID_REQUEST"), ("arxiv", ATOM.replace("<summary>s</summary>", ""), "ENGINE_PARSE_FAILED"), ("arxiv", ATOM[:-40], "ENGINE_PARSE_FAILED"),
    ("startpage-web", "<script>React.createElement(UIStartpage.AppSerpWeb, {\"a\": {", "ENGINE_PARSE_FAILED"),
]
TYPES = {"json": "application/json; charset=utf-8", "html": "text/html", "atom": "application/atom+xml"}
KINDS = {e[0]: e[1] for e in E.ENGINES}


def text(body):
    return body if isinstance(body, str) else json.dumps(body)


def row(request, engine, body, status=200, headers=None, locations=None):
    headers = {"Content-Type": TYPES[KINDS[engine]]} if headers is None else headers
    return (request, engine, 1, status, headers, text(body), f"https://{engine}.test/search?q=x", locations, 10)


@pytest.fixture(scope="module")
def outcome(spark):
    """All responses are read in one job; their outcomes by request."""
    rows = [row(f"good:{e}", e, body) for e, (body, _) in GOOD.items()]
    rows += [row(f"empty:{e}", e, body) for e, body in EMPTY.items()]
    rows += [row(f"changed:{e}", e, "<html><body>other</body></html>" if KINDS[e] == "html" else "{}" if KINDS[e] == "json" and e != "wikipedia" else "{") for e in GOOD]
    rows += [row(f"error:{i}", e, body) for i, (e, body, _) in enumerate(ERRORS)]
    for e in GOOD:
        rows += [
            row(f"429:{e}", e, "{}", 429), row(f"403:{e}", e, "{}", 403), row(f"500:{e}", e, "{}", 500), row(f"limit:{e}", e, "Secondary RATE LIMIT"),
            row(f"challenge:{e}", e, "please solve the CAPTCHA"), row(f"waf:{e}", e, "{}", 200, {"CF-Mitigated": "Challenge"}), row(f"type:{e}", e, "{}", 200, {"content-type": "image/png"}),
            row(f"large:{e}", e, "x" * (2 * 1024 * 1024 + 1)), row(f"sorry:{e}", e, "{}", 200, None, ["https://x.org/sorry/index"]), row(f"hops:{e}", e, "{}", 200, None, ["/a", "/b", "/c"]),
        ]
    rows += [row("props", "startpage-web", "<html>" + "React.createElement(UIStartpage.AppSerpWeb, " + json.dumps(PROPS) + ")")]
    rows += [row("unknown", "crossref", GOOD["crossref"][0])[:1] + ("nobody",) + row("", "crossref", "")[2:]]
    frame = R.read(spark.createDataFrame(rows, R.RESPONSES))
    return {r["request_id"]: r for r in frame.collect()}


@pytest.mark.parametrize("engine", sorted(GOOD))
def test_normal_and_empty(outcome, engine):
    r = outcome[f"good:{engine}"]
    assert r["failure_kind"] is None and [(x["url"], x["title"], x["content"], x["published_at"]) for x in r["results"]] == GOOD[engine][1]
    r = outcome[f"empty:{engine}"]
    assert r["failure_kind"] is None and r["results"] == []


@pytest.mark.parametrize("engine", sorted(GOOD))
def test_failures_before_parsing(outcome, engine):
    kind = lambda name: outcome[f"{name}:{engine}"]["failure_kind"]
    assert kind("changed") == "ENGINE_PARSE_FAILED"
    assert kind("429") == kind("limit") == "ENGINE_RATE_LIMITED" and kind("403") == kind("500") == kind("hops") == "ENGINE_ACCESS_DENIED"
    assert kind("challenge") == kind("waf") == kind("sorry") == "ENGINE_CHALLENGED"
    assert kind("type") == "ENGINE_INVALID_CONTENT_TYPE" and kind("large") == "ENGINE_RESPONSE_TOO_LARGE"


@pytest.mark.parametrize("i", range(len(ERRORS)))
def test_reported_errors(outcome, i):
    assert outcome[f"error:{i}"]["failure_kind"] == ERRORS[i][2]


def test_embedded_props_and_unknown_engines(outcome):
    assert [(r["url"], r["title"], r["content"]) for r in outcome["props"]["results"]] == [("https://p.org/1", "One", "d } {")]
    assert outcome["unknown"]["failure_kind"] is not None


def test_metadata(outcome):
    meta = lambda e, i=0: json.loads(outcome[f"good:{e}"]["results"][i]["metadata"])
    assert meta("crossref") == {"authors": ["A B"], "citation_count": 4, "doi": "10.1/a"}
    assert meta("arxiv") == {"authors": ["A B", "C D"], "categories": ["cs.LG"], "doi": "10.1/x", "pdf_url": "http://arxiv.org/pdf/1"}
    assert meta("github") == {"language": "Rust"} and meta("wikipedia") == {"page_id": 7}
    assert meta("semantic-scholar") == {"authors": ["X", "Y"], "paperId": "p1", "year": 2019}
    assert meta("pubmed", 1) == {"authors": [], "doi": "10.1/e", "journal": "J", "pmid": "11", "publication_types": []}
    assert outcome["good:brave-news"]["results"][0]["thumbnail"] == "https://brave-news.test/i.png"


def test_redirects_own_hosts_and_caps(spark):
    item = "<div class='snippet' data-type='web'><a class='l1' href='{}'><div class='search-snippet-title'>t{}</div></a></div>"
    brave = "".join(item.format("https://search.brave.com/x" if i == 1 else f"https://a.org/{i}", i) for i in range(30))
    google = "<div class='MjjYud'><a href='/url?q=https%3A%2F%2Fg.org%2F1&sa=U'><h3>t</h3></a></div>"
    groups = [{"display_type": "web-google", "results": [{"clickUrl": f"https://p.org/{g}/{i}", "title": "t"} for i in range(n)]} for g, n in enumerate((15, 15, 7))]
    props = "React.createElement(UIStartpage.AppSerpWeb, " + json.dumps({"render": {"presenter": {"regions": {"mainline": groups}}}})
    rows = [row("b", "brave-web", brave), (*row("g", "google-web", google)[:6], "https://www.google.com/search", None, 1), row("p", "startpage-web", props)]
    got = {r["request_id"]: r["results"] for r in R.read(spark.createDataFrame(rows, R.RESPONSES)).collect()}
    assert [r["title"] for r in got["b"]] == [f"t{i}" for i in range(20) if i != 1]
    assert [r["url"] for r in got["g"]] == ["https://g.org/1"]
    assert len(got["p"]) == 15 + 5 + 7


def test_two_steps(spark):
    from beaconq.sources.providers import pubmed_ids

    bodies = [json.dumps({"esearchresult": {"idlist": [" 1", "", "2"]}}), json.dumps({"esearchresult": {"error": "rate"}}), "x"]
    found = [r[0] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(pubmed_ids(F.col("b"))).collect()]
    assert found == [["1", "2"], None, None]


def test_tokens(spark):
    pages = ['<input name="vqd" value="4-12_a">', "x vqd='9-9' y", '<input type="hidden" name="sc" value="tok en"><input value="q">', '<meta name="s2-ui-version" content="abc "/>', '<input name="sc" value="">' , '<input name="vqd" value="a b">']
    frame = spark.createDataFrame([(p,) for p in pages], "b string")
    got = [tuple(r) for r in frame.select(*[page_token(F.col("b"), n) for n in ("vqd", "sc", "s2-ui-version")]).collect()]
    assert got == [("4-12_a", None, None), ("9-9", None, None), (None, "tok en", None), (None, None, "abc"), (None, None, None), (None, None, None)]


def test_reports_and_results(spark):
    rows = [row("r", "crossref", CROSSREF), row("r", "pubmed", {"esearchresult": {}}, 429), row("r", "pubmed", SUMMARY)]
    read = R.read(spark.createDataFrame(rows, R.RESPONSES))
    got = R.results(read, E.engines(spark)).filter("engine_id = 'crossref'").orderBy("position").collect()
    assert [(r["position"], r["weight"], r["category"]) for r in got] == [(1, 1.3, "academic"), (2, 1.3, "academic")]
    reports = {r["engine_id"]: r for r in R.reports(read, spark.createDataFrame([("r", "crossref")], "request_id string, engine_id string")).collect()}
    assert reports["pubmed"]["failure_kind"] == "ENGINE_RATE_LIMITED" and reports["pubmed"]["upstream_requests"] == 2 and reports["pubmed"]["duration_ms"] == 20
    assert reports["crossref"]["failure_kind"] == "ENGINE_PARSE_FAILED" and reports["crossref"]["result_count"] == 0


def test_selector_corners():
    spec = ("div.i", "h3", "a", "p", "", ".none")
    page = lambda inner: html_results(f"<body>{inner}</body>", "https://x.org/a/b", spec)
    assert page("<div class=i><h3>A &amp; B</h3><a href='../c'>x</a><p>d  e</p></div>") == [{"title": "A &amp; B", "url": "https://x.org/c", "description": "d e", "thumbnail": None}]
    assert page("<div class=i><h3>A</h3><a data-href='/d'></a></div>")[0]["url"] == "https://x.org/d"
    assert page("<div class=i><h3>A</h3></div>") is None and page("<p class=none></p>") == [] and page("") is None
    assert page("<div class=i><h3>A</h3><a href='http://[bad'></a></div>") is None
    many = "".join(f"<div class=i><h3>{'' if i < 15 else i}</h3><a href='/{i}'></a></div>" for i in range(30))
    assert [r["title"] for r in page(many)] == ["15", "16", "17", "18", "19"]
    nested = "<div class=i><h3>A</h3><a href='/1'></a><div class=i><h3>B</h3><a href='/2'></a></div><p>lost</p></div>"
    assert [(r["title"], r["description"]) for r in page(nested)] == [("A", ""), ("B", "")]


def test_embedded_json():
    assert embedded_json('x = {"a": "}{", "b": [1]} ; y', "x = ") == {"a": "}{", "b": [1]}
    for bad, why in (("y", "not found"), ("x = 1", "not found"), ("x = " + "[" * 70, "too deep"), ("x = {", "too large")):
        with pytest.raises(ValueError, match=why):
            embedded_json(bad, "x = ")


def test_destinations_and_redirects(spark):
    urls = ["https://api.crossref.org/x", "https://API.crossref.org/", "http://api.crossref.org/", "https://u@api.crossref.org/", "https://evil.org/"]
    ok = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(R.allowed(F.col("u"), F.array(F.lit("api.crossref.org")))).collect()]
    assert ok == [True, True, False, False, False]
    rows = spark.createDataFrame([("POST", 302, {"Cookie": "c", "Accept": "a"}, "https://a.org/", "https://b.org/"), ("POST", 303, {"Cookie": "c"}, "https://a.org/", "https://A.org/x")], "m string, s int, h map<string,string>, a string, b string")
    got = [r[0] for r in rows.select(R.followed(*map(F.col, "mshab"))).collect()]
    assert [(g["method"], g["headers"]) for g in got] == [("POST", {"Accept": "a"}), ("GET", {"Cookie": "c"})]


def test_a_reader_can_be_registered(spark):
    from beaconq.sources.providers import READERS, Provider, get, listed, result

    R.register("own", Provider(listed("$.rows"), lambda v: result(get(v, "$.u"), get(v, "$.t"))).read)
    try:
        rows = [(*row("o", "crossref", {"rows": [{"u": "https://o.org/", "t": "T"}]})[:1], "own", *row("o", "crossref", {"rows": [{"u": "https://o.org/", "t": "T"}]})[2:])]
        got = R.read(spark.createDataFrame(rows, R.RESPONSES)).first()
        assert [r["title"] for r in got["results"] or []] == ["T"], got["failure_kind"]
    finally:
        del READERS["own"]


def test_every_engine_has_a_reader():
    from beaconq.sources.providers import READERS

    assert set(READERS) | set(SELECTORS) == {e[0] for e in E.ENGINES} == set(GOOD)
