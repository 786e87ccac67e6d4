"""Stored responses, answers, cursors, the index and percentiles, on small rows."""

import base64
import hashlib
import hmac
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconq.operators import cursors, merge, postings, respond, retrieve, telemetry
from beaconq.session import shared_path
from beaconq.sources import engines as E, responses as R, stored

BODY = json.dumps({"items": [{"full_name": f"r{k}", "html_url": f"https://g.org/{k}", "description": "d"} for k in range(3)]})


def response(request, engine, page=1, status=200, body=BODY):
    return request, engine, page, status, {"Content-Type": "application/json"}, body, "https://api.github.com/x", None, 5


@pytest.fixture(scope="module")
def table(spark):
    path = shared_path(spark, "stored-test")
    rows = [response("1", "github"), response("1", "github", 2), response("2", "openalex", 1, 429), response("3", "github", 1, 200, "{"), response("4", "grokipedia", 1, 200, '{"results": []}')]
    stored.write(spark.createDataFrame(rows, R.RESPONSES), path)
    return path


def plan(frame):
    return frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")


def test_engine_and_page_are_pushed(spark, table):
    rows = stored.load(spark, table, "engine_id IN ('github', 'openalex') AND page = 1 AND status = 200")
    assert sorted(r["request_id"] for r in rows.collect()) == ["1", "3"]
    assert "PushedFilters: [" in plan(rows) and "In(engine_id" in plan(rows) and "EqualTo(page,1)" in plan(rows)
    assert rows.rdd.getNumPartitions() < stored.load(spark, table).rdd.getNumPartitions()
    every = stored.load(spark, table)
    assert every.filter("engine_id = 'github'").count() == 3 and every.count() == 5
    assert stored.load(spark, table, "engine_id = 'nosuch'").count() == 0
    assert stored.load(spark, table, "status >= 400", ["request_id", "status"]).select("request_id", "status").collect() == [("2", 429)]


def test_unread_files_stay_unread(spark, table):
    reader = stored.Reader(table, ["request_id", "body"])
    assert list(reader.pushFilters([stored.EqualTo(("engine_id",), "github"), stored.In(("page",), (1, 2)), stored.EqualTo(("status",), 500)])) == [stored.EqualTo(("status",), 500)]
    parts = reader.partitions()
    assert {p.engine_id for p in parts} == {"github"} and {p.page for p in parts} == {1, 2}
    assert [b for p in parts for b in reader.read(p)] == []  # no row group has that status


def test_answers_and_problems(spark, table):
    read = R.read(stored.load(spark, table))
    asked = spark.createDataFrame([(str(k), f"q{k}") for k in range(1, 6)], "request_id string, query string")
    args = respond.answered(asked, read, E.engines(spark), "rrf-v1", 2)
    rows = {r["request_id"]: (r["status"], json.loads(r["body"])) for r in respond.bodies(*args).collect()}
    assert {k: s for k, (s, _) in rows.items()} == {"1": 200, "2": 502, "3": 502, "4": 200, "5": 502}
    body = rows["1"][1]
    assert body["result_count"] == 2 and body["may_have_more"] and not body["partial"] and [r["rank"] for r in body["results"]] == [1, 2]
    assert body["results"][0]["engines"] == ["github"] and body["results"][0]["positions"] == {"github": 1} and body["engines"][0]["engine_id"] == "github"
    assert rows["2"][1]["code"] == rows["5"][1]["code"] == "NO_ENGINE_SUCCEEDED" and rows["2"][1]["request_id"] == "2"
    assert rows["4"][1]["results"] == [] and not rows["4"][1]["may_have_more"]
    older = {r["request_id"]: (r["status"], json.loads(r["body"])) for r in respond.compat_bodies(*args).collect()}
    assert older["1"][1]["number_of_results"] == 2 and "unresponsive_engines" not in older["1"][1] and older["2"][0] == 502


def test_ranking_errors_fail_the_answer(spark):
    rows = spark.createDataFrame([("1", "github", 1, "https://a.org/")], "request_id string, engine_id string, position int, url string")
    bad = merge.dedup(merge.normalized(rows.withColumns({"ordinal": F.lit(1), "weight": F.lit(float("nan")), "title": F.lit("t"), "content": F.lit(""), "published_at": F.lit(None).cast("string")})))
    from beaconq.operators import rank

    assert [r["code"] for r in rank.ranking_errors(bad).collect()] == ["INTERNAL_ERROR"] and rank.scored(bad, "rrf-v1").count() == 0


@pytest.mark.parametrize("key", [b"", b"short", b"k" * 64, b"long" * 40])
def test_hmac_equals_the_library(spark, key):
    texts = ["", "a", "é" * 200]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", F.lower(F.hex(cursors.hmac_sha256(F.col("t"), key))).alias("h")).collect():
        assert r["h"] == hmac.new(key, r["t"].encode(), hashlib.sha256).hexdigest()


def test_cursors_are_refused_for_a_reason(spark):
    key, now = b"key", 1000
    made = spark.range(1).select(cursors.sign(F.lit("q"), F.lit(3).cast("long"), F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")), F.lit(now), key).alias("c")).first()["c"]
    payload = base64.urlsafe_b64decode(made.split(".")[0] + "==")
    assert json.loads(payload) == {"query_hash": "q", "page": 3, "engine_cursors": {"a": "2", "b": "1"}, "expires_at_ms": now + cursors.CURSOR_MS}
    forged = base64.urlsafe_b64encode(payload.replace(b'"page":3', b'"page":4')).decode().rstrip("=") + "." + made.split(".")[1]
    cases = [(made, "q", now, None), (made, "other", now, "cursor does not belong"), (made, "q", now + cursors.CURSOR_MS, "expired"), (forged, "q", now, "invalid signature"), ("x", "q", now, "invalid encoding"), (made + "=", "q", now, "invalid encoding"), (made.replace(".", ""), "q", now, "invalid encoding")]
    frame = spark.createDataFrame([(c, h, n) for c, h, n, _ in cases], "c string, h string, n long")
    got = frame.select(cursors.opened(F.col("c"), F.col("h"), F.col("n"), key).alias("o")).collect()
    for r, (*_, why) in zip(got, cases):
        assert (r["o"]["failure"] or "").startswith(why or "") and (r["o"]["payload"] is None) == (why is not None)
    other = frame.limit(1).select(cursors.opened(F.col("c"), F.col("h"), F.col("n"), b"another")["failure"].alias("f")).first()["f"]
    assert other == "invalid signature"


def test_seek_goes_on_after_a_place(spark):
    rows = spark.createDataFrame([("1", float(s), u) for s, u in [(3, "a"), (2, "b"), (2, "c"), (1, "d")]], "request_id string, score double, canonical_url string")
    page = lambda s, u: [r["canonical_url"] for r in cursors.seek(rows, F.lit(s).cast("double"), F.lit(u), 2).orderBy("rank").collect()]
    assert page(None, None) == ["a", "b"] and page(2.0, "b") == ["c", "d"] and page(1.0, "d") == []


def test_index_equals_a_scan_and_reads_less(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choice(words, int(rng.integers(1, 30)), p=np.arange(300, 0, -1) / 45150)), "ab"[k % 2]) for k in range(400)] + [(400, None, "a"), (401, "", None)]
    asked = [(1, "w1 w5 w299 w298"), (2, "w250"), (3, "nothing"), (4, None), (5, "w0 w1 w2 w3 w290")]
    frame, queries = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(asked, "request_id long, query string")
    index = postings.Index(frame, ["lang"], 4)
    try:
        got = sorted((r["request_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in index.search(queries, 5).collect())
        want = sorted((r["request_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in retrieve.bm25(frame, queries, 5).collect())
        assert got == want and {r[0] for r in got} == {1, 2, 5}
        scored, held = index.reading()
        assert 0 < scored < held
        assert "Exchange hashpartitioning(term" not in plan(index.rows().groupBy("term").count())
    finally:
        index.drop()


def test_leaders_keep_the_first_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(retrieve, "BUFFER", 50)
    rng, leaders, rows = np.random.default_rng(4), retrieve.Leaders(3), []
    for _ in range(40):
        group, key, ident = rng.integers(0, 5, 20), rng.integers(0, 9, 20), rng.integers(0, 1000, 20)
        leaders.add(group, key, ident)
        rows += list(zip(group.tolist(), key.tolist(), ident.tolist()))
        assert leaders.n <= 70
    got = sorted(zip(*(c.tolist() for c in leaders.first())))
    assert got == sorted(r for g in range(5) for r in sorted(x for x in rows if x[0] == g)[:3])


@pytest.mark.parametrize("seed", range(3))
def test_weighted_percentile_is_exact(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("ab"[int(g)] if g < 2 else None, float(np.round(rng.lognormal(3, 2), 3)) if rng.random() < 0.9 else None, int(rng.integers(0, 4))) for g in rng.integers(0, 3, 600)] + [("one", 7.0, 1)]
    frame = spark.createDataFrame(rows, "k string, v double, w long")
    got = {r["k"]: (r["n"], r["q"]) for r in telemetry.weighted_percentile(frame, ["k"], "v", "w", 0.95).collect()}
    for key in {k for k, *_ in rows}:
        spread = [v for k, v, w in rows if k == key and v is not None for _ in range(w)]
        assert got[key][0] == len(spread) and abs(got[key][1] - np.quantile(spread, 0.95)) < 1e-9


def test_relations_differ_by_counts(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i int, s string")
    right = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i int, s string")
    assert sorted(map(tuple, merge.differences(left, right).collect())) == [("left", 1, "a", 1), ("right", 3, "c", 1)]
    assert merge.differences(left, left).count() == 0
