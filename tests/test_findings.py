"""What reviews found: each test fails on the code that the finding was about."""

import datetime as dt
import os
import weakref
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row, functions as F

from beaconq.llm import ann, langid
from beaconq.operators import cursors, postings, retrieve
from beaconq.plans import search
from beaconq.plans.catalog import ORACLES, QUERIES
from beaconq.session import BATCH_BYTES, bound_batches, shared_path
from beaconq.functions import classify
from beaconq.sources import engines, markup, stored
from beaconq.streaming import replay, ttl
from test_queries import SF, compared


def test_a_cursor_is_read_once(spark):
    key, schema = b"k" * 32, "cursor string, query_hash string, page long"
    rows = spark.createDataFrame([("a.b", "q", 1), (None, "q", 2), ("", "q", 3)], schema)
    made = rows.withColumn("cursor", cursors.sign(F.lit("q"), F.lit(7).cast("long"), F.create_map(F.lit("e"), F.lit("x")), F.lit(1000), key))
    both = cursors.resumed(rows.unionByName(made), key, F.lit(2000))
    assert sorted((str(r["failure"]), str(r["page"])) for r in both.collect()) == [("INVALID_CURSOR", "None")] * 2 + [("None", "2")] + [("None", "7")] * 3
    plan = cursors.resumed(rows, key, F.lit(2000))._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.lower().count("from_json") + plan.lower().count("jsontostructs"), plan.count("sha2(")) == (1, 6)


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of the given tables, some of them replaced."""

    def made(**replaced):
        for p in Path(SF).glob("*.parquet"):
            if p.stem not in replaced:
                (tmp_path / p.name).symlink_to(p)
        for name, rows in replaced.items():
            pq.write_table(rows.toArrow(), tmp_path / f"{name}.parquet", coerce_timestamps="us")
        return str(tmp_path)

    return made


def events(spark, rows):
    """Events (number, seconds, user)."""
    day = dt.datetime(2024, 1, 1)
    given = [(n, day + dt.timedelta(seconds=s), u, "view", 1.0, "{}") for n, s, u in rows]
    return spark.createDataFrame(given, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_milliseconds_of_the_gate_are_rounded_as_in_sql(spark, tables):
    # The engine pauses at .865 and is asked at .865, when a success (.865) has ended the pause.
    d = tables(events=events(spark, [(0, 48.864850, 1), (1, 49.865299, 1), (3, 60.0005, 1), (4, 61.000499, 1), (5, 61.0005, 1)]))
    found, wanted = compared(spark, "cooldown_gate", QUERIES["cooldown_gate"], ORACLES["cooldown_gate"], d)
    assert found == wanted


def calls_of(spark):
    rows = [(k, 40.0 * k, k % 2) for k in range(60)] + [(100 + k, 40.0 * k + 1, k % 2) for k in range(60)]
    return events(spark, [*rows, *[(200 + k, 40.0 * k + 2, None) for k in range(60)], *[(300 + k, 40.0 * k + 3, None) for k in range(60)]])


def test_steps_of_a_stream_come_in_their_order(spark, tables, monkeypatch):
    """Whatever times their files have: executors' clocks differ, and stores keep full seconds."""
    real = replay.started

    def started(rows, at, mode="append"):
        root = Path(shared_path(rows.sparkSession, "x").removeprefix("file:")).parent
        for p in root.glob("calls-*/step=*/*.parquet"):
            os.utime(p, (1_700_000_000 - 100 * int(p.parent.name[5:]),) * 2)
        return real(rows, at, mode)

    monkeypatch.setattr(replay, "started", started)
    d = tables(events=calls_of(spark).filter("user_id IS NOT NULL"))
    found, wanted = compared(spark, "rate_limit_stream", QUERIES["rate_limit_stream"], ORACLES["rate_limit_stream"], d)
    assert len(wanted) == 60 and found == wanted


def test_calls_of_no_user_are_counted_too(spark, tables):
    d = tables(events=calls_of(spark))
    found, wanted = compared(spark, "rate_limit_stream", QUERIES["rate_limit_stream"], ORACLES["rate_limit_stream"], d)
    assert found == wanted and any(r[0] is None for r in found)


def test_calls_of_the_first_millisecond_are_counted(spark, tables):
    """The first moment lies between two milliseconds, and four calls are made in it."""
    rows = [(k, 11.172425 + k // 4 * 30.000001, k % 2) for k in range(40)]
    d = tables(events=events(spark, rows))
    found, wanted = compared(spark, "rate_limit_stream", QUERIES["rate_limit_stream"], ORACLES["rate_limit_stream"], d)
    assert len(wanted) == 10 and found == wanted


def test_calls_of_no_moment_are_counted_too(spark, tables):
    given = events(spark, [(k, 40.0 * (k // 3), k % 2) for k in range(30)])
    given = given.withColumn("ts", F.when(F.col("event_id") < 20, F.col("ts")))
    d = tables(events=given)
    found, wanted = compared(spark, "rate_limit_stream", QUERIES["rate_limit_stream"], ORACLES["rate_limit_stream"], d)
    assert sum(r[1] is None for r in wanted) == 2 and found == wanted


def test_a_page_is_new_once_however_far_apart_its_numbers_are(spark, tables):
    """Page 0 comes once, url a with numbers over a day of seconds apart; numbers and urls may be null."""
    rows = [(0, "zero"), (5, "a"), (500_000, "a"), (-7, "b"), (600_000, "c"), (None, "d"), (None, "a"), (400_000, None), (6, None)]
    d = tables(pages=spark.createDataFrame([(*r, "") for r in rows], "page_id long, url string, html string"))
    found, wanted = compared(spark, "new_pages_stream", QUERIES["new_pages_stream"], ORACLES["new_pages_stream"], d)
    assert len(wanted) == 6 and found == wanted


def test_small_files_share_a_task_and_batches_are_bounded_in_bytes(spark):
    path = shared_path(spark, "stored-many")
    body = F.concat(F.lit("x"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2048))
    none = "CAST(NULL AS {})".format
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("request_id"), F.lit("github").alias("engine_id"), F.lit(1).alias("page"), F.lit(200).alias("status"), F.expr(none("map<string,string>")).alias("headers"), body.alias("body"),
        F.lit("u").alias("final_url"), F.expr(none("array<string>")).alias("locations"), F.lit(1).cast("long").alias("duration_ms"),
    )
    for part in (rows.filter("id < 300").coalesce(1), rows.filter("id >= 300").repartition(8)):
        stored.write(part, path)
    reader = stored.Reader(path, ["request_id", "body"])
    parts = reader.partitions()
    assert len(parts) < 9 and sum(len(p.paths) for p in parts) == 9
    batches = [b for p in parts for b in reader.read(p)]
    assert sum(b.num_rows for b in batches) == 400 and max(b.nbytes for b in batches) < 20 << 20


def test_a_long_body_is_read_without_those_beside_it(spark):
    path, names = shared_path(spark, "stored-long"), ["request_id", "body"]
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in stored.FIELDS}
    given = none | {"request_id": F.col("id").cast("string"), "engine_id": F.lit("github"), "page": F.lit(1), "body": F.repeat(F.sha2(F.col("id").cast("string"), 256), 1 << 14)}
    stored.write(spark.range(90).coalesce(1).select(*[c.alias(k) for k, c in given.items()]), path)
    real, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.system_memory_pool())
    pa.set_memory_pool(pool)
    try:
        reader = stored.Reader(path, names)
        sizes = [(len(r["request_id"]), len(r["body"])) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        pa.set_memory_pool(real)
    assert len(sizes) == 90 and sum(n for _, n in sizes) == 90 << 20 and pool.max_memory() < 32 << 20


def test_of_pages_one_at_a_time_is_held_as_objects(monkeypatch):
    class Page(dict):
        pass

    held, most, run = [], [], []

    def read_page(body, base, engine):
        page = Page(results=[{"title": body, "url": base, "description": engine}])
        held.append(weakref.ref(page))
        most.append(sum(r() is not None for r in held))
        return page

    monkeypatch.setattr(markup, "read_page", read_page)
    monkeypatch.setattr(markup.F, "arrow_udf", lambda f, kind: run.append(f) or (lambda *columns: None))
    markup.page_results(None, None, None)
    bodies = pa.array([f"b{k}" if k % 3 else None for k in range(30)])
    got = run[0](bodies, pa.array(["u"] * 30), pa.array(["e"] * 30)).to_pylist()
    one = lambda b: {"results": b and [{"title": b, "url": "u", "description": "e", "thumbnail": None}], "props": None, "failure": None}
    assert got == [one(b) for b in bodies.to_pylist()] and len(most) == 20 and max(most) <= 2
    assert run[0](*[pa.array([], pa.string())] * 3).to_pylist() == []


def test_few_python_workers_are_given_a_few_megabytes(spark):
    plan = search.provider_lists(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("MapInArrow"), plan.count("ArrowEvalPython")) == (1, 0)
    for rows in (engines.engines(spark), engines.bangs(spark)):
        assert "LocalRelation" in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() > 18
    name, other = "spark.sql.execution.arrow.maxBytesPerBatch", spark.newSession()
    bound_batches(other)
    assert other.conf.get(name).rstrip("b") == str(BATCH_BYTES)
    other.conf.set(name, "1m")
    bound_batches(other)
    assert other.conf.get(name) == "1m"


def test_a_body_is_put_in_lower_case_once(spark):
    rows = spark.createDataFrame([(1, 200, "It says FORBIDDEN"), (2, 200, "Captcha"), (3, 429, None), (4, 403, "fine"), (5, 200, "fine"), (6, None, None)], "n int, status int, body string")
    told = rows.select("n", classify.body_failure(F.col("status"), F.col("body")).alias("f"))
    assert [r["f"] for r in told.orderBy("n").collect()] == ["ENGINE_ACCESS_DENIED", "ENGINE_CHALLENGED", "ENGINE_RATE_LIMITED", "ENGINE_ACCESS_DENIED", None, None]
    assert told._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_words_become_numbers_a_chunk_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b{k % 3} c" if k % 5 else None) for k in range(1000)], "doc_id long, text string").coalesce(1)
    found = retrieve.occurrences(docs, retrieve.Asked.of([(1, ["a", "b1"]), (2, ["c"])]), [])
    got = {r["doc_id"]: (r["dl"], list(r["terms"]), list(r["counts"])) for r in found.collect()}
    assert got == {k: (3, [0, 1, 2] if k % 3 == 1 else [0, 2], [1] * (3 if k % 3 == 1 else 2)) if k % 5 else (0, [], []) for k in range(1000)}
    run, real, seen = [], type(docs).mapInArrow, []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: run.append(f) or real(self, f, schema))
    retrieve.occurrences(docs, retrieve.Asked.of([(1, ["a"])]), [])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([["a", "z"]] * 1000)], names=["doc_id", "words"])
    seen += [b.num_rows for b in run[0](iter([batch]))]
    assert sum(seen) == 1000 and max(seen) <= retrieve.CHUNK


def test_an_ngram_is_hashed_once_and_votes_are_those_of_each_word(monkeypatch):
    hashed = []
    monkeypatch.setattr(langid.zlib, "crc32", lambda b, real=zlib.crc32: hashed.append(b) or real(b))
    monkeypatch.setattr(langid, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(langid, "GRAMS", langid.Grams())
    weights = np.random.default_rng(1).normal(size=(langid.BUCKETS, 5)).astype(np.float32)
    voter = langid.Voter(langid.Model(["a"], np.ones((1, 5)), weights, np.zeros(5), np.ones(5)))
    words = [a + b + c for a in "añ\ud800z" for b in "bc" for c in "def"]
    got = voter.margins(words + words[:3])
    assert len(hashed) == len(set(hashed)) > 0

    def vote(word):
        marked = f"<{word}>"
        rows = [zlib.crc32(marked[i : i + n].encode("utf-8", "replace")) % langid.BUCKETS for n in (1, 2, 3) for i in range(len(marked) - n + 1)]
        return np.tanh(langid.STEEPNESS * weights[rows].sum(axis=0) / len(rows) ** 0.5)

    wanted = langid.UNANIMOUS * np.mean([vote(w) for w in words + words[:3]], axis=0)
    assert np.allclose(got, wanted, atol=1e-5) and np.allclose(voter.margins(words[::-1] + words[:3]), wanted, atol=1e-5)


def test_index_packs_postings_where_documents_lie(spark):
    """A term has one row in a chunk, however many ranges it is in, and chunks are put together exactly."""
    docs = [(k, " ".join(f"w{(k * j) % 97}" for j in range(1, 20)), "ab"[k % 2]) for k in range(600)] + [(600, None, "a"), (None, "w1 w1 w2", "b")]
    asked = [(1, "w1 w5 w96"), (2, "w50"), (3, "nothing"), (4, "w0 w1 w2 w3 w90")]
    frame, queries = spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1), spark.createDataFrame(asked, "request_id long, query string")
    for given in ({}, {"chunk": 50}):
        index = postings.Index(frame, ["lang"], 4, **given)
        try:
            rows, chunks, terms = index.rows(), index.rows().filter("term = ''").count(), 97
            assert rows.count() <= (terms + 1) * max(chunks, 4) and (chunks >= 12 if given else chunks <= 4)
            got = sorted((r["request_id"], r["rank"], str(r["doc_id"]), round(r["score"], 6)) for r in index.search(queries, 5).collect())
            want = sorted((r["request_id"], r["rank"], str(r["doc_id"]), round(r["score"], 6)) for r in retrieve.bm25(frame, queries, 5).collect())
            assert got == want and {r[0] for r in got} == {1, 2, 4}
        finally:
            index.drop()


def test_queries_of_a_chunk_are_scored_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, sorted({f"t{x}" for x in rng.integers(0, 40, 6)})) for k in range(23)]
    asked = retrieve.Asked.of(rows)
    n, terms = 300, len(asked.terms)
    texts = [[asked.terms[x] for x in rng.integers(0, terms, 9)] for _ in range(n)]
    counts = [Counter(t) for t in texts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array([9] * n), pa.array([list(c) for c in counts]), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())), pa.array(range(n))], names=["doc_id", "dl", "terms", "counts", "place"]
    )
    made = pa.Table.from_batches(list(postings.packed_rows(batch, 4, 9.0)))
    numbers = [-1 if t == "" else asked.terms.index(t) for t in made["term"].to_pylist()]
    table = made.append_column("number", pa.array(numbers))
    idf = rng.random(terms)
    whole = postings.chunk_best(table, asked, idf, 9.0, 4, 5)
    monkeypatch.setattr(postings, "CELLS", n * 4)
    parts = postings.chunk_best(table, asked, idf, 9.0, 4, 5)
    assert [np.allclose(a, b) for a, b in zip(whole[0], parts[0])] == [True] * 3 and whole[1:] == parts[1:]
    for k, (ident, held) in enumerate(rows):
        scores = [-round(sum(idf[asked.terms.index(t)] * postings.share(c[t], 9, 9.0) for t in held), 9) for c in counts]
        assert list(whole[0][1][whole[0][0] == ident]) == [d for s, d in sorted(zip(scores, range(n)))[:5] if s]


def test_values_of_a_share_of_keys_are_kept_and_timed_together():
    calls, timers = [], set()

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        exists = lambda self: self.held is not None

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        getValueState = lambda self, name, schema: State()
        registerTimer = lambda self, ms: timers.add(ms)
        deleteTimer = lambda self, ms: timers.remove(ms)

    when = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    put = lambda key, n, dies: Row(key=key, at=when(1), put=True, order_by=n, tie=None, value=f"v{n}", expires_at=when(dies), request_id=None)
    ask = lambda key, at: Row(key=key, at=when(at), put=False, order_by=None, tie=None, value=None, expires_at=None, request_id=f"{key}@{at}")
    p = ttl.Expiring()
    p.init(Handle())
    info = lambda ms: type("T", (), {"getExpiryTimeInMs": lambda self: ms, "getCurrentWatermarkInMs": lambda self: ms})()
    assert list(p.handleInputRows((7,), iter([put(f"k{n % 100}", n, 50 + n) for n in range(500)]), None)) == []
    assert len(calls) == 2 and timers == {450_000}
    assert list(p.handleInputRows((7,), iter([put("k3", 1, 9), put("k0", 900, 20), put(None, 1, 99)]), None)) == [] and timers == {20_000}
    got = {r.request_id: r.value for r in p.handleInputRows((7,), iter([ask("k3", 452), ask("k3", 453), ask("k0", 19), ask("k0", 20), ask("none", 5), ask(None, 98)]), None)}
    assert got == {"k3@452": "v403", "k3@453": None, "k0@19": "v900", "k0@20": None, "none@5": None, "None@98": "v1"}
    timers.clear()
    list(p.handleExpiredTimer((7,), info(99_000), info(99_000)))
    assert timers == {451_000} and len(p.state.held[0]) == 99
    timers.clear()
    list(p.handleExpiredTimer((7,), info(549_000), info(549_000)))
    assert timers == set() and p.state.held is None


def test_of_values_of_a_moment_the_last_is_put(spark):
    when = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("a", when(1), True, n, t, f"{n}{t}", when(n), None, part) for part in (0, 1) for n, t in ((1, "z"), (2, None), (2, "b"), (2, "a"))] + [("a", when(2), True, 1, None, "later", when(3), None, 0), (None, when(1), True, 1, None, None, when(3), None, 0)]
    kept = ttl.last_of_moment(spark.createDataFrame(rows, f"{ttl.ROWS}, part int"), "part")
    assert sorted(((r["part"], str(r["key"]), r["at"].second, r["order_by"], str(r["value"]), r["expires_at"].second) for r in kept.collect())) == [(0, "None", 1, 1, "None", 3), (0, "a", 1, 2, "2b", 2), (0, "a", 2, 1, "later", 3), (1, "a", 1, 2, "2b", 2)]


def _neighbours(spark, x, is_query, k):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    return ann.nearest(rows, is_query, k=k, factor=1.0).toPandas().sort_values(["query_id", "rank"])


def test_neighbours_of_a_grove_are_k_a_query(spark, monkeypatch):
    """What regions give back for a query does not grow with their number."""
    x = np.random.default_rng(3).normal(size=(600, 16)).astype(np.float32)
    most, ask = [], ann._ask

    def counted(*given):
        found = ask(*given)
        most.append(found.groupBy("query").count().agg(F.max("count")).first()[0])
        return found

    monkeypatch.setattr(ann, "SHARD_ROWS", 80)
    monkeypatch.setattr(ann, "_ask", counted)
    got = _neighbours(spark, x, F.col("vec_id") % 20 == 0, 5)
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    assert got.vec_id.to_numpy().reshape(-1, 5).tolist() == np.argsort(-s[::20], axis=1, kind="stable")[:, :5].tolist()
    assert most and max(most) <= 6


def test_neighbours_of_equal_products_are_the_least_ids(spark):
    """More rows tie at the k-th place than are looked at exactly."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.full((3000, 1), 0.5), rng.normal(size=(3000, 15)) / 5], axis=1).astype(np.float32)
    x[0] = np.eye(16)[0]
    got = _neighbours(spark, x, F.col("vec_id") == 0, 20)
    assert got.vec_id.tolist() == list(range(1, 21)) and set(got.score) == {0.5}


@pytest.mark.parametrize("factor", [1.0, ann.FACTOR])
def test_trees_and_sifting_equal_brute_force(factor, monkeypatch):
    """Near clusters, so that leaves are passed over, and products that single precision can't tell apart."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12))
    centres /= np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 12)) * 1e-3) * 1e12
    x[:300] = x[0] + rng.normal(size=(300, 12)) * 1e3
    longest = float(np.sqrt((x * x).sum(axis=1).max()))
    tree, q, scanned = ann.build(ann.lifted(x, longest), 32), x[::10], []
    scan = ann.Best.scan
    monkeypatch.setattr(ann, "TILE", 64)
    monkeypatch.setattr(ann.Best, "scan", lambda self, queries, rows, **kw: (scanned.append(len(queries) * len(rows)), scan(self, queries, rows, **kw))[1])
    best = ann.Best(x, np.arange(4000), longest, q, 20, np.full(len(q), -np.inf))
    ann.search(tree, 0, best, np.arange(len(q)), longest, factor)
    query, row, score = best.result()
    exact = np.array([(x * a).sum(axis=1) for a in q])
    assert query.tolist() == np.repeat(np.arange(len(q)), 20).tolist()
    assert row.reshape(-1, 20).tolist() == [np.lexsort((np.arange(4000), -s))[:20].tolist() for s in exact]
    assert (score == exact[query, row]).all() and sum(scanned) < 0.5 * exact.size
