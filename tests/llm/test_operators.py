"""The ten operators against brute force, round trips and held-out labels, and on odd rows."""

import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from beaconq.llm import ann, bpe, chat, components, langid, licences, media, packing, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "text string, doc_id long, lang string, component_id long, n int"
ODD = [
    (None, 1, None, 0, 0), ("", 2, "en", 0, 0), ("   \n", 3, "en", 0, 0), ("one", 4, "en", 0, 0), ("one", 4, "en", 0, 0),
    ("word " * 30_000, 5, "de", 0, 0), ("a b c d <|endoftext|> é 中 ́ \x1c", None, "en", 0, 0), (None, None, None, None, None),
    ("Released under the MIT License.\nReleased under the MIT License.", 6, "fr", 0, 0), ("12 !!", 7, "es", 0, 0),
]
LABELS = [(i, i % 2, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def word(name):
    return Tokenizer.from_file(P.path(name))


def roots(prints):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in parent}


@pytest.mark.parametrize("long_list", [2, 512])
def test_simhash_equals_brute_force(spark, long_list):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 62, 20)
    prints = {int(c) for c in centres} | {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 5))) for c in centres for _ in range(12)}
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(frame, long_list)).collect()}
    want = roots(prints)
    groups = {}
    for p in prints:
        groups.setdefault(want[p], set()).add(found.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_simhash_fingerprint():
    import xxhash

    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest("a b", 42)
    assert simhash.fingerprint(" \t") == 0


def test_simhash_odd(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {1}
    assert {r["doc_id"] for r in simhash.keep_first(odd).collect()} >= {1, 4, 5, 6, None}


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None) for i, v in rows], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("factor", [1.0, ann.FACTOR])
def test_neighbours(spark, factor, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:250] = x[7]
    monkeypatch.setattr(ann, "SHARD_ROWS", 150)
    bad = [(600, None), (601, [0.0] * 8), (602, [float("nan")] * 8), (603, [None] * 8), (604, [1.0]), (None, [1.0] * 8), (5, x[5])]
    got = ann.nearest(vectors(spark, [*enumerate(x), *bad]), F.col("vec_id") % 20 == 0, factor=factor).toPandas()
    hit = total = 0
    for q in range(0, 600, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, s[mine.vec_id])
        hit, total = hit + len(set(want) & set(mine.vec_id)), total + 20
        if factor == 1.0:
            assert mine.vec_id.tolist() == want
    assert hit / total >= 0.9


def test_neighbours_empty(spark):
    assert ann.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_media_round_trip(odd):
    rows = media.media_columns(odd).collect()
    assert len(rows) == len(ODD)
    texts = {}
    for text, i, *_ in ODD:
        texts.setdefault(i, []).append(text or "")
    for r in rows:
        payloads = [media.payload_of(t) for t in texts[r["doc_id"]]]
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) in [(n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for n, p in payloads]


def test_chunks_follow_content():
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    a, b = media.cut(body), media.cut(b"x" * 100 + body)
    assert b"".join(a) == body and max(map(len, a)) <= media.MOST
    assert len(set(a) & set(b)) > 0.7 * len(a)


def test_language(spark, docs, odd):
    rows = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    found = langid.identify(odd, langid.fit(docs)).collect()
    assert len(found) == len(ODD) and sum(r["lang_pred"] == "und" for r in found) == 5
    assert langid.identify(odd, langid.fit(odd.limit(0))).filter("lang_pred <> 'und'").count() == 0


PARTS = ["a", "B", "'s", "don't", " ", "\n", "\t", "\x1c", "é", "́", "ΟΔΟΣ", "1", "²", "中", "!", "<|endoftext|>", "the", "ing", "aaaa", "…"]


def random_texts(n, seed=4):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(PARTS, rng.integers(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("name, make", [("byte_bpe_50k.json", bpe.encoder), ("word_bpe_49k.json", packing.encoder)])
def test_ids_equal_the_library(name, make):
    lib, enc = word(name), make(P.path(name))
    for t in random_texts(1500):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert enc.encode(t) == struct.pack(f"<{len(ids)}I", *ids), t


def test_bpe_round_trip(odd):
    rows = bpe.encode_documents(odd, P.path("byte_bpe_50k.json")).collect()
    assert sorted(r["decoded"] for r in rows) == sorted(t or "" for t, *_ in ODD)


def test_packing(docs, odd):
    for table in (docs, odd):
        rows = packing.pack_documents(table, P.path("word_bpe_49k.json")).toPandas().sort_values(["sequence_id", "offset"])
        by = rows.groupby("sequence_id").length
        assert (by.cumsum() - rows.length == rows.offset).all() and by.sum().max() <= packing.SEQUENCE
        assert rows.length.sum() == sum(len(word("word_bpe_49k.json").encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in table.select("text").collect())


@pytest.mark.parametrize("histogram", [{1: 10_000}, {4096: 3, 2048: 5, 1: 7}, {3000: 10, 1000: 25, 90: 60}, {}])
def test_placements(histogram):
    fill, placed = {}, {}
    for p in packing.shortest_pack_first(histogram):
        assert p.rank == placed.get(p.length, 0)
        placed[p.length] = p.rank + p.packs * p.each
        for s in range(p.first, p.first + p.packs):
            assert fill.get(s, 0) == p.offset
            fill[s] = p.offset + p.each * p.length
    assert placed == histogram and max(fill.values(), default=0) <= packing.SEQUENCE
    assert sorted(fill) == list(range(len(fill)))


def test_quality(spark, docs, odd, labels):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score_quality(docs, quality.fit(docs, known)).join(known, "doc_id").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.9
    found = quality.score_quality(odd, quality.fit(odd, labels)).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)


def test_toxicity(spark, docs, odd, labels):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score_toxicity(docs, toxicity.fit(docs, known)).join(known, "doc_id").toPandas()
    assert rows[rows.toxic == 0].predicted.mean() < 0.02 and rows[rows.toxic == 1].predicted.mean() > 0.5
    found = toxicity.score_toxicity(odd, toxicity.fit(odd, labels)).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)


def test_toxicity_grammar():
    m = toxicity.Matcher(toxicity.Grammar())
    plain, negated, quoted = (m.score(t) for t in ("You are an idiot.", "You are not an idiot.", "They said: idiot"))
    assert plain > 0.7 > negated and m.score("The idiomatic pathway.") < 0.1 and quoted <= plain
    assert m.score("He said you are an idiot") < plain


def test_licences(spark, odd):
    rows = licences.scan(odd).collect()
    assert [(r["doc_id"], r["line"], r["licence"]) for r in rows] == [(6, 1, "MIT"), (6, 2, "MIT")]


def test_chat(spark):
    said = [(1, 0, "user", "a</s>\\<|done|>[INST]"), (1, 1, "assistant", None), (1, 1, "assistant", "x<|turn|>\n"), (None, None, None, "q"), (2, 5, "system", "")]
    frame = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    rows = {r["conv_id"]: r for r in chat.digests(chat.format_turns(frame)).collect()}
    want = "user\na</s>\\<|done|>[INST]\nassistant\n\nassistant\nx<|turn|>\n\n"
    assert rows[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and rows[1]["loss_chars"] == 10
    assert set(rows) == {1, 2, None} and not rows[1]["rewrites_history"]
    rewriting = lambda turns: f"{len(turns)} turns: " + "".join(t for _, t in turns)
    assert chat.format_turns(frame, rewriting).filter("rewrites_history").count() > 0
    assert chat.digests(chat.format_turns(frame.limit(0))).count() == 0


def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    for frame in (
        simhash.near_duplicates(none), media.media_columns(none), bpe.encode_documents(none, P.path("byte_bpe_50k.json")), packing.pack_documents(none, P.path("word_bpe_49k.json")),
        licences.scan(none), quality.score_quality(none, quality.fit(none, labels)), toxicity.score_toxicity(none, toxicity.fit(none, labels)),
    ):
        assert frame.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    kept = labels.loc[labels.index.isin(rows.doc_id)]
    assert len(rows) and kept.quality.mean() > 0.97
