"""Fingerprints, scores, placements and stores against plain recomputations; rates on held-out rows alone."""

import heapq
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from beaconq.llm import common, langid, media, packing, quality, simhash, toxicity

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rng, words = np.random.default_rng(9), [f"w{k}" for k in range(50)] + ["Ünï", "ABC", "é"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 60)))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:20]] + texts[:10] + ["w1\tw2\nw3  w4\x0bw5", "A b c"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    ids = list(map(int, rng.permutation(len(texts))))
    prints = {i: plain_fingerprint(t) for i, t in zip(ids, texts)}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


@pytest.fixture(scope="module")
def tables(spark):
    return common.table(spark, SF, "documents"), common.table(spark, SF, "labels")


def test_rates_on_held_out_rows(tables):
    docs, labels = tables
    known = labels.toPandas().groupby("doc_id").max()
    scored = quality.score_quality(docs, quality.fit(docs, labels)).toPandas().set_index("doc_id").join(known, how="inner")
    held = scored[scored.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).toPandas().set_index("doc_id").join(known, how="inner")
    held = scored[scored.held_out]
    assert held[held.toxic == 0].predicted.mean() < 0.05 and held[held.toxic == 1].predicted.mean() > 0.4
    found = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out & found.lang.notna()]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97


def test_quality_scores_of_a_given_model(spark):
    rng = np.random.default_rng(10)
    model = quality.Model(rng.normal(size=(quality.ROWS, quality.DIMENSIONS)), rng.normal(size=(2, quality.DIMENSIONS)), np.array([0.3, -0.2]))
    texts = ["", None, "one", "good words of a text", "same same same", "é ü — x" * 3]
    rows = quality.score_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    for r in rows:
        counts = quality.text_rows(texts[r["doc_id"]] or "")
        mean = sum((n * model.embedding[k] for k, n in counts.items()), np.zeros(quality.DIMENSIONS)) / max(1, sum(counts.values()))
        out = model.weights @ mean + model.bias
        assert abs(r["score"] - 1 / (1 + np.exp(out[0] - out[1]))) < 1e-9


def test_training_samples_are_bounded_in_bytes(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 100) AS b")
    from pyspark.sql import functions as F

    assert common.within_bytes(rows, F.length("b"), 10**9).count() == 4000
    kept = common.within_bytes(rows, F.length("b"), 100_000)
    assert 800 < kept.count() < 1200 and kept.count() == kept.select("doc_id").distinct().count()


@pytest.mark.parametrize("seed", range(4))
def test_packs_equal_one_by_one_placement(seed):
    rng = np.random.default_rng(seed)
    histogram = dict(Counter(rng.integers(1, 101, 300).tolist()))
    fills = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            if fills and fills[0] + length <= 100:
                heapq.heapreplace(fills, fills[0] + length)
            else:
                heapq.heappush(fills, length)
    packs = Counter()
    for p in packing.shortest_pack_first(histogram, 100):
        for s in range(p.first, p.first + p.packs):
            packs[s] += p.each * p.length
    assert len(packs) == len(fills) and sum(packs.values()) == sum(fills)


def test_known_chunks_are_not_stored_again(spark):
    body = np.random.default_rng(11).integers(97, 123, 60_000, dtype=np.uint8).tobytes().decode()
    old = media.store_chunks(spark.createDataFrame([(body,), ("short",)], "text string"))
    new_texts = spark.createDataFrame([(body + "more at the end",), ("short",), ("another",)], "text string")
    try:
        new = media.store_chunks(new_texts, known=old.rows())
        try:
            held, added = ({bytes(r["digest"]) for r in s.rows().select("digest").collect()} for s in (old, new))
            assert not held & added and added
            lists = media.listed(new_texts.selectExpr("1L AS doc_id", "text")).collect()
            assert {bytes(d) for r in lists for d in r["digests"]} <= held | added
        finally:
            new.drop()
    finally:
        old.drop()
