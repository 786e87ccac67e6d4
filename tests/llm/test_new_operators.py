"""Filter audit, lexical search and best-fit packing against brute force, and on odd rows."""

import math
import re
import struct
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from beaconq.llm import audit, bestfit, lexical, packing

SF = "/root/testdata/sf0.001"
BIG = 1 << 60
SCHEMA = "text string, doc_id long, source string, part string, fails int, good int, shard long, term string, query long, piece int"
ODD = [
    (None, 1, None, "x", 9, 1, 0, "t", 0, 0), ("", 2, "", "x", 9, 1, 0, "t", 0, 0), (" \n", 3, "a", "x", 9, 1, 0, "t", 0, 0), ("One two, one", 4, "a", "x", 9, 1, 0, "t", 0, 0),
    ("One two, one", 4, "a", "x", 9, 1, 0, "t", 0, 0), ("one two! one", BIG + 1, "b", "x", 9, 1, 0, "t", 0, 0), ("one two! one", None, "b", "x", 9, 1, 0, "t", 0, 0),
    ("one two! one", BIG + 3, "b", "x", 9, 1, 0, "t", 0, 0), ("word WORD | " * 20_000, 5, "b", "x", 9, 1, 0, "t", 0, 0), ("é ÉÉ 中 x" * 20, 6, "b", "x", 9, 1, 0, "t", 0, 0),
    (" ".join(f"w{i}" for i in range(60)), 7, "b", "x", 9, 1, 0, "t", 0, 0), (" ".join(f"w{i}" for i in range(60)), 8, "b", "x", 9, 1, 0, "t", 0, 0),
]
LABELS = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (None, 1, 1), (5, 0, 1), (6, None, None), (7, 1, 0), (BIG + 3, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def audited(rows, labels):
    """The contract, filter by filter and document by document."""
    docs = []
    for text, i, source, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for u, j, *_ in rows if (u or "") == t and j is not None]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(same) < i,
        }
        marks = [(q, x) for j, q, x in labels if j is not None and j == i]
        docs.append((source or "", fails, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in mine)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                out.append((part, order, k + 1, len(left), len(gone), failing - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone), f))
    share = Counter()
    for r in out:
        share[r[0], r[9]] += r[4]
    return sorted((*r[:-1], share[r[0], r[9]]) for r in out)


def test_audit_equals_brute_force(odd, labels):
    rows = audit.audit(odd, labels).collect()
    assert sorted(map(tuple, rows)) == audited(ODD, LABELS)


def test_popcounts_over_word_borders():
    rng = np.random.default_rng(5)
    codes, fails = rng.integers(0, 4, 1000), rng.integers(0, 32, 1000)
    good = rng.random(1000) < 0.3
    counts = audit.popcounts(codes, fails, [good, ~good])
    for part in range(4):
        for subset in range(32):
            kept = (codes == part) & (fails & subset == 0)
            assert counts[part, subset].tolist() == [kept.sum(), (kept & good).sum(), (kept & ~good).sum()]


def test_audit_gives_out_sums_early(spark, monkeypatch):
    monkeypatch.setattr(audit, "PARTS_KEPT", 1)
    rows = spark.createDataFrame([(f"p{i % 3}", i % 32, i % 2 == 0, False) for i in range(300)], "part string, fails int, good boolean, toxic boolean")
    found = audit.kept_by_subset(rows.repartition(4)).filter("subset = 0").collect()
    assert sorted((r["part"], r["kept"], r["good"]) for r in found) == [("p0", 100, 50), ("p1", 100, 50), ("p2", 100, 50)]


def ranked(docs, items, k=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = [(i, Counter(split(t))) for t, i, *_ in docs]
    n, total = sum(bool(c) for _, c in texts), sum(c.total() for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in texts:
            m = 75 + 25 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "one One TWO w3"), (2, None), (3, "..."), (None, "é 中"), (BIG + 1, "word w1 w2"), (3, "w1"), (5, "absent")]


@pytest.mark.parametrize("k, shard_docs, block", [(20, 1 << 16, 10_000), (2, 3, 1)])
def test_search_equals_brute_force(spark, odd, k, shard_docs, block):
    index = lexical.Index(odd, shard_docs=shard_docs)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = lexical.search(index, items, k, block_terms=block).collect()
    assert sorted(map(tuple, rows), key=repr) == ranked(ODD, ITEMS, k)


def test_search_of_empty_tables(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.Index(odd.limit(0)), items).count() == 0
    assert lexical.search(lexical.Index(odd), items.limit(0)).count() == 0


def test_impact_order_stops_early_and_is_exact():
    rng = np.random.default_rng(6)
    n, k = 5000, 10
    lists = lexical.Lists(lexical.document_factors(rng.integers(20, 400, n), n, 200 * n))
    query, scores = [], np.zeros(n, np.int64)
    for t in range(6):
        places = np.sort(rng.choice(n, int(rng.integers(50, 3000)), replace=False))
        counts = rng.geometric(0.4, len(places)).astype(np.int64)
        weight = lexical.term_weight(n, len(places))
        lists.add(b"%d" % t, places, counts)
        query.append((b"%d" % t, weight))
        scores[places] += weight * lexical.impacts(counts, lists.factors[places])
    taken = []
    for m in range(1, 7):
        at, found, used = lists.first(query[:m], k, 64)
        want = np.zeros(n, np.int64)
        for (t, w) in query[:m]:
            want[lists.by_place[t][0]] += w * lists.by_place[t][1]
        assert (want[at] == found).all()
        assert set(np.flatnonzero(want >= np.sort(want)[-k])) <= set(at)
        taken.append(used / sum(len(lists.by_place[t][0]) for t, _ in query[:m]))
    assert min(taken) < 0.9


def test_wide_products_do_not_overflow():
    m = lexical.document_factors(np.array([1 << 40], np.int64), 1 << 40, 1 << 50)
    assert m.tolist() == [75 + 25 * (1 << 30)]


def one_by_one(histogram, capacity, rule, weights):
    """Sequences as lists of lengths, piece by piece."""
    bins = []
    for length in sorted(histogram, reverse=True):
        demand = np.array([length, 1, length * length])
        for _ in range(histogram[length]):
            best, at = None, None
            for k, (left, _) in enumerate(bins):
                if (left >= demand).all():
                    scale = capacity.astype(float)
                    score = ((left - demand) / scale) ** 2 @ weights if rule == "norm" else -(left / scale) @ (weights * demand / scale)
                    if best is None or score < best:
                        best, at = score, k
            if at is None:
                bins.append((capacity.copy(), []))
                at = len(bins) - 1
            bins[at] = (bins[at][0] - demand, [*bins[at][1], length])
    return sorted(sorted(b) for _, b in bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents, attention", [(None, None), (4, None), (None, 900), (3, 1500)])
def test_best_fit_equals_one_by_one(rule, documents, attention):
    rng, weights = np.random.default_rng(7), np.array(bestfit.WEIGHTS)
    for _ in range(5):
        sizes = rng.integers(1, 31 if attention else 65, 60)
        histogram = {int(k): int(v) for k, v in Counter(sizes.tolist()).items()}
        placed = bestfit.vector_best_fit(histogram, 64, documents, attention, rule)
        bins, ranks = {}, {}
        for p in placed:
            assert p.rank == ranks.get(p.length, 0)
            ranks[p.length] = p.rank + p.packs * p.each
            for s in range(p.first, p.first + p.packs):
                assert sum(bins.get(s, [])) == p.offset
                bins.setdefault(s, []).extend([p.length] * p.each)
        assert ranks == histogram and sorted(bins) == list(range(len(bins)))
        assert all(sum(b) <= 64 and len(b) <= (documents or 64) and sum(x * x for x in b) <= (attention or 4096) for b in bins.values())
        capacity = np.array([64, documents or 64, attention or 4096])
        assert sorted(sorted(b) for b in bins.values()) == one_by_one(histogram, capacity, rule, weights)


def test_best_fit_refuses():
    with pytest.raises(ValueError):
        bestfit.vector_best_fit({65: 1}, 64)
    with pytest.raises(ValueError):
        bestfit.vector_best_fit({1: 1}, 64, rule="first")
    assert bestfit.vector_best_fit({}) == []


@pytest.mark.parametrize("make, cap, end, kinds", [(bestfit.pack_best_fit, 2048, 0, "piece"), (packing.pack_documents, 4096, 2, "doc_tokens")])
def test_packed_ids_equal_the_library(odd, make, cap, end, kinds):
    lib, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for text, i, *_ in ODD:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, end]
        for at in range(0, len(ids), cap):
            part = ids[at : at + cap]
            want[i, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), at // cap if kinds == "piece" else len(ids)] += 1
    rows = make(odd, P.path("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r[kinds]) for r in rows) == want
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= cap


def test_best_fit_with_limits(odd):
    rows = bestfit.pack_best_fit(odd, P.path("word_bpe_49k.json"), 512, documents=2, attention=200_000, rule="dot").collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert max(map(len, by.values())) <= 2 and max(sum(x * x for x in b) for b in by.values()) <= 200_000
    assert bestfit.pack_best_fit(odd.limit(0), P.path("word_bpe_49k.json")).count() == 0
