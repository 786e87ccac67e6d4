"""Ids that 64-bit floats do not hold beside null ids, columns of any names, and windows with repeats."""

import random

import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from beaconq.llm import audit, bestfit, bpe, chat, langid, lexical, licences, media, packing, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"
BIG = 1 << 60
IDS = [BIG + 1, None, BIG + 3, 5]
CLASHING = ["_row", "_id", "fp", "row", "root", "rid", "hit", "rank", "shard", "_bucket", "piece", "score", "held_out", "predicted", "label", "digest", "part"]


@pytest.fixture(scope="module")
def wide(spark):
    """Four documents in one batch, with columns whose names operators use themselves, and a map."""
    texts = ["alpha beta gamma delta", "one two three four", "uno dos tres cuatro", "eins zwei drei vier"]
    frame = spark.createDataFrame(list(zip(IDS, texts)), "doc_id long, text string").coalesce(1)
    frame = frame.withColumns({c: F.lit(7) for c in CLASHING})
    return frame.withColumn("m", F.create_map(F.lit("k"), "text")).withColumns({"lang": F.lit("en"), "source": F.lit("s")})


@pytest.fixture(scope="module")
def known(spark):
    return spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/documents.parquet")


def ids(frame, column="doc_id"):
    return sorted((r[column] for r in frame.select(column).collect()), key=str)


def test_every_operator_returns_each_id(spark, wide, known):
    labels, docs = known
    want = sorted(IDS, key=str)
    word, byte = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    for frame in (
        simhash.near_duplicates(wide), media.media_columns(wide), langid.identify(wide, langid.fit(docs)), bpe.encode_documents(wide, byte), packing.pack_documents(wide, word),
        quality.score_quality(wide, quality.fit(docs, labels)), toxicity.score_toxicity(wide, toxicity.fit(docs, labels)), bestfit.pack_best_fit(wide, word),
    ):
        assert ids(frame) == want, frame.columns
    assert audit.audit(wide, labels).filter("step = 1 AND filter_order = 'ABCDE'").first()["kept"] == 0
    items = spark.createDataFrame([(BIG + 1, "alpha one uno eins"), (None, "one")], "item_id long, text string")
    found = lexical.search(lexical.Index(wide), items)
    assert ids(found.filter("item_id IS NOT NULL")) == want and ids(found.filter("item_id IS NULL")) == [None]
    assert licences.scan(wide).count() == 0


def test_conversations_keep_their_ids(spark):
    rows = [(BIG + 1, 0, "user", "a"), (None, 0, "user", "b"), (BIG + 3, 0, "user", "c"), (BIG + 3, 1, "assistant", "d")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"nth": F.lit(1), "piece": F.lit("x")}).coalesce(1)
    assert sorted((str(r["conv_id"]), r["n_turns"]) for r in chat.digests(chat.format_turns(frame)).collect()) == sorted([(str(BIG + 1), 1), ("None", 1), (str(BIG + 3), 2)])


def test_every_stage_keeps_rows_and_columns(spark, wide):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, wide, SF)
        assert kept.columns == wide.columns, name
        assert {r["doc_id"] for r in kept.collect()} <= set(IDS), name
        assert stage(spark, wide.limit(0), SF).count() == 0
    rows = simhash.keep_first(wide).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted(IDS, key=str)
    assert all(r["_row"] == 7 and r["_id"] == 7 and r["m"] == {"k": r["text"]} for r in rows)


def test_a_false_declaration_fails():
    def numbered(turns):
        return "".join(f"{i}:{text};" for i, (_, text) in enumerate(turns))

    renderer = chat.Renderer(numbered, chat.CONTEXT)
    with pytest.raises(ValueError):
        for k in range(200):
            renderer.add("user", str(k))
        renderer.verify()
    said = chat.Renderer(chat.marked_turns, chat.CONTEXT)
    turns = [("user", f"t{k}") for k in range(chat.HISTORY + 100)]
    assert "".join(said.add(*t)[0] for t in turns) == chat.marked_turns(turns)
    said.verify()


def windows(text, template, threshold):
    """The best coefficient over all windows of words."""
    words, grams = licences.words_in(text), set(licences.bigrams_in(template))
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return max((2 * len(set(pairs[i:j]) & grams) / (len(set(pairs[i:j])) + len(grams)) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1)), default=0)


def test_windows_with_repeats_equal_brute_force(spark):
    rng, notice = random.Random(8), "Released under the MIT License."
    texts = ["Released under the the the the the the MIT License."]
    for _ in range(150):
        words = licences.words_in(notice)
        for _ in range(rng.randint(0, 9)):
            words.insert(rng.randint(0, len(words)), rng.choice(["the", "under", "x", "mit", "license", "the"]))
        if rng.random() < 0.3:
            words.pop(rng.randrange(len(words)))
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licences.scan(frame, [("MIT", notice)]).groupBy("doc_id").agg(F.max("dice").alias("d")).collect()
    found = {r["doc_id"]: r["d"] for r in rows}
    want = {i: d for i, t in enumerate(texts) if (d := windows(t, notice, 0.8)) >= 0.8}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-12 for i in want) and 0 in found
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    sql = con.execute(licences.sql([("MIT", notice)])).fetchall()
    mine = licences.scan(frame, [("MIT", notice)]).collect()
    assert sorted(tuple(r) for r in mine) == sorted(sql)
