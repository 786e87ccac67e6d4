"""Queries that do the whole job: every row and whole texts, against brute force on small rows."""

from beaconq.plans import search as S


def test_coverage_meets_every_document_in_full(spark):
    docs = spark.createDataFrame([(1, "x " * 400 + "Zebra"), (2, "other"), (2, "zeb"), (None, None), (103, "zebras run")], "doc_id long, text string")
    asked = spark.createDataFrame([(5, "one two three zebra"), (7, "zeb"), (8, "!!")], "request_id long, query string")
    got = sorted((r["request_id"], r["doc_id"] or 0, r["coverage"]) for r in S.coverages(asked, docs).collect())
    assert got == sorted(
        [(5, 0, 0.0), (5, 1, 0.25), (5, 2, 0.0), (5, 2, 0.0), (5, 103, 0.25), (7, 0, 0.0), (7, 1, 0.0), (7, 2, 0.0), (7, 2, 1.0), (7, 103, 0.0)]
        + [(8, d, 0.0) for d in (0, 1, 2, 2, 103)]
    )


def test_every_user_turn_is_a_request(spark, tmp_path):
    from beaconq.plans import catalog

    alias = catalog.ALIASES[4]
    rows = [(0, 0, "system", "s"), (0, 1, "user", "a b c d e f"), (0, 4, "user", "g"), (1, 0, "user", "x  y z u v w"), (1, 1, "assistant", "r")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["request_id"]: r for r in catalog.bang_resolution(spark, str(tmp_path)).collect()}
    assert {k: r["provider_query"] for k, r in got.items()} == {"0:1": "a b c d e f", "0:4": "g", "1:0": "x y z u v w"}
    assert got["0:4"]["bang"] == alias and got["0:1"]["bang"] == got["1:0"]["bang"] == catalog.ALIASES[1]
    for name in ("engine_selection", "request_validation"):
        assert {r["request_id"] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == set(got)


def test_words_are_nfkc(spark):
    import re
    import unicodedata

    from pyspark.sql import functions as F

    from beaconq.functions import text as T

    texts = ["ﬁne ﬂow", "Ｆｕｌｌ　ｗｉｄｔｈ １２", "café öl", "x² ½", "plain é – “q”", "ascii", "", None, "Ω Å"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = frame.select("i", T.words(F.col("t")).alias("w"), T.tokens(F.col("t")).alias("k")).collect()
    for r in rows:
        want = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", texts[r["i"]] or "").lower())
        assert r["w"] == want and r["k"] == sorted(set(want)), texts[r["i"]]
    stable = re.compile(f"[{T.STABLE}]")
    for c in filter(stable.match, map(chr, range(0x3000))):
        assert unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c), hex(ord(c))
